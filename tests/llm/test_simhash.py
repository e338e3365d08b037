"""SimHash components against a plain comparison of all fingerprints."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Smallest index reachable by links of at most two bits, of each."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_golay_code_is_perfect():
    check, error = simhash.golay_tables()
    assert (error >= 0).all() and error[0] == 0
    words = (np.arange(1 << 12) << 11) | check
    assert min(int(w).bit_count() for w in words[1:]) == 7


def test_near_words_share_a_key():
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(300)]
    twins = [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps]
    index, keys = simhash.golay_keys(np.array(fps + twins, np.uint64))
    of = collections.defaultdict(set)
    for i, k in zip(index.tolist(), keys.tolist()):
        of[i].add(k)
    assert all(of[i] & of[300 + i] for i in range(300))
    assert max(map(len, of.values())) <= 18


def test_components_of_texts(docs_of):
    rng, rows = random.Random(2), []
    for g in range(25):
        base = [f"w{rng.randint(0, 900)}" for _ in range(rng.choice([1, 2, 3, 30, 400]))]
        for _ in range(rng.choice([1, 2, 4])):
            words = list(base)
            if len(words) > 100:
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 99)}"
            rows.append((len(rows), "  ".join(words) if rng.random() < 0.5 else " ".join(words).upper()))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "é ß ÄÖ " * 5), (904, "a\x1cb c d"), (905, "One two"), (906, "ONE TWO")]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{fps[i]:016x}", rows[c][0]) for i, c in enumerate(plain_components(fps))}
    got = simhash.simhash_components(docs_of(*rows)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)
    assert want[901][1] == 900


@pytest.mark.parametrize("crowd", [2, 8, 64])
def test_crowds_are_linked_whole(spark, monkeypatch, crowd):
    """Fingerprints close to each other: many share keys; every size of a crowd gives the same components."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng, fps = random.Random(3), set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(70):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
            fps.add(f)
    fps = sorted(fps, key=lambda f: f - (1 << 64) if f >> 63 else f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    part = {r.id: r.component for r in simhash.connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3))).collect()}
    assert [signed.index(part.get(f, f)) for f in signed] == plain_components(fps)


def test_long_texts_in_pieces_and_odd_tables(spark, docs_of, monkeypatch):
    text = " ".join(f"w{k % 71}x{k % 13}" for k in range(3000))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text.encode()) == want and simhash.fingerprint(b"x" * 500) == plain_fingerprint("x" * 500)
    monkeypatch.undo()
    df = docs_of((None, text), (4, text), (4, text), (7, "some other words"), (None, "alone in here without id"))
    for c in ("id", "fp", "n", "part", "key", "fingerprint"):
        df = df.withColumn(c, df.doc_id)
    got = simhash.simhash_components(df).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == {(None, 4): 1, (4, 4): 2, (7, 7): 1, (None, None): 1}
    assert simhash.simhash_components(df.limit(0)).count() == 0

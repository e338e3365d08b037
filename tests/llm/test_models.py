import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontaminate, quality, suffix_tree, toxicity
from cairn.llm.queries import fold


def corpus(n, seed, toxic=0.3):
    rng = random.Random(seed)
    good = ["the", "river", "runs", "under", "old", "bridges", "and", "quiet", "towns"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(good) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.randint(20, 80))]
        bad, junk = rng.random() < toxic, rng.random() < 0.3
        if bad:
            for _ in range(len(w) // 12 + 1):
                w[rng.randrange(len(w))] = "grumbl" + rng.choice(["e", "er", "ing", "ish", "ed", "y"])
        docs.append((i, " ".join(x.upper() + "!!" if junk else x for x in w)))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def accuracy(scored, labels, column, least):
    truth = {r[0]: r[1 if column == "quality" else 2] for r in labels}
    rows = scored.collect()
    return np.mean([(r.score >= least) == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth])


def test_quality_held_out(spark, docs_of):
    docs, labels = corpus(400, 1)
    df, lab = docs_of(*docs, (900, None), (901, "")), spark.createDataFrame(labels + [(7, None, None)], LABELS)
    trees = quality.train_quality(df, lab, F.col("doc_id") < 250)
    scored = quality.score_quality(df, trees)
    assert scored.count() == 402 and all(0 <= r.score <= 1 for r in scored.collect())
    assert accuracy(scored.filter("doc_id between 250 and 899"), labels, "quality", 0.5) > 0.95


def test_quality_flat_trees_equal_walking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.fit(x, y)
    assert ((t.score(x) >= 0.5) == y).mean() > 0.95
    i, total = 5, t.base
    for f, cut, leaf in zip(t.feature, t.threshold, t.leaf):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(x[i, f[node]] > cut[node])
        total += leaf[node - len(f)]
    assert t.score(x)[i] == pytest.approx(1 / (1 + math.exp(-total)))


def test_models_without_labels(spark, docs_of):
    df, lab = docs_of((1, "a b"), (2, None)), spark.createDataFrame([], LABELS)
    assert quality.score_quality(df, quality.train_quality(df, lab, F.lit(True))).count() == 2
    model = toxicity.train_toxicity(df, lab, F.lit(True))
    assert all(r.score < 0.3 for r in toxicity.score_toxicity(df, model).collect())
    assert toxicity.drop_toxic(df, model).count() == 2
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_toxicity_held_out_and_misspellings(spark, docs_of):
    docs, labels = corpus(500, 2)
    df, lab = docs_of(*docs, (900, None)), spark.createDataFrame(labels, LABELS)
    model = toxicity.train_toxicity(df, lab, F.col("doc_id") < 350)
    assert accuracy(toxicity.score_toxicity(df, model).filter("doc_id between 350 and 899"), labels, "toxic", 0.3) > 0.9
    clean, unseen = model.score(pa.array(["the river runs under old bridges " * 3, "the river runs under grumblified bridges " * 3]))
    assert clean < 0.3 < unseen
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    again = model.score(pa.array([d for _, d in docs]), {})
    assert np.allclose(again, model.score(pa.array([d for _, d in docs])))


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 30))
        assert decontaminate.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


def test_copies_are_found_and_clean_documents_left(spark, docs_of):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 50)))) for k in range(20)] + [(50, "too short"), (51, None)]
    docs, want = [], {}
    for i in range(200):
        w = [word() for _ in range(rng.randint(0, 150))]
        if i % 4 == 0:
            k = rng.randrange(20)
            copy = items[k][1].split()
            if i % 8 == 0:  # an edit, with punctuation and case changed
                copy[len(copy) // 2] = "edit"
                copy = [c.upper() + "," for c in copy]
            at = rng.randint(0, len(w))
            w[at:at] = copy
            want[i] = k
        docs.append((i, " ".join(w)))
    df = docs_of(*docs, (900, None), (901, ""))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10_000, 100):  # in one block and in several
        got = decontaminate.contaminated(df, bench, block_words=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == set(want.items())
    for r in got:
        if r.score == 1.0:
            assert docs[r.doc_id][1].split()[r.start_word : r.end_word] == items[r.item_id][1].split()
    clean = decontaminate.drop_contaminated(df, bench, block_words=100)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs if i not in want} | {900, 901}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("every", [6, 7])
def test_copies_with_an_edit_every_few_words(spark, docs_of, every):
    item = [f"i{k}" for k in range(30)]
    copy = [f"e{k}" if k % every == every - 1 else w for k, w in enumerate(item)]
    text = lambda w: " ".join(["before"] * 40 + w + ["after"] * 40)
    df = docs_of((1, text(copy)), (2, text(item)), (3, text(item)), (4, text([])))
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {1: pytest.approx(1 - 2 * (30 // every) / 30, abs=0.05), 2: 1.0, 3: 1.0}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {4}


def test_short_items_and_copies_with_words_put_in(spark, docs_of):
    item = [f"i{k}" for k in range(40)]
    longer = [x for k, w in enumerate(item) for x in ([f"n{k}", w] if 5 <= k <= 19 else [w])]  # score 25 / 40
    df = docs_of((1, "see Four short words, here!"), (2, "four short other words here"), (3, " ".join(longer)), (4, "one"))
    bench = spark.createDataFrame([(7, "four short words here"), (8, " ".join(item)), (9, "One"), (10, ""), (11, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 7): 1.0, (3, 8): pytest.approx(25 / 40), (4, 9): 1.0}


def base_scores(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + ["\0"] for i, t in docs}
    c = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens.items()}


@pytest.mark.parametrize("head", [5, 1000])
def test_suffix_tree_and_its_base(docs_of, monkeypatch, head):
    monkeypatch.setattr(suffix_tree, "HEAD_WORDS", head)
    docs, _ = corpus(150, 3)
    docs += [(500, None), (501, ""), (502, " Émile  ñandú\x0b9,5 "), (503, docs[0][1]), (504, docs[0][1])]
    rows = suffix_tree.score_texts(docs_of(*docs), fold(F.col("doc_id"), 5) != 1).collect()
    want = base_scores(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score < 0
    same = {r.score for r in rows if r.doc_id in (0, 503, 504)}
    assert len(same) == 1


def plain_scores(docs, learn):
    """Every context of up to DEPTH symbols counted, tested and smoothed in dictionaries, then walked symbol by symbol."""
    sym, share, end = suffix_tree.SYMBOL, suffix_tree.SHARE, suffix_tree.END
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def symbols(text):
        raw = b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())).translate(low)
        return [int(sym[b]) for b in raw] + [end], float(sum(share[b] for b in raw))

    counts = collections.defaultdict(collections.Counter)
    for i, t in docs:
        if learn(i):
            s = [end] * suffix_tree.DEPTH + symbols(t)[0]
            for k in range(suffix_tree.DEPTH, len(s)):
                for d in range(suffix_tree.DEPTH + 1):
                    counts[tuple(s[k - d : k])][s[k]] += 1
    total = {c: sum(n.values()) for c, n in counts.items()}
    kept = {()}
    for c, n in counts.items():
        gain = sum(m * math.log(m / total[c] / (counts[c[1:]][x] / total[c[1:]])) for x, m in n.items()) if c else 0
        if c and gain >= suffix_tree.GAIN:
            kept |= {c[j:] for j in range(len(c))}

    def p(c, x):
        if not c:
            return (counts[c][x] + 0.5) / (total.get(c, 0) + 32)
        smooth = suffix_tree.WEIGHT * len(counts[c])
        return (counts[c][x] + smooth * p(c[1:], x)) / (total[c] + smooth)

    out = {}
    for i, t in docs:
        own, spread = symbols(t)
        s, score = [end] * suffix_tree.DEPTH + own, spread
        for k in range(suffix_tree.DEPTH, len(s)):
            d = 0
            while d < suffix_tree.DEPTH and tuple(s[k - d - 1 : k]) in kept:
                d += 1
            score += math.log10(p(tuple(s[k - d : k]), s[k]))
        out[i] = score
    return out


def test_scores_equal_a_plain_walk(docs_of):
    docs, _ = corpus(60, 3)
    docs += [(500, None), (501, ""), (502, " Émile  ñandú\x0b9,5 "), (503, docs[0][1]), (504, "grumbl 12 3"), (505, "x" * 3000)]
    rows = suffix_tree.score_texts(docs_of(*docs), fold(F.col("doc_id"), 5) != 1).collect()
    want = plain_scores(docs, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    assert {r.doc_id: r.score for r in rows} == {i: pytest.approx(s, rel=1e-5) for i, s in want.items()}


@pytest.mark.parametrize("head", [0, 40])
def test_contexts_beyond_the_head_score_alike(docs_of, monkeypatch, head):
    docs, _ = corpus(150, 3)
    docs += [(500, None), (501, ""), (502, "Émile 9,5 zzz"), (503, docs[1][1]), (504, docs[1][1])]
    learn = fold(F.col("doc_id"), 5) != 1
    whole = {r.doc_id: r.score for r in suffix_tree.score_texts(docs_of(*docs), learn).collect()}
    monkeypatch.setattr(suffix_tree, "MAX_STATES", head)
    monkeypatch.setattr(suffix_tree, "_MOST", 3, raising=False)  # counts take several numbers
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(docs_of(*docs), learn).collect()}
    assert got == {i: pytest.approx(s, rel=1e-5) for i, s in whole.items()}
    assert got[1] == got[503] == got[504]


def test_contexts_help_on_unseen_words(docs_of, monkeypatch):
    rng = random.Random(8)
    docs = [(i, " ".join("".join(rng.choices(["ka", "to", "min", "re", "sul", "po"], k=rng.randint(3, 6))) for _ in range(60))) for i in range(120)]
    learn = fold(F.col("doc_id"), 5) != 1
    deep = {r.doc_id: r.score for r in suffix_tree.score_texts(docs_of(*docs), learn).collect()}
    monkeypatch.setattr(suffix_tree, "GAIN", 1e18)  # no context is kept
    flat = {r.doc_id: r.score for r in suffix_tree.score_texts(docs_of(*docs), learn).collect()}
    assert all(deep[i] > 0.7 * flat[i] for i in flat)


def test_suffix_tree_is_a_distribution_with_longest_states():
    ctx = [(np.array([1, 1, 2]), np.array([3, 4, 3]), np.array([5, 2, 9])), (np.array([1 + 64 * 2]), np.array([4]), np.array([7]))]
    tree = suffix_tree.build_tree(ctx, np.ones(64))
    p = 10 ** tree.logp.reshape(-1, 64)
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    assert tree.near[(1 << 12) | (2 << 6) | 9] == 3 and tree.near[(1 << 12) | (9 << 6)] == 1 and tree.near[5 << 12] == 0


def test_nothing_to_learn(docs_of):
    rows = suffix_tree.score_texts(docs_of((1, "ab"), (2, None)), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(r.n_tokens * math.log10(0.5 / 0.5)) for r in rows)

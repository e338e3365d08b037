import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import ngram_join
from cairn.operators.components import connected_components


def brute(rows, n, num, den):
    """{id: (shingles, component)} by comparing all sets."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else None].append(i)
    known = [s for s in sets if s is not None]
    root = {s: s for s in known}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(known):
        for b in known[:k]:
            both = len(a & b)
            if den * both >= num * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for s in known:
        least[find(s)] += [i for i in sets[s] if i is not None]
    out = {i: (len(s), min(least[find(s)], default=None)) for s in known for i in sets[s]}
    return out | {i: (0, i) for i in sets.get(None, [])}


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randint(0, 9999)}"
    return words


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_components_equal_brute_force(docs_of, n, num):
    rng, rows = random.Random(n), []
    vocabulary = [f"w{k}" for k in range(400)]
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 6, 8, 12, 20, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, 14])):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 25))))))
    common = " ".join(rng.choices(vocabulary, k=50))  # a passage that many share
    rows += [(1000 + i, common + " " + " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "One"), (2004, "one"), (2005, "one two"), (2006, "ONE  TWO"), (2007, "é ß"), (2008, rows[0][1].upper())]
    got = ngram_join.ngram_components(docs_of(*rows), n=n, num=num, den=100).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, num, 100)


def test_large_group_is_split_into_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 6)))) for i in range(60)]
    got = ngram_join.ngram_components(docs_of(*rows), n=3, num=90, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90, 100)


def test_drop_keeps_the_smallest_id_and_columns(docs_of):
    text = " ".join(f"w{k}" for k in range(100))
    df = docs_of((5, text), (3, text + " x"), (9, "other words are here"), (None, None), (None, "n"))
    got = ngram_join.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted((r.doc_id or -1) for r in got.collect()) == [-1, -1, 3, 9]
    assert ngram_join.ngram_components(df.limit(0)).count() == 0


def test_rule_finds_every_linked_pair():
    """Linked sizes are in the same or the next class, and more fragments than differences are cut."""
    for num in (80, 90):
        rule = ngram_join.Rule(3, num, 100)
        for a in range(1, 300):
            for b in range(a, a * 100 // num + 1):
                assert set(rule.classes(a)) & set(rule.classes(b))
                c = min(set(rule.classes(a)) & set(rule.classes(b)))
                m, d = rule.cut(rule.cls(b))
                assert rule.differ(a, b) <= d < m and rule.cls(b) in rule.classes(a), c


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (7, 7), (200, 201)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[100] == got[75] == 50 and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [3, 5, 8])
def test_batches_of_few_words(n):
    texts = [" ".join(f"w{k}" for k in range(words)) for words in range(n + 2)]
    for t in texts:  # a batch of its own
        got = list(ngram_join.gram_sets(pa.array([t, t.upper(), None]), n))
        assert [len(g) for g in got] == [brute([(1, t)], n, 80, 100)[1][0]] * 2 + [0] and (got[0] == got[1]).all()
    alone = [list(ngram_join.gram_sets(pa.array([t]), n))[0].tolist() for t in texts]
    assert [g.tolist() for g in ngram_join.gram_sets(pa.array(texts), n)] == alone and len({tuple(g) for g in alone}) == n + 2


def test_a_batch_of_two_words(docs_of):
    df = docs_of((1, "one two"), (2, "ONE two")).coalesce(1)
    assert [r.doc_id for r in ngram_join.drop_near_duplicates(df).collect()] == [1]


def test_drop_of_repeated_ids_rows_and_clashing_names(spark, docs_of):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text + " x"), (2, "a text of its own words only here"), (2, text + " x"), (None, text), (None, "some words without an id of theirs"), (7, ""), (7, ""), (7, None), (1, text), (8, "one two"), (8, "one two")]
    df = docs_of(*rows)
    for c in ("gone", "k", "n", "id", "touched", "__key", "stays", "group"):
        df = df.withColumn(c, df.doc_id)
    got = ngram_join.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter({(1, text): 1, (2, rows[2][1]): 1, (None, rows[5][1]): 1, (7, ""): 2, (7, None): 1, (8, "one two"): 1})
    assert ngram_join.drop_near_duplicates(df.limit(0)).count() == 0


def test_very_long_text(docs_of):
    text = " ".join(f"w{k % 70000}" for k in range(400_000))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs_of((3, text), (4, text + " end"), (5, "short"))).collect()}
    assert got == {3: 3, 4: 3, 5: 5}


@pytest.mark.parametrize("few", [1_000_000, 2])
def test_clusters_of_several_components(docs_of, monkeypatch, few):
    """A passage that chains unlinked families into one cluster, cut into small blocks; with few broadcast rows as well."""
    from cairn.operators import tables

    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", few)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 6)
    rng, rows = random.Random(21), []
    passage = [f"p{k}" for k in range(60)]
    for f in range(5):
        own = [f"f{f}x{k}" for k in range(rng.choice([8, 12, 40]))]
        for _ in range(rng.choice([3, 9, 15])):
            rows.append((len(rows), " ".join(edited(rng, passage + own, rng.randint(0, 3)))))
    got = ngram_join.ngram_components(docs_of(*rows), n=3, num=90, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90, 100)


def test_a_passage_of_many_documents_ties_none_that_are_not_alike(docs_of):
    """Else documents that share a passage are one cluster, in which all pairs are compared."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 100_000)}"
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for i in range(60)]
    rows += [(100 + i, " ".join(edited(rng, rows[i][1].split(), 1))) for i in range(5)]
    stars = ngram_join._stars(docs_of(*rows), ngram_join.Rule(5, 80, 100))
    clusters = collections.Counter(r.component for r in connected_components(stars.selectExpr("k AS a", "c AS b")).collect())
    assert sorted(clusters.values()) == [1] * 5  # the larger ends of five pairs
    got = ngram_join.ngram_components(docs_of(*rows), n=5, num=80, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 5, 80, 100)


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_fragments_left_out_lose_no_linked_pair(n, num):
    """Whatever the order: linked sets have a fragment in common that neither leaves out."""
    rule, rng, linked = ngram_join.Rule(n, num, 100), np.random.default_rng(n), 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 1 << 64, rng.integers(1, 90), np.uint64))
        size = int(rng.integers(1, len(a) + 1)) if rng.random() < 0.3 else len(a) - int(rng.integers(0, len(a) // 8 + 1))
        b = np.unique(np.r_[rng.choice(a, size, False), rng.integers(0, 1 << 64, rng.integers(0, len(a) // 8 + 2), np.uint64)])
        if len(np.setxor1d(a, b)) and 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
            order, kept = np.uint64(rng.integers(0, 1 << 64, dtype=np.uint64)), []
            for g in (a, b):
                kept.append({(c, s) for c, out, sigs in ngram_join.fragments(g, rule) for s in sorted(sigs.tolist(), key=lambda x: x ^ int(order))[: len(sigs) - out]})
            assert kept[0] & kept[1]
            linked += 1
    assert linked > 100

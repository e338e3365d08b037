"""Copies with edits against a full alignment of every item with every text."""

import collections
import random

import pyarrow as pa
import pytest

from cairn.llm import decontaminate as dc
from cairn.llm.words import letters_digits, words

BENCH = "item_id long, text string"


def hashes(text):
    return words(pa.array([text]), letters_digits())[3]


def corpus(rate, n_items=40, copies=6, seed=3):
    """(items, texts, item of each text): a copy of an item with a share of its words edited, within other words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [[word() for _ in range(rng.randint(10, 50))] for _ in range(n_items)]
    for i in range(0, n_items, 4):  # passages that several items share: common seeds
        items[i][:8] = [f"common{k}" for k in range(8)]
    texts, of = [], []
    for _ in range(copies):
        for i, item in enumerate(items):
            edited = []
            for x in item:
                u = rng.random()
                edited += [word()] if u < rate * 0.6 else [] if u < rate * 0.8 else [x, word()] if u < rate else [x]
            texts.append(" ".join([word() for _ in range(rng.randint(0, 60))] + edited + [word() for _ in range(rng.randint(0, 60))]))
            of.append(i)
    return [" ".join(i) for i in items], texts, of


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.15, 0.2, 0.25])
@pytest.mark.parametrize("rare", [0, 32])
def test_recall_by_edits(monkeypatch, rate, rare):
    monkeypatch.setattr(dc, "RARE_HITS", rare)
    items, texts, of = corpus(rate)
    h = [hashes(t) for t in items]
    known = dc._items(list(range(len(items))), h)
    got = {(d, i): s for d, i, s, _, _ in dc.find_copies(pa.array(texts), known, known.table(), dc.LEAST)}
    full = {(d, i): dc.align(h[i], hashes(t))[0] / len(h[i]) for d, (t, i) in enumerate(zip(texts, of))}
    want = {k for k, s in full.items() if s >= dc.LEAST}
    assert len(want) > 60 and len(want & set(got)) >= 0.95 * len(want)
    assert all(got[k] == pytest.approx(full[k]) for k in want & set(got))
    assert all(s >= dc.LEAST for s in got.values())


def test_texts_without_copies_are_left_alone(docs_of, spark):
    items, texts, _ = corpus(0.0)
    rng = random.Random(9)
    bench = spark.createDataFrame(list(enumerate(items)), BENCH)
    clean = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(300))) for i in range(200)]
    assert dc.contaminated(docs_of(*clean), bench).count() == 0


@pytest.mark.parametrize("block", [30, 2_000_000])
def test_odd_rows_long_texts_and_clashing_names(spark, docs_of, block):
    item = " ".join(f"x{k}" for k in range(20))
    long = "some words of no item " * 100_000
    rows = [(1, None), (2, ""), (3, f"{long} {item} {long}"), (4, item), (4, item), (None, item.upper()), (7, "one two"), (8, "a ONE, two! b")]
    df = docs_of(*rows)
    for c in ("id", "found", "item_id", "score", "h", "item"):
        df = df.withColumn(c, df.doc_id)
    bench = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (13, "one two"), (None, "never to be found here at all")], BENCH).coalesce(1)
    got = collections.Counter((r.doc_id, r.item_id, r.score) for r in dc.contaminated(df, bench, block_words=block).collect())
    assert got == {(3, 10, 1.0): 2, (4, 10, 1.0): 4, (None, 10, 1.0): 2, (7, 13, 1.0): 1, (8, 13, 1.0): 1}
    left = dc.drop_contaminated(df, bench, block_words=block)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0
    assert dc.drop_contaminated(df, bench.limit(0)).count() == len(rows)

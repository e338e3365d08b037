"""Quality and toxicity of odd rows: nulls, empty and long texts, repeated rows, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

from cairn.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark, docs_of):
    good, bad = "a clear and careful sentence about the weather . " * 8, "stupid idiot rubbish hate you fool ! " * 8
    rows = [(i, (bad if i % 2 else good) + f" number {i % 5}") for i in range(60)]
    rows += [(100, None), (101, ""), (None, good), (None, None), (102, good * 8000), (103, bad), (103, bad), (5, rows[5][1])]
    df = docs_of(*rows)
    for c in ("id", "label", "x", "words", "counts", "score", "quality", "toxic"):
        df = df.withColumn(c, df.doc_id)
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)] + [(7, None, None), (None, 1, 1), (900, 1, 1)], LABELS)
    return df, labels, rows


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_odd_rows(odd, kind):
    df, labels, rows = odd
    train, score = (quality.train_quality, quality.score_quality) if kind == "quality" else (toxicity.train_toxicity, toxicity.score_toxicity)
    model = train(df, labels, F.col("doc_id") % 3 != 1)
    got = [(r.doc_id, r.score) for r in score(df, model).collect()]
    assert sorted(str(i) for i, _ in got) == sorted(str(i) for i, _ in rows) and all(0 <= s <= 1 for _, s in got)
    at = {}
    for i, s in got:
        assert at.setdefault(i, s) == s or i is None  # repeated rows get equal scores
    held = [i for i in range(60) if i % 3 == 1]
    right = [(at[i] >= 0.5) == ((i % 2 == 0) if kind == "quality" else (i % 2 == 1)) for i in held]
    assert sum(right) >= 0.9 * len(right)
    if kind == "toxic":
        assert at[102] < 0.3 < at[103]
    assert score(df.limit(0), model).count() == 0
    none = train(df, labels.limit(0), F.lit(True))
    assert {r.score for r in score(df, none).collect()} <= ({0.5} if kind == "quality" else {r.score for r in score(df.limit(1), none).collect()})
    empty = train(df.limit(0), labels, F.lit(True))
    assert score(df, empty).count() == len(rows)


def test_dropped_rows_keep_their_columns(odd):
    df, labels, _ = odd
    model = toxicity.train_toxicity(df, labels, F.lit(True))
    left = toxicity.drop_toxic(df, model, 0.3)
    assert left.columns == df.columns
    kept = {r.doc_id for r in left.collect()}
    assert {0, 2, 102} <= kept and not kept & {1, 3, 103}  # empty texts score the share of toxic labels, a half here

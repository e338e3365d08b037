import collections
import random

import pytest

import corpus_pipeline
from cairn.llm import decontaminate, queries
from tests.llm.test_models import LABELS, corpus
from tests.llm.test_ngram_join import brute, edited


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs_of):
    rng = random.Random(12)
    docs, labels = corpus(260, 4, toxic=0.15)
    rows = [(i, t, rng.choice(["a", "b", None])) for i, t in docs]
    word = lambda: f"w{rng.randint(0, 4000)}"
    items = [(k, " ".join(word() for _ in range(20))) for k in range(6)]
    for i in range(300, 400):  # clean documents of their own words
        rows.append((i, " ".join(word() for _ in range(60)), rng.choice(["a", "b", None])))
    for i in range(400, 420):
        rows.append((i, rows[260 + i - 400][1], "a"))  # exact copies
    for i in range(420, 440):
        rows.append((i, " ".join(edited(rng, rows[280 + i - 420][1].split(), 1)), "b"))  # near copies
    for i in range(440, 446):
        rows.append((i, " ".join(word() for _ in range(30)) + " " + items[i - 440][1], "a"))
    rows += [(500, None, "a"), (501, "", None), (502, "tiny", "z")]
    d = tmp_path_factory.mktemp("sf")
    docs_of(*rows).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows, labels, items


def test_stages_equal_brute_force(spark, folder):
    d, rows, labels, items = folder
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        seen.append((name, {r.doc_id: r for r in docs.collect()}, out.collect()))
        assert docs.columns == out.columns[: len(docs.columns)]
        docs = out.select(*docs.columns)
    names = [n for n, _, _ in seen]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "source_mix"]

    toxic = {i for i, _, t in labels if t}
    _, _, out = seen[0]
    kept = {r.doc_id for r in out}
    assert len(kept & toxic) < 0.15 * len(toxic) and kept >= set(range(300, 446))

    _, before, out = seen[1]
    last = {}
    for i, r in before.items():
        last[r.text or ""] = max(i, last.get(r.text or "", -1))
    assert sorted(r.doc_id for r in out) == sorted(last.values())

    _, before, out = seen[2]
    want = brute([(i, r.text) for i, r in before.items()], 5, 80, 100)
    assert sorted(r.doc_id for r in out) == sorted(i for i in before if want[i][1] == i)
    assert len(out) < len(before)

    _, before, out = seen[3]
    assert set(before) - {r.doc_id for r in out} == set(range(440, 446))

    _, before, out = seen[4]
    copies = collections.Counter(r.doc_id for r in out)
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    assert all(sorted(r.copy_no for r in out if r.doc_id == i) == list(range(1, n + 1)) for i, n in copies.items())
    size = lambda r: len((r.text or "").split())
    assert sum(map(size, out)) == pytest.approx(sum(map(size, before.values())), rel=0.1)


def test_run_reads_and_writes_each_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy_no"] and out.count() > 100


def test_every_numbered_query_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_queries_of_the_small_table(spark, folder):
    d, rows, labels, items = folder
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, d).collect()}
    assert len(got) == len(rows) and all(r.predicted == int(r.score >= 0.3) for r in got.values())
    got = {r.doc_id: r for r in queries.op3_quality(spark, d).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    got = queries.op8_source_mix(spark, d).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert {r.doc_id for r in queries.op9_decontaminate(spark, d).collect()} == set(range(440, 446))
    assert decontaminate.LEAST == 0.6
    got = queries.op7_licenses(spark, d).collect()
    assert len(got) == len(rows) and all(r.n_base == 0 and r.first_word is None and r.base_labels == "" for r in got)

"""The corpus pipeline: toxic documents go, then exact and near copies, then benchmark copies; what stays is mixed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns documents' columns; the last
one adds copy_no (a document that the mix takes twice has the rows 1 and 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from cairn.llm.queries import fold
from cairn.llm.spark_io import table
from cairn.operators.tables import drop_path, saved, work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.3 or more are rejected."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return toxicity.drop_toxic(docs, model, 0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles one stays."""
    return ngram_join.drop_near_duplicates(docs, n=5, num=80, den=100)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, are rejected."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; documents come as often as they are taken."""
    return mixing.apply_mix(docs, saved(mixing.mix_plan(docs)))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("source_mix", mix_sources),
]

#: Learned models, alignment and hashed randomness have no SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each one's result is written as Parquet and read again, and goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs

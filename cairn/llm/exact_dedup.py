"""Exact deduplication by progressive refinement: length groups, then prefix hashes, then full hashes of survivors.

What the first two steps find is sent to the tasks as bit tables of a fixed size, so texts aren't shuffled for them; two
keys may share a bit, which only means that a text without a copy is hashed as well.

Null texts count as empty, and of equal texts the row with the largest id stays; null ids sort lowest. Repeated rows (same
text and same id) form one group and exactly one of them stays. A text of any length is hashed as a whole. An empty table
gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.spark_io import bit_table, fresh_name, marked, text_or_empty
from cairn.operators.tables import join_groups, saved

#: Characters that the second refinement step hashes.
PREFIX_CHARS = 256


def _refined(df: DataFrame, text_col: str, prefix_chars: int) -> tuple[DataFrame, str, str]:
    """df with two more columns: hit (false if its length, or its length and prefix, is unique) and key (hit's full hash)."""
    text = text_or_empty(text_col)
    size, prefix, hit, key = (fresh_name(df, x) for x in ("size", "prefix", "hit", "key"))
    sized = df.withColumn(size, F.octet_length(text).cast("long"))

    # 1. Lengths that occur once have no copy.
    sizes = bit_table(sized.groupBy(size).agg(F.count("*").alias("n")).filter("n > 1").select(size))
    sized = marked(sized, sizes, hit, F.col(size))

    # 2. Among the rest, (length, prefix hash) that occur once have no copy.
    prefixed = sized.withColumn(prefix, F.when(F.col(hit), F.xxhash64(F.substring(text, 1, prefix_chars))))
    pairs = prefixed.filter(F.col(hit)).groupBy(size, prefix).agg(F.count("*").alias("n")).filter("n > 1").select(size, prefix)
    pair = fresh_name(prefixed, "pair")
    found = marked(prefixed, bit_table(pairs), pair, F.col(size), F.col(prefix)).withColumn(hit, F.col(hit) & F.col(pair)).drop(pair)

    # 3. Whole texts are hashed for what survives.
    return found.withColumn(key, F.when(F.col(hit), F.sha2(text.cast("binary"), 256))).drop(size, prefix), key, hit


def mark_exact_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: dict[str, Column] | None = None, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of df: its id, keep_id, group_size, kept, full_hash (null if it wasn't needed), and carry's columns."""
    rows, key, hit = _refined(df, text_col, prefix_chars)
    # A tag tells repeated rows apart; it is fixed once the rows are saved.
    narrow = saved(rows.select(F.col(id_col).alias("id"), F.col(key).alias("full_hash"), F.monotonically_increasing_id().alias("tag"), *[c.alias(n) for n, c in (carry or {}).items()]))
    extra = [F.col(n) for n in carry or {}]
    single = narrow.filter("full_hash is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash", *extra)
    many = narrow.filter("full_hash is not null")
    groups = saved(many.groupBy("full_hash").agg(F.max(F.struct("id", "tag")).alias("top"), F.count("*").alias("group_size")))
    copies = join_groups(many, groups, ["full_hash"], "group_size")
    copies = copies.select("id", F.col("top.id").alias("keep_id"), "group_size", (F.col("tag") == F.col("top.tag")).alias("kept"), "full_hash", *extra)
    return single.unionByName(copies).withColumnRenamed("id", id_col)


def drop_exact_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """df's rows and columns, one for each distinct text. Only texts of surviving groups are shuffled, after map-side maxima.

    Of rows with equal text and id, the one with the largest hash of its other columns stays, so reruns agree.
    """
    rows, key, hit = _refined(df, text_col, prefix_chars)
    single = rows.filter(~F.col(hit)).select(*df.columns)
    whole = F.struct(*[F.col(c) for c in df.columns])
    others = [F.col(f.name) for f in df.schema if f.name not in (text_col, id_col) and isinstance(f.dataType, T.AtomicType)]
    best = rows.filter(F.col(hit)).groupBy(key).agg(F.max_by(whole, F.struct(F.col(id_col), F.xxhash64(F.lit(0), *others))).alias("row"))
    return single.unionByName(best.select("row.*"))

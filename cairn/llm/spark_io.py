"""Small helpers of the text operators: input tables, column names, and bit tables of keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.tables import saved

#: The most bits of a bit table (a power of two), which take 16 MB, and the least; in between, it has BITS_PER_KEY a key.
MOST_BITS, LEAST_BITS, BITS_PER_KEY = 1 << 27, 1 << 15, 16
#: Bits of one of its rows.
_ROW = 1 << 15


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


@dataclass
class Bits:
    """A table of keys as bits: rows of 4 kB. A key that isn't there may share a bit with others, none is missing."""

    rows: DataFrame
    size: int


def _bit(keys: list[Column], size: int) -> Column:
    """The bit of a key, nulls included."""
    return F.xxhash64(*keys, *[k.isNull() for k in keys]).bitwiseAND(F.lit(size - 1))


def bit_table(keys: DataFrame) -> Bits:
    """The bits of a narrow table of keys, of bounded size whatever the number of keys."""
    keys = saved(keys)
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    bit = _bit([F.col(c) for c in keys.columns], size)
    rows = keys.select(F.shiftright(bit, 15).alias("row"), bit.bitwiseAND(F.lit(_ROW - 1)).alias("at")).groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits"))
    return Bits(saved(rows), size)


def marked(df: DataFrame, bits: Bits, name: str, *keys: Column) -> DataFrame:
    """df with a boolean column: false only if the key isn't in the bit table, which is broadcast, so df isn't shuffled."""
    row, have = fresh_name(df, "row"), fresh_name(df, "bits")
    bit = _bit(list(keys), bits.size)
    met = df.withColumn(row, F.shiftright(bit, 15)).join(F.broadcast(bits.rows.select(F.col("row").alias(row), F.col("bits").alias(have))), row, "left")
    at = bit.bitwiseAND(F.lit(_ROW - 1))
    byte = F.conv(F.hex(F.substring(have, (F.shiftright(at, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    return met.withColumn(name, F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))).drop(row, have)

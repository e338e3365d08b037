"""Catalog-shaped views of the benchmark tables, and the same views in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assets: spread over the globe, some without coordinates, time, or with an interval."""
    e = F.col("event_id")
    ms = F.when(e % 31 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    kind = F.when(e % 17 == 0, "image").when(e % 19 == 0, "video").when(e % 23 == 0, "timeline_visit").otherwise("geo_point")
    return _table(spark, sf_dir, "events").select(
        e.alias("asset_id"), F.concat(F.lit("media-"), F.lpad(e.cast("string"), 7, "0")).alias("media_id"), kind.alias("kind"),
        F.when(e % 29 != 0, -80 + ((e * 104729) % 1600000).cast("double") / 10000.0).alias("latitude"),
        F.when(e % 29 != 0, -170 + ((e * 224737) % 3400000).cast("double") / 10000.0).alias("longitude"),
        ms.alias("timestamp_ms"), F.when(e % 23 == 0, ms + 3600000 * (1 + e % 5)).alias("end_timestamp_ms"), "user_id", "event_type",
    )


GEO_SQL = """
ge AS (SELECT event_id AS asset_id, 'media-' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS media_id,
  CASE WHEN event_id % 17 = 0 THEN 'image' WHEN event_id % 19 = 0 THEN 'video' WHEN event_id % 23 = 0 THEN 'timeline_visit' ELSE 'geo_point' END AS kind,
  CASE WHEN event_id % 29 <> 0 THEN -80 + CAST((event_id * 104729) % 1600000 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS latitude,
  CASE WHEN event_id % 29 <> 0 THEN -170 + CAST((event_id * 224737) % 3400000 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS longitude,
  CASE WHEN event_id % 31 <> 0 THEN epoch_us(ts) // 1000 END AS timestamp_ms,
  CASE WHEN event_id % 31 <> 0 AND event_id % 23 = 0 THEN epoch_us(ts) // 1000 + 3600000 * (1 + event_id % 5) END AS end_timestamp_ms,
  user_id, event_type FROM events)
"""


def trip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as users' trips, with gaps in their sequences."""
    e, u = F.col("event_id"), F.col("user_id")
    sequence = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    rows = _table(spark, sf_dir, "events").withColumn("sequence", sequence).filter("event_type <> 'error'")
    return rows.select(
        e.alias("asset_id"), F.concat(F.lit("trip-"), u.cast("string")).alias("group_id"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts_sec"), "sequence",
        (-60 + (u * 37) % 120 + (e % 97).cast("double") / 100.0).alias("latitude"), (-170 + (u * 53) % 340 + (e % 89).cast("double") / 100.0).alias("longitude"),
    )


TRIP_SQL = """
tp AS (SELECT event_id AS asset_id, 'trip-' || user_id AS group_id, (epoch_us(ts) // 1000) // 1000 AS ts_sec, sequence,
  -60 + (user_id * 37) % 120 + CAST(event_id % 97 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
  -170 + (user_id * 53) % 340 + CAST(event_id % 89 AS DOUBLE) / CAST(100 AS DOUBLE) AS longitude
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events) WHERE event_type <> 'error')
"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as what imports saw of assets: content hash, source, generation, sequence and fields that may be missing."""
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("h-"), F.col("o_custkey").cast("string")).alias("media_id"), F.concat(F.lit("src-"), (k % 5).cast("string")).alias("source_id"),
        (k % 3).cast("long").alias("generation"), k.cast("long").alias("ingest_seq"),
        F.when(k % 4 != 0, F.concat(F.lit("name-"), k.cast("string"))).alias("display_name"), F.when(k % 3 != 1, k.cast("long") * 10).alias("size_bytes"),
        F.when(k % 7 != 2, k.cast("long") * 1000).alias("timestamp_ms"), F.concat(F.lit("loc-"), (k % 50).cast("string")).alias("location_id"),
        F.concat(F.lit("p/"), k.cast("string")).alias("relative_path"),
    )


def sources(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("src-"), F.col("id").cast("string")).alias("source_id"), (F.col("id") % 3).alias("generation"), (F.col("id") != 4).alias("active"))


OCC_SQL = """
oc AS (SELECT 'h-' || o_custkey AS media_id, 'src-' || (o_orderkey % 5) AS source_id, CAST(o_orderkey % 3 AS BIGINT) AS generation, CAST(o_orderkey AS BIGINT) AS ingest_seq,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'name-' || o_orderkey END AS display_name, CASE WHEN o_orderkey % 3 <> 1 THEN CAST(o_orderkey AS BIGINT) * 10 END AS size_bytes,
  CASE WHEN o_orderkey % 7 <> 2 THEN CAST(o_orderkey AS BIGINT) * 1000 END AS timestamp_ms, 'loc-' || (o_orderkey % 50) AS location_id, 'p/' || o_orderkey AS relative_path FROM orders),
so AS (SELECT 'src-' || range AS source_id, range % 3 AS generation, range <> 4 AS active FROM range(5)),
live AS (SELECT oc.* FROM oc SEMI JOIN so ON oc.source_id = so.source_id AND oc.generation = so.generation AND so.active)
"""

"""Trips (groups of located items): summaries, points and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.geo import to_e7
from cairn.functions.values import KINDS, MEDIA_KINDS, ms_to_sec
from cairn.plans.spec import DEFAULT_GROUPS, SearchSpec


def group_summary(items: DataFrame) -> DataFrame:
    """Per group: count, start and end second, bounds in 1e-7 degrees (0 without coordinates), kinds and source types.

    items: kind, source_type, group_ids (the distinct groups of an item and its locations), latitude, longitude,
    timestamp_ms, end_timestamp_ms. Items without any time are left out.
    """
    start = ms_to_sec(F.coalesce("timestamp_ms", "end_timestamp_ms"))
    end = ms_to_sec(F.coalesce("end_timestamp_ms", "timestamp_ms"))
    geo = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    rows = items.filter(F.coalesce("timestamp_ms", "end_timestamp_ms").isNotNull()).select(
        F.explode(F.array_distinct("group_ids")).alias("group_id"), "kind", "source_type", start.alias("start_sec"), end.alias("end_sec"),
        F.when(geo, to_e7("latitude", 90)).alias("lat_e7"), F.when(geo, to_e7("longitude", 180)).alias("lon_e7"),
    ).filter("group_id is not null")
    bound = lambda f, c: F.coalesce(f(c), F.lit(0))
    return rows.groupBy("group_id").agg(
        F.count("*").alias("count"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"),
        bound(F.min, "lat_e7").alias("min_lat_e7"), bound(F.max, "lat_e7").alias("max_lat_e7"), bound(F.min, "lon_e7").alias("min_lon_e7"), bound(F.max, "lon_e7").alias("max_lon_e7"),
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("source_type")).alias("source_types"),
    )


def group_points(items: DataFrame, name: str = "asset_id") -> DataFrame:
    """(group_id, sequence, ts_sec, lat_e7, lon_e7, asset_id) of each located place in a group; name: the column that names an item.

    An item's locations count, with their own time first; its own group counts if none of them has one.
    """
    base = items.filter("latitude is not null and longitude is not null")
    own = base.filter(~F.exists("locations", lambda x: x["group_id"].isNotNull())).select(name, "latitude", "longitude", "group_id", "sequence", "timestamp_ms")
    each = base.select(name, "latitude", "longitude", F.col("timestamp_ms").alias("item_ms"), F.explode("locations").alias("l"))
    each = each.select(name, "latitude", "longitude", "l.group_id", "l.sequence", F.coalesce("l.timestamp_ms", "item_ms").alias("timestamp_ms"))
    found = each.unionByName(own).filter("group_id is not null and sequence is not null and timestamp_ms is not null")
    return found.select("group_id", "sequence", ms_to_sec("timestamp_ms").alias("ts_sec"), to_e7("latitude", 90).alias("lat_e7"), to_e7("longitude", 180).alias("lon_e7"), name)


def with_point_ranges(groups: DataFrame, points: DataFrame) -> DataFrame:
    """groups with n_points, first_sequence and last_sequence of their points; 0 and nulls if a group has none.

    Points are counted before they are shuffled, so the join has one row per group on each side. With group_points sorted by
    (group_id, sequence), the range bounds what a later read of a group has to scan.
    """
    ranges = points.groupBy("group_id").agg(F.count("*").alias("n_points"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))
    return groups.join(ranges, "group_id", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def matching_groups(groups: DataFrame, spec: SearchSpec) -> DataFrame:
    """Groups with a kind asked for, whose time and bounds meet the search's."""
    out = groups
    if spec.kind not in (None, "all"):
        kinds = MEDIA_KINDS if spec.kind == "media" else [k for k in KINDS if k == spec.kind]
        out = out.filter(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in kinds]).cast("array<string>")))
    if spec.start_ms is not None:
        out = out.filter(F.col("end_sec") >= spec.start_ms // 1000)
    if spec.end_ms is not None:
        out = out.filter(F.col("start_sec") <= spec.end_ms // 1000)
    if b := spec.bounds:
        out = out.filter((F.col("max_lat_e7") >= b.min_lat * 1e7) & (F.col("min_lat_e7") <= b.max_lat * 1e7) & (F.col("max_lon_e7") >= b.min_lon * 1e7) & (F.col("min_lon_e7") <= b.max_lon * 1e7))
    return out


def group_search(groups: DataFrame, spec: SearchSpec, limit: int = DEFAULT_GROUPS, probe: bool = False) -> DataFrame:
    """A page by (start, end, id), backwards for timestamp_desc; a limit of 0 is an empty page.

    probe adds one row to the page, if there is one: the limit was reached if the result has more than limit rows.
    """
    keys = ("start_sec", "end_sec", "group_id")
    order = [F.col(c).desc() if spec.order == "timestamp_desc" else F.col(c).asc() for c in keys]
    return matching_groups(groups, spec).orderBy(*order).offset(max(0, spec.offset)).limit(max(0, limit) + probe)

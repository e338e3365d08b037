"""Filters of a search as conjunctions of column predicates, so that Parquet statistics prune row groups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.values import MEDIA_KINDS
from cairn.plans.spec import Bounds, SearchSpec


def kind_is(kind: str | None) -> Column:
    if kind in (None, "all"):
        return F.lit(True)
    return F.col("kind").isin(*MEDIA_KINDS) if kind == "media" else F.col("kind") == kind


def geo_is(has_geo: bool | None) -> Column:
    there = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return F.lit(True) if has_geo is None else there if has_geo else ~there


def in_bounds(b: Bounds | None) -> Column:
    return F.lit(True) if b is None else F.col("latitude").between(b.min_lat, b.max_lat) & F.col("longitude").between(b.min_lon, b.max_lon)


def overlaps(start_ms: int | None, end_ms: int | None) -> Column:
    """An item's interval meets the range; an item without a time only passes without a range."""
    out = F.lit(True)
    if start_ms is not None:
        out = out & (F.coalesce("end_timestamp_ms", "timestamp_ms") >= start_ms) & F.col("timestamp_ms").isNotNull()
    return out & (F.col("timestamp_ms") <= end_ms) if end_ms is not None else out


def at_time(start_ms: int | None, end_ms: int | None) -> Column:
    """An item's own time is within the range."""
    out = F.lit(True)
    if start_ms is not None:
        out = out & (F.col("timestamp_ms") >= start_ms)
    return out & (F.col("timestamp_ms") <= end_ms) if end_ms is not None else out


def from_source(df: DataFrame, source_id: str | None) -> DataFrame:
    """Items that have a location in the source, narrowed to those locations, the first of which becomes primary."""
    if source_id is None or "locations" not in df.columns:
        return df if source_id is None else df.filter(F.col("source_id") == source_id)
    own = F.filter("locations", lambda x: x["source_id"] == source_id)
    df = df.filter(F.exists("locations", lambda x: x["source_id"] == source_id)).withColumn("locations", own)
    return df.withColumns({"source_id": F.lit(source_id), "relative_path": F.element_at("locations", 1)["relative_path"]})


def matching(df: DataFrame, spec: SearchSpec, points: bool = False) -> DataFrame:
    """Rows that pass all of a search's filters; points: by their own time and with coordinates, as distance asks for."""
    rule = kind_is(spec.kind) & in_bounds(spec.bounds)
    rule = rule & geo_is(True) & at_time(spec.start_ms, spec.end_ms) if points else rule & geo_is(spec.has_geo) & overlaps(spec.start_ms, spec.end_ms)
    return from_source(df, spec.source_id).filter(rule)


def searchable(df: DataFrame) -> DataFrame:
    """Items with a time or coordinates; others are in no index."""
    return df.filter(F.col("timestamp_ms").isNotNull() | geo_is(True))


def on_map(df: DataFrame, spec: SearchSpec, compat_map_start: bool = False) -> DataFrame:
    """Located items that a map shows: those whose interval meets the range. compat_map_start: where all kinds, visits or
    activities are asked for, what ended before the start is shown as well, as maps used to."""
    early = compat_map_start and spec.kind in (None, "all", "timeline_visit", "timeline_activity")
    return matching(df, replace(spec, has_geo=True, start_ms=None if early else spec.start_ms))

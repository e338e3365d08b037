"""Map bubbles: points counted in a grid of Web Mercator pixels, and the merging of bubbles that overlap."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.geo import lat_to_px, lon_to_px, px_to_lat, px_to_lon, world_px
from cairn.operators.components import connected_components
from cairn.operators.tables import saved
from cairn.plans.spec import DEFAULT_BUBBLES, MAX_BUBBLES


def cell_px(requested: float | None = None, width: float | None = None, height: float | None = None, limit: int | None = None) -> float:
    """The grid's cell: as asked for, and large enough that a viewport holds no more cells than the limit."""
    limit = max(1, min(MAX_BUBBLES, limit or DEFAULT_BUBBLES))
    return max(1.0, requested or 64.0, math.sqrt(max(1.0, width or 1024) * max(1.0, height or 768) / limit))


def bubble_grid(points: DataFrame, zoom: int, cell: float) -> DataFrame:
    """Per cell: id, count, mean and bounds of coordinates, the cell's centre, and the first point by (time, asset id)."""
    z = max(0, min(24, math.floor(zoom)))
    last = math.ceil(world_px(z) / cell) - 1

    def index(px: Column) -> Column:
        return F.least(F.greatest(F.floor(px / cell), F.lit(0)), F.lit(last)).cast("long")

    cells = points.withColumns({"cx": index(lon_to_px("longitude", z)), "cy": index(lat_to_px("latitude", z))})
    first = F.min_by(F.struct("asset_id", "kind", "timestamp_ms"), F.struct(F.coalesce("timestamp_ms", F.lit(0)), "asset_id"))
    out = cells.groupBy("cx", "cy").agg(
        F.count("*").alias("count"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        first.alias("first"),
    )
    middle = lambda c: (F.col(c) + 0.5) * cell
    out = out.withColumns({"cell_id": F.concat_ws("/", F.lit(z), "cx", "cy"), "center_lat": px_to_lat(middle("cy"), z), "center_lon": px_to_lon(middle("cx"), z)})
    for c in ("asset_id", "kind", "timestamp_ms"):
        out = out.withColumn(c, F.when(F.col("count") == 1, F.col(f"first.{c}")))
    return out.drop("first")


def capped(bubbles: DataFrame, limit: int | None = None) -> DataFrame:
    """The bubbles with the highest counts; of equal ones those with the smallest cell ids."""
    return bubbles.orderBy(F.desc("count"), "cell_id").limit(max(1, min(MAX_BUBBLES, limit or DEFAULT_BUBBLES)))


def bubble_summary(bubbles: DataFrame) -> DataFrame:
    return bubbles.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("matched"), F.count("*").alias("bubbles"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"))


def bubble_radius(count: np.ndarray, scale: float) -> np.ndarray:
    steps = np.select([count <= 1, count < 10, count < 100, count < 1000], [8, 10, 12, 15], 18)
    return steps * max(scale, 0.1) + 2


def radius(count: Column, scale: float) -> Column:
    """bubble_radius as a column."""
    return F.when(count <= 1, 8).when(count < 10, 10).when(count < 100, 12).when(count < 1000, 15).otherwise(18) * F.lit(float(max(scale, 0.1))) + 2


_MERGED = ("cell_id", "count", "latitude", "longitude", "min_lat", "max_lat", "min_lon", "max_lon", "asset_id")


def _touching(b: DataFrame, zoom: int, scale: float) -> DataFrame:
    """(a, b): ids of the bubbles whose circles touch; each meets those of its own and the eight squares around it."""
    k = max(scale, 0.1)
    square = 2 * (18 * k + 2)  # of the side of the largest circle
    at = b.select("id", lon_to_px("longitude", zoom).alias("x"), lat_to_px("latitude", zoom).alias("y"), radius(F.col("count"), scale).alias("r"))
    at = at.withColumns({"gx": F.floor(F.col("x") / square), "gy": F.floor(F.col("y") / square)})
    near = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    other = at.select(F.col("id").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("r").alias("q"), near.alias("g")).select("b", "u", "v", "q", "g.*")
    return at.join(other, ["gx", "gy"]).filter("id < b").filter(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v")) < F.col("r") + F.col("q")).select(F.col("id").alias("a"), "b")


def merge_overlapping(bubbles: DataFrame, zoom: int, scale: float = 1.0) -> DataFrame:
    """Bubbles whose circles touch become one, again and again until none do; a cap comes after it, as no point may be lost.

    A merged bubble stands at the mean of its points and has the id of its fullest part (of equal ones the smallest id).
    """
    b = bubbles.select(*_MERGED)
    while True:
        b = saved(b.withColumn("id", F.monotonically_increasing_id()))  # saved, so that ids stay as they are
        edges = saved(_touching(b, zoom, scale))
        if edges.isEmpty():
            return b.select(*_MERGED)
        own = b.join(connected_components(edges), "id", "left").groupBy(F.coalesce("component", "id").alias("component"))
        alone = F.count("*") == 1
        mean = {c: F.when(alone, F.min(c)).otherwise(F.sum(F.col(c) * F.col("count")) / F.sum("count")).alias(c) for c in ("latitude", "longitude")}
        b = own.agg(
            F.min_by("cell_id", F.struct(-F.col("count"), F.col("cell_id"))).alias("cell_id"), *mean.values(), F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"),
            F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon"), F.when(alone, F.min("asset_id")).alias("asset_id"), F.sum("count").alias("count"),
        ).select(*_MERGED)

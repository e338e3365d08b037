"""Trip lines: runs of consecutive points, removal of jumps, splits by distance and speed, polylines and map tiles.

Points: group_id, sequence, ts_sec, latitude, longitude, asset_id. Order in a group: (sequence, ts_sec, asset_id), null
sequences last. Points without a group are on no line.

A trip of up to BLOCK_POINTS points is scanned by one task. Longer ones are cut into blocks of that order (block_), which
tasks scan apart; what a block hands on to the next (its last point, its open run and segment) is one row a block, folded
in order and joined back. So no window or array holds a long trip.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cairn.functions.geo import TILE_PX, haversine_m, lat_to_px, lon_to_px, px_to_lat, px_to_lon, speed_kmh
from cairn.operators.tables import saved

#: Points of a trip that one task scans.
BLOCK_POINTS = 1_000_000
#: Tasks that cut long trips, at least, if there are so many blocks.
CUTS = 64
#: Set for points of long trips only, and there only if there is one.
BLOCK = "block_"


def _place() -> list[Column]:
    return [F.col("sequence").asc_nulls_last(), F.col("ts_sec").asc(), F.col("asset_id").asc()]


def _key() -> Column:
    """The order as a value."""
    return F.struct(F.coalesce("sequence", F.lit(1 << 62)).alias("s"), F.col("ts_sec").alias("t"), F.col("asset_id").alias("i"))


def _within(df: DataFrame, *keys: str) -> WindowSpec:
    """Points of a trip, or of a block of it, with equal keys."""
    return Window.partitionBy("group_id", *[BLOCK] * (BLOCK in df.columns), *keys)


def _ordered(df: DataFrame, *keys: str) -> WindowSpec:
    return _within(df, *keys).orderBy(*_place())


_BEFORE, _AFTER, _SO_FAR = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing), (Window.unboundedPreceding, 0)


def _blocks(df: DataFrame) -> DataFrame:
    """The points of long trips, for what blocks hand on."""
    return df.filter(F.col(BLOCK) > 0)


def _handed(df: DataFrame, small: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """df with the columns names of small: at most a few rows a block, so it is broadcast."""
    return df.join(F.broadcast(saved(small.select("group_id", BLOCK, *keys, *names))), ["group_id", BLOCK, *keys], "left")


def _neighbour(df: DataFrame, value: Column, name: str, keys: list[str], ahead: bool = False) -> DataFrame:
    """df with name: the nearest value that isn't null before each point (or ahead of it) among points with equal keys of its trip.

    keys are 0-based numbers that grow along the trip. Ahead, value may not be null: Spark would look for one anew from each row.
    """
    pick, span = (F.first, _AFTER) if ahead else (F.last, _BEFORE)
    own = F.lead(value).over(_ordered(df, *keys)) if ahead else F.last(value, ignorenulls=True).over(_ordered(df, *keys).rowsBetween(*span))
    if BLOCK not in df.columns:
        return df.withColumn(name, own)
    there = F.when(value.isNotNull(), F.struct(value.alias("v"), *keys))
    edge = (F.min_by if ahead else F.max_by)(there, F.when(value.isNotNull(), _key()))
    edges = _blocks(df).groupBy("group_id", BLOCK).agg(edge.alias("edge"))
    edges = edges.withColumn("handed_", pick("edge", ignorenulls=True).over(Window.partitionBy("group_id").orderBy(BLOCK).rowsBetween(*span)))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"handed_.{k}") == F.col(k))
    return _handed(df, edges, [], "handed_").withColumn(name, F.coalesce(own, F.when(same, F.col("handed_.v")))).drop("handed_")


def _running(df: DataFrame, flag: Column, name: str, keys: list[str]) -> DataFrame:
    """df with name: how often flag holds from the first point with equal keys of its trip up to each point."""
    out = df.withColumn(name, F.sum(flag.cast("long")).over(_ordered(df, *keys).rowsBetween(*_SO_FAR)))
    if BLOCK not in df.columns:
        return out
    sums = _blocks(df).groupBy("group_id", BLOCK, *keys).agg(F.sum(flag.cast("long")).alias("n_"))
    sums = sums.withColumn("handed_", F.sum("n_").over(Window.partitionBy("group_id", *keys).orderBy(BLOCK).rowsBetween(*_BEFORE))).filter("handed_ > 0")
    return _handed(out, sums, keys, "handed_").withColumn(name, F.col(name) + F.coalesce("handed_", F.lit(0))).drop("handed_")


def _count(df: DataFrame, flag: Column, name: str, keys: list[str]) -> DataFrame:
    """df with name: for how many points with equal keys of the trip flag holds."""
    out = df.withColumn(name, F.sum(flag.cast("long")).over(_within(df, *keys)))
    if BLOCK not in df.columns:
        return out
    whole = Window.partitionBy("group_id", *keys)
    sums = _blocks(df).groupBy("group_id", BLOCK, *keys).agg(F.sum(flag.cast("long")).alias("n_"))
    sums = sums.withColumns({"handed_": F.sum("n_").over(whole), "b_": F.count("*").over(whole)}).filter("b_ > 1")  # those in several blocks
    return _handed(out, sums, keys, "handed_").withColumn(name, F.coalesce("handed_", name)).drop("handed_")


def line_points(items: DataFrame, sources: list[str] | None = None, max_accuracy_m: float | None = None) -> DataFrame:
    """Items that can be on a line. The quality filters are off unless asked for."""
    out = items.filter("latitude is not null and longitude is not null and group_id is not null and sequence >= 0")
    out = out.filter(F.col("kind") == "geo_point") if "kind" in items.columns else out
    out = out.filter(F.col("line_source").isin(sources)) if sources else out
    return out.filter(F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= max_accuracy_m)) if max_accuracy_m is not None else out


def in_blocks(points: DataFrame, block_points: int) -> DataFrame:
    """points, with block_ if there are trips of more than block_points: their blocks, from 1 on; 0 for those of other trips."""
    sizes = points.groupBy("group_id").agg(F.count("*").alias("n")).filter(F.col("n") > block_points).collect()  # fewer than points / block_points
    if not sizes:
        return points
    long = F.col("group_id").isin([r["group_id"] for r in sizes])
    n = sum(r["n"] for r in sizes)
    # A task cuts several blocks if they are small: tasks and the sample of their bounds would pass through the driver.
    k = math.ceil(n / max(block_points, min(BLOCK_POINTS, n // CUTS))) + 1
    order = [F.col("group_id").asc(), *_place()]
    part = points.filter(long).repartitionByRange(k, *order).sortWithinPartitions(*order)
    at, task = F.monotonically_increasing_id(), F.spark_partition_id().cast("long")  # at: the task's number above 33 bits of the place
    cut = part.withColumn(BLOCK, F.shiftleft(task, 33) + F.floor((at - F.shiftleft(task, 33)) / block_points) + 1)
    return points.filter(~long).withColumn(BLOCK, F.lit(0).cast("long")).unionByName(saved(cut))  # saved: a second cut may differ


def with_runs(points: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """points with run (0-based, per group) and run_points: a run ends where the next sequence isn't one more."""
    points = in_blocks(points.filter("group_id is not null"), block_points)
    out = _neighbour(points, F.struct("sequence"), "before_", [])
    new = F.coalesce(F.col("sequence") != F.col("before_.sequence") + 1, F.lit(True))
    out = _running(out, new, "run", []).withColumn("run", F.col("run") - 1).drop("before_")
    return _count(out, F.lit(True), "run_points", ["run"])


def _here() -> Column:
    return F.struct(F.col("ts_sec").alias("ts"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def _metres(a: str, b: str) -> Column:
    return haversine_m(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))


def _speed(a: str, b: str) -> Column:
    """km/h between two structs (ts, lat, lon)."""
    return speed_kmh(_metres(a, b), F.col(f"{b}.ts") - F.col(f"{a}.ts"))


def with_jumps(runs: DataFrame, limit_kmh: float | None) -> DataFrame:
    """runs with jump: a point that is reached and left too fast, while its neighbours are near each other."""
    if limit_kmh is None:
        return runs.withColumn("jump", F.lit(False))
    out = _neighbour(_neighbour(runs, _here(), "prev", ["run"]), _here(), "next", ["run"], ahead=True).withColumn("here", _here())
    jump = (_speed("prev", "here") > limit_kmh) & (_speed("here", "next") > limit_kmh) & (_speed("prev", "next") <= limit_kmh)
    jump = F.when(F.col("prev").isNull() | F.col("next").isNull(), F.lit(False)).otherwise(jump)
    return out.withColumn("jump", jump).drop("here", "prev", "next")


def _segmented(runs: DataFrame, max_distance_km: float | None, break_speed_kmh: float | None) -> DataFrame:
    """All points of runs, with kept (on a line), from (the point before on the line), both breaks, segment and segment_points."""
    out = with_jumps(runs, break_speed_kmh).withColumn("kept", (F.col("run_points") >= 2) & ~F.col("jump"))
    out = _neighbour(out, F.when(F.col("kept"), _here()), "from", ["run"])
    out = out.withColumn("here", _here())
    off = F.lit(False)
    distance = F.coalesce(F.col("kept") & (_metres("from", "here") > max_distance_km * 1000), off) if max_distance_km is not None else off
    fast = F.coalesce(F.col("kept") & (_speed("from", "here") > break_speed_kmh), off) if break_speed_kmh is not None else off
    out = out.withColumn("distance_break", distance)
    out = out.withColumn("speed_break", ~F.col("distance_break") & fast)
    breaks = F.col("distance_break") | F.col("speed_break")
    out = _running(out, breaks, "segment", ["run"]).withColumn("from", F.when(~breaks, F.col("from")))
    return _count(out, F.col("kept"), "segment_points", ["run", "segment"]).drop("here")


def with_segments(runs: DataFrame, max_distance_km: float | None = None, break_speed_kmh: float | None = None) -> DataFrame:
    """Lines' points without jumps, with segment (0-based, per run), segment_points, the flags of the two kinds of breaks, and
    from: the point before in the segment (null for its first one)."""
    return _segmented(runs, max_distance_km, break_speed_kmh).filter("kept").drop("jump", "kept")


def polylines(segmented: DataFrame) -> DataFrame:
    """One row per segment of two points or more: its points in order and its bounds. For long segments see polyline_parts()."""
    return _lines(segmented.filter("segment_points >= 2"), "group_id", "run", "segment")


def polyline_parts(segmented: DataFrame, points: int = 10_000) -> DataFrame:
    """As polylines(), in parts (0-based) of at most so many points each; a part begins with the point after the last of the one before."""
    placed = _running(segmented.filter("segment_points >= 2"), F.lit(True), "place_", ["run", "segment"])
    return _lines(placed.withColumn("part", F.floor((F.col("place_") - 1) / points)), "group_id", "run", "segment", "part")


def _lines(rows: DataFrame, *keys: str) -> DataFrame:
    at = F.struct(_key().alias("k"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    out = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(at)).alias("p"), F.count("*").alias("n_points"), F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
    )
    return out.withColumn("points", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))).drop("p")


def line_metrics(points: DataFrame, max_distance_km: float | None = None, break_speed_kmh: float | None = None, block_points: int = BLOCK_POINTS) -> DataFrame:
    """One row: matched, accepted (points on lines), jumps, distance and speed breaks, segments and rendered points."""
    rows, line = _segmented(with_runs(points, block_points), max_distance_km, break_speed_kmh), F.col("segment_points") >= 2
    total = lambda flag: F.coalesce(F.sum(flag.cast("long")), F.lit(0))
    return rows.agg(
        F.count("*").alias("matched"), total(F.col("run_points") >= 2).alias("accepted"), total(F.col("jump")).alias("jumps"), total(F.col("distance_break")).alias("distance_breaks"), total(F.col("speed_break")).alias("speed_breaks"),
        total(F.col("kept") & F.col("from").isNull() & line).alias("segments"), total(F.col("kept") & line).alias("rendered"),
    )


def tile_segments(lines: DataFrame, zoom: int, gutter_px: int = 12) -> DataFrame:
    """(x, y) tiles at a zoom that each line's bounds, widened by the gutter, meet; lines are dealt to tiles, then joined by key."""
    last = (1 << zoom) - 1

    def tile(px: Column, shift: int) -> Column:
        return F.least(F.greatest(F.floor((px + shift) / 256), F.lit(0)), F.lit(last)).cast("long")

    x1, x2 = tile(lon_to_px("min_lon", zoom), -gutter_px), tile(lon_to_px("max_lon", zoom), gutter_px)
    y1, y2 = tile(lat_to_px("max_lat", zoom), -gutter_px), tile(lat_to_px("min_lat", zoom), gutter_px)
    out = lines.withColumn("x", F.explode(F.sequence(x1, x2))).withColumn("y", F.explode(F.sequence(y1, y2)))
    pixels = F.transform("points", lambda p: F.struct((lon_to_px(p["lon"], zoom) - F.col("x") * 256).alias("px"), (lat_to_px(p["lat"], zoom) - F.col("y") * 256).alias("py")))
    return out.withColumn("z", F.lit(zoom)).withColumn("pixels", pixels)


# --- tiles of edges: lines between consecutive points, clipped

def line_edges(segmented: DataFrame, zoom: int) -> DataFrame:
    """(group_id, run, segment, asset_id: of its end, x1, y1, x2, y2) of each edge of a segment, in world pixels."""
    rows = segmented.filter(F.col("from").isNotNull())
    return rows.select("group_id", "run", "segment", "asset_id", lon_to_px("from.lon", zoom).alias("x1"), lat_to_px("from.lat", zoom).alias("y1"), lon_to_px("longitude", zoom).alias("x2"), lat_to_px("latitude", zoom).alias("y2"))


def _tiles(low: Column, high: Column, zoom: int, gutter_px: int) -> Column:
    """The numbers of the tiles that meet a range of pixels."""
    last = (1 << zoom) - 1
    at = lambda px: F.greatest(F.least(F.floor(px / TILE_PX), F.lit(last)), F.lit(0))
    return F.sequence(at(low - gutter_px), at(high + gutter_px))


def _share(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """From which to which part of a line from a to b it is between low and high: of what is parallel, all of it."""
    d = b - a
    p, q = (low - a) / F.nullif(d, F.lit(0.0)), (high - a) / F.nullif(d, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(p, q)), F.least(F.lit(1.0), F.greatest(p, q))


def _clipped(edges: DataFrame, gutter_px: int) -> DataFrame:
    """edges with a tile (x, y) as its pixels px1, py1, px2, py2: the part within the tile and its gutter (Liang and Barsky)."""
    low = {c: F.col(c) * TILE_PX - gutter_px for c in ("x", "y")}
    high = {c: (F.col(c) + 1) * TILE_PX + gutter_px for c in ("x", "y")}
    (xs, xe), (ys, ye) = (_share(F.col(f"{c}1"), F.col(f"{c}2"), low[c], high[c]) for c in ("x", "y"))
    outside = F.lit(False)
    for c in ("x", "y"):  # a parallel line may be outside altogether
        outside = outside | (F.greatest(f"{c}1", f"{c}2") < low[c]) | (F.least(f"{c}1", f"{c}2") > high[c])
    rows = edges.withColumns({"t1": F.greatest(xs, ys), "t2": F.least(xe, ye)}).filter(~outside & (F.col("t1") <= F.col("t2")))
    at = lambda c, t: F.col(f"{c}1") + F.col(t) * (F.col(f"{c}2") - F.col(f"{c}1")) - F.col(c) * TILE_PX
    pixels = {f"p{c}{k}": at(c, f"t{k}") for k in (1, 2) for c in ("x", "y")}
    return rows.withColumns(pixels).drop("x1", "y1", "x2", "y2", "t1", "t2")


def tile_edges(segmented: DataFrame, zoom: int, gutter_px: int = 12) -> DataFrame:
    """A row for each edge and tile (z, x, y) that it crosses, gutters included, with its pixels in the tile.

    An edge is dealt to the columns of tiles that it crosses, and from each to the tiles that its part there meets: as many rows
    as tiles crossed, whatever its bounds.
    """
    edges = line_edges(segmented, zoom)
    across = edges.withColumn("x", F.explode(_tiles(F.least("x1", "x2"), F.greatest("x1", "x2"), zoom, gutter_px)))
    start, end = _share(F.col("x1"), F.col("x2"), F.col("x") * TILE_PX - gutter_px, (F.col("x") + 1) * TILE_PX + gutter_px)
    y = lambda t: F.col("y1") + t * (F.col("y2") - F.col("y1"))
    down = across.withColumn("y", F.explode(_tiles(F.least(y(start), y(end)), F.greatest(y(start), y(end)), zoom, gutter_px)))
    return _clipped(down.withColumn("z", F.lit(zoom)), gutter_px)


def one_tile(segmented: DataFrame, zoom: int, x: int, y: int, gutter_px: int = 12) -> DataFrame:
    """tile_edges() of one tile: edges whose bounds miss it are left out first."""
    rows = segmented.filter(F.col("from").isNotNull())
    west, east = (px_to_lon(F.lit(float((x + k) * TILE_PX + s * gutter_px)), zoom) for k, s in ((0, -1), (1, 1)))
    north, south = (px_to_lat(F.lit(float((y + k) * TILE_PX + s * gutter_px)), zoom) for k, s in ((0, -1), (1, 1)))
    meets = (F.greatest("from.lon", "longitude") >= west - 1e-9) & (F.least("from.lon", "longitude") <= east + 1e-9)
    # Beyond the map's latitudes all is on its border.
    last = (1 << zoom) - 1
    meets = meets & (F.lit(y == last) | (F.greatest("from.lat", "latitude") >= south - 1e-9)) & (F.lit(y == 0) | (F.least("from.lat", "latitude") <= north + 1e-9))
    edges = line_edges(rows.filter(meets), zoom).withColumns({"z": F.lit(zoom), "x": F.lit(x).cast("long"), "y": F.lit(y).cast("long")})
    return _clipped(edges, gutter_px)

"""Registered catalog queries and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import geo, values
from cairn.operators import bubbles, catalog, groups, lines, search
from cairn.plans.spec import Bounds, SearchSpec
from cairn.plans.views import GEO_SQL, OCC_SQL, TRIP_SQL, geo_events, occurrences, sources, trip_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# Fixed times within the events' month.
T1, T2 = 1_704_600_000_000, 1_705_300_000_000
R = "CAST(6371008.8 AS DOUBLE)"


def _haversine(lat1, lon1, lat2, lon2) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * {R} * asin(CASE WHEN {a} > 1 THEN CAST(1 AS DOUBLE) ELSE sqrt({a}) END)"


def _d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


# --- nearest neighbours

def _knn(name: str, lat: float, lon: float, where: str = "", snap: float | None = None, **spec) -> None:
    s = SearchSpec(order="distance", center=(lat, lon), **{"limit": 50, **spec})

    def run(spark: SparkSession, d: str) -> DataFrame:
        points = geo_events(spark, d)
        if snap:  # many points on one place
            points = points.withColumns({c: F.floor(F.col(c) / snap) * snap for c in ("latitude", "longitude")})
        return search.knn_page(points, s).select("media_id", "kind", "timestamp_ms", F.round("distance_m", 3).alias("distance_m"))

    at = [f"floor({c} / {_d(snap)}) * {_d(snap)}" if snap else c for c in ("latitude", "longitude")]
    _add(name, run, f"""WITH {GEO_SQL}, p AS (SELECT media_id, kind, timestamp_ms, {at[0]} AS latitude, {at[1]} AS longitude FROM ge),
      k AS (SELECT *, {_haversine(_d(lat), _d(lon), 'latitude', 'longitude')} AS d FROM p WHERE latitude IS NOT NULL AND longitude IS NOT NULL {where})
      SELECT media_id, kind, timestamp_ms, round(d, 3) AS distance_m FROM k ORDER BY round(d, 6), media_id LIMIT {s.limit} OFFSET {s.offset}""")


_knn("knn_basic", 47.3769, 8.5417)
_knn("knn_kind_media", 47.3769, 8.5417, "AND kind IN ('image', 'video')", kind="media")
_knn("knn_time", 47.3769, 8.5417, f"AND timestamp_ms BETWEEN {T1} AND {T2}", start_ms=T1, end_ms=T2)
_knn("knn_bounds", 47.3769, 8.5417, "AND latitude BETWEEN -10 AND 40 AND longitude BETWEEN -20 AND 40", bounds=Bounds(-10, -20, 40, 40))
_knn("knn_offset_page", 47.3769, 8.5417, offset=75)
_knn("knn_antimeridian", 0, 179.95)
_knn("knn_polar", 89.9, 15)
_knn("knn_duplicates", 12, 34, snap=10.0)


# --- time pages

def _time(name: str, where: str = "", probe: bool = False, **spec) -> None:
    s = SearchSpec(**{"limit": 200, **spec})
    up = "ASC" if s.order == "timestamp_asc" else "DESC"
    cols = ["asset_id", "media_id", "kind", "ts_sec", "latitude", "longitude"]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.time_page(geo_events(spark, d), s, probe).select(*cols)

    _add(name, run, f"""WITH {GEO_SQL}, k AS (SELECT *, coalesce(timestamp_ms // 1000, 0) AS ts_sec FROM ge
      WHERE (timestamp_ms IS NOT NULL OR (latitude IS NOT NULL AND longitude IS NOT NULL)) {where})
      SELECT {', '.join(cols)} FROM k ORDER BY ts_sec {up}, asset_id {up} LIMIT {s.limit + probe} OFFSET {s.offset}""")


_time("time_page_desc")
_time("time_page_asc", order="timestamp_asc", offset=100)
_time("time_page_kind", "AND kind = 'video'", kind="video")
_time("time_page_bounds", "AND latitude BETWEEN 0 AND 50 AND longitude BETWEEN -20 AND 60", bounds=Bounds(0, -20, 50, 60))
_time("time_page_interval_overlap", f"AND coalesce(end_timestamp_ms, timestamp_ms) >= {T1} AND timestamp_ms <= {T2}", start_ms=T1, end_ms=T2, limit=10_000)
_time("time_page_hasgeo_false", "AND (latitude IS NULL OR longitude IS NULL)", has_geo=False)
_time("time_page_probe", probe=True, limit=10_000)

_add("list_media_ms_order", lambda s, d: search.list_media(geo_events(s, d), SearchSpec(order="timestamp_asc", limit=700)).select("media_id", "timestamp_ms"),
     f"WITH {GEO_SQL} SELECT media_id, timestamp_ms FROM ge ORDER BY timestamp_ms ASC NULLS FIRST, media_id LIMIT 700")
_add("geo_points_range", lambda s, d: search.geo_points(geo_events(s, d), T1, T2),
     f"WITH {GEO_SQL} SELECT media_id, kind, latitude, longitude, timestamp_ms FROM ge WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND timestamp_ms BETWEEN {T1} AND {T2}")
_add("count_media", lambda s, d: geo_events(s, d).agg(F.count("*").alias("n")), f"WITH {GEO_SQL} SELECT count(*) AS n FROM ge")
_add("kind_histogram", lambda s, d: search.kind_counts(geo_events(s, d)), f"WITH {GEO_SQL} SELECT kind, count(*) AS n, count(latitude) AS n_geo, count(timestamp_ms) AS n_time FROM ge GROUP BY kind")


# --- lookups: ids asked for in their own order, some twice, some missing

def _ids(s: SparkSession, key: str) -> DataFrame:
    i = s.range(300).withColumn("want", (F.col("id") * 7919) % 12000)
    want = F.concat(F.lit("media-"), F.lpad(F.col("want").cast("string"), 7, "0")) if key == "media_id" else F.col("want")
    return i.select(want.alias(key), F.col("id").alias("pos"))


for _key, _name, _want in (("media_id", "lookup_by_ids_order", "'media-' || lpad(CAST((range * 7919) % 12000 AS VARCHAR), 7, '0')"), ("asset_id", "lookup_by_asset_ids", "(range * 7919) % 12000")):
    _add(_name, lambda s, d, k=_key: search.lookup(geo_events(s, d), _ids(s, k), k).select("pos", "asset_id", "media_id", "kind"),
         f"WITH {GEO_SQL}, i AS (SELECT range AS pos, {_want} AS w FROM range(300)) SELECT pos, asset_id, media_id, kind FROM ge JOIN i ON ge.{_key} = i.w")

_add("upsert_points", lambda s, d: search.upsert(geo_events(s, d).select("media_id", "latitude"), geo_events(s, d).filter("asset_id % 10 = 0").select("media_id", F.lit(1.5).alias("latitude"))),
     f"WITH {GEO_SQL} SELECT media_id, CASE WHEN asset_id % 10 = 0 THEN CAST(1.5 AS DOUBLE) ELSE latitude END AS latitude FROM ge")
_add("remove_points", lambda s, d: search.remove(geo_events(s, d).select("media_id"), geo_events(s, d).filter("asset_id % 10 = 0").select("media_id")),
     f"WITH {GEO_SQL} SELECT media_id FROM ge WHERE asset_id % 10 <> 0")


# --- bubbles

def _grid_sql(zoom: int, cell: float, where: str = "") -> str:
    w, last = _d(geo.world_px(zoom)), -(-geo.world_px(zoom) // cell) - 1
    s = f"sin(radians(greatest(least(latitude, {_d(geo.MAX_MERCATOR_LAT)}), {_d(-geo.MAX_MERCATOR_LAT)})))"
    x, y = f"(longitude + 180) / 360 * {w}", f"(0.5 - ln((1 + {s}) / (1 - {s})) / (4 * pi())) * {w}"
    index = lambda p: f"CAST(least(greatest(floor(({p}) / {_d(cell)}), 0), {int(last)}) AS BIGINT)"
    return f"""{GEO_SQL}, c AS (SELECT *, {index(x)} AS cx, {index(y)} AS cy FROM ge WHERE latitude IS NOT NULL AND longitude IS NOT NULL {where}),
      g AS (SELECT '{zoom}/' || cx || '/' || cy AS cell_id, cx, cy, count(*) AS count, round(avg(latitude), 9) AS latitude, round(avg(longitude), 9) AS longitude,
        min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon, CASE WHEN count(*) = 1 THEN min(asset_id) END AS asset_id FROM c GROUP BY cx, cy)"""


_BUBBLE = ["cell_id", "count", "latitude", "longitude", "min_lat", "max_lat", "min_lon", "max_lon", "asset_id"]


def _grid(s: SparkSession, d: str, zoom: int, cell: float, kind: str | None = None) -> DataFrame:
    from cairn.operators.predicates import matching

    found = bubbles.bubble_grid(matching(geo_events(s, d), SearchSpec(kind=kind), points=True), zoom, cell)
    return found.withColumns({c: F.round(c, 9) for c in ("latitude", "longitude")})


_VIEW = bubbles.cell_px(None, 800, 600, 200)
for _name, _zoom, _cell, _kind, _where in (("bubbles_z2", 2, 64.0, None, ""), ("bubbles_z4", 4, 64.0, "media", "AND kind IN ('image', 'video')"), ("bubbles_viewport_budget", 3, _VIEW, None, "")):
    _add(_name, lambda s, d, z=_zoom, c=_cell, k=_kind: _grid(s, d, z, c, k).select(*_BUBBLE), f"WITH {_grid_sql(_zoom, _cell, _where)} SELECT {', '.join(_BUBBLE)} FROM g")
_add("bubbles_cell_center", lambda s, d: _grid(s, d, 4, 64.0).select("cell_id", F.round("center_lat", 6).alias("center_lat"), F.round("center_lon", 6).alias("center_lon")),
     f"""WITH {_grid_sql(4, 64.0)} SELECT cell_id, round(degrees(atan((exp(pi() * (1 - 2 * (cy + 0.5) * 64 / {_d(geo.world_px(4))})) - exp(-pi() * (1 - 2 * (cy + 0.5) * 64 / {_d(geo.world_px(4))}))) / 2)), 6) AS center_lat,
      round((cx + 0.5) * 64 / {_d(geo.world_px(4))} * 360 - 180, 6) AS center_lon FROM g""")
_add("bubbles_capped", lambda s, d: bubbles.capped(_grid(s, d, 4, 64.0), 40).select("cell_id", "count"), f"WITH {_grid_sql(4, 64.0)} SELECT cell_id, count FROM g ORDER BY count DESC, cell_id LIMIT 40")
_add("bubbles_summary", lambda s, d: bubbles.bubble_summary(_grid(s, d, 3, 64.0)), f"WITH {_grid_sql(3, 64.0)} SELECT CAST(sum(count) AS BIGINT) AS matched, count(*) AS bubbles, max(count) AS largest FROM g")
_add("bubbles_merged", lambda s, d: bubbles.capped(bubbles.merge_overlapping(_grid(s, d, 4, 64.0), 4, 1.5), 500))


# --- groups

def _members(s: SparkSession, d: str) -> DataFrame:
    return geo_events(s, d).withColumns({"source_type": F.col("event_type"), "group_ids": F.array(F.concat(F.lit("trip-"), F.col("user_id").cast("string")))})


def _e7_sql(col: str, bound: int) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN CAST(floor(greatest(least({col}, {bound}), -{bound}) * CAST(1e7 AS DOUBLE) + 0.5) AS INTEGER) END"


_GROUP_SQL = f"""{GEO_SQL}, g AS (SELECT 'trip-' || user_id AS group_id, count(*) AS count, min(timestamp_ms // 1000) AS start_sec, max(coalesce(end_timestamp_ms, timestamp_ms) // 1000) AS end_sec,
  coalesce(min({_e7_sql('latitude', 90)}), 0) AS min_lat_e7, coalesce(max({_e7_sql('latitude', 90)}), 0) AS max_lat_e7, coalesce(min({_e7_sql('longitude', 180)}), 0) AS min_lon_e7, coalesce(max({_e7_sql('longitude', 180)}), 0) AS max_lon_e7,
  string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS source_types FROM ge WHERE timestamp_ms IS NOT NULL GROUP BY user_id)"""
_GROUP = ["group_id", "count", "start_sec", "end_sec", "min_lat_e7", "max_lat_e7", "min_lon_e7", "max_lon_e7", "kinds", "source_types"]


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in ("kinds", "source_types")}).select(*_GROUP)


_add("group_summary", lambda s, d: _flat(groups.group_summary(_members(s, d))), f"WITH {_GROUP_SQL} SELECT {', '.join(_GROUP)} FROM g")
for _name, _spec, _where, _up in (
    ("group_search_desc", SearchSpec(), "TRUE", "DESC"),
    ("group_search_time", SearchSpec(kind="video", start_ms=T1, end_ms=T2, order="timestamp_asc", offset=3), f"list_contains(string_split(kinds, ','), 'video') AND end_sec >= {T1 // 1000} AND start_sec <= {T2 // 1000}", "ASC"),
    ("group_search_bounds", SearchSpec(bounds=Bounds(60, 100, 90, 180), order="timestamp_asc"), "max_lat_e7 >= 600000000 AND min_lat_e7 <= 900000000 AND max_lon_e7 >= 1000000000 AND min_lon_e7 <= 1800000000", "ASC"),
):
    _add(_name, lambda s, d, q=_spec: _flat(groups.group_search(groups.group_summary(_members(s, d)), q)),
         f"WITH {_GROUP_SQL} SELECT {', '.join(_GROUP)} FROM g WHERE {_where} ORDER BY start_sec {_up}, end_sec {_up}, group_id {_up} LIMIT 50 OFFSET {_spec.offset}")


def _group_points(s: SparkSession, d: str) -> DataFrame:
    t = trip_points(s, d).withColumns({"timestamp_ms": F.col("ts_sec") * 1000, "locations": F.array().cast(f"array<{catalog.LOCATION.simpleString()}>")})
    return groups.group_points(t)


_add("group_points", _group_points, f"WITH {TRIP_SQL} SELECT group_id, sequence, ts_sec, {_e7_sql('latitude', 90)} AS lat_e7, {_e7_sql('longitude', 180)} AS lon_e7, asset_id FROM tp")


_add("group_point_ranges", lambda s, d: groups.with_point_ranges(groups.group_summary(_members(s, d)), _group_points(s, d).filter("asset_id % 3 = 0")).select("group_id", "count", "n_points", "first_sequence", "last_sequence"),
     f"""WITH {_GROUP_SQL}, {TRIP_SQL}, r AS (SELECT group_id, count(*) AS n, min(sequence) AS a, max(sequence) AS b FROM tp WHERE asset_id % 3 = 0 GROUP BY group_id)
  SELECT g.group_id, g.count, coalesce(r.n, 0) AS n_points, r.a AS first_sequence, r.b AS last_sequence FROM g LEFT JOIN r ON g.group_id = r.group_id""")
_add("group_search_probe", lambda s, d: _flat(groups.group_search(groups.group_summary(_members(s, d)), SearchSpec(order="timestamp_asc"), 5, probe=True)),
     f"WITH {_GROUP_SQL} SELECT {', '.join(_GROUP)} FROM g ORDER BY start_sec, end_sec, group_id LIMIT 6")


# --- lines

_W = "PARTITION BY group_id ORDER BY sequence, ts_sec, asset_id"
_WR = "PARTITION BY group_id, run ORDER BY sequence, ts_sec, asset_id"
SPEED, DISTANCE = 20.0, 60.0
_RUN_SQL = f"""{TRIP_SQL}, r0 AS (SELECT *, CASE WHEN sequence = lag(sequence) OVER ({_W}) + 1 THEN 0 ELSE 1 END AS b FROM tp),
  r1 AS (SELECT *, CAST(sum(b) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS run FROM r0), r AS (SELECT *, count(*) OVER (PARTITION BY group_id, run) AS run_points FROM r1)"""


def _speed_sql(a: str, b: str) -> str:
    h = _haversine(f"{a}.latitude", f"{a}.longitude", f"{b}.latitude", f"{b}.longitude")
    return f"CASE WHEN {b}.ts_sec - {a}.ts_sec > 0 THEN {h} / ({b}.ts_sec - {a}.ts_sec) * 3.6 ELSE 0 END"


_P = "struct_pack(latitude := latitude, longitude := longitude, ts_sec := ts_sec)"
_SEG_SQL = f"""{_RUN_SQL}, j0 AS (SELECT *, {_P} AS h, lag({_P}) OVER ({_WR}) AS p, lead({_P}) OVER ({_WR}) AS n FROM r WHERE run_points >= 2),
  j AS (SELECT * EXCLUDE (h, p, n), coalesce(p IS NOT NULL AND n IS NOT NULL AND {_speed_sql('p', 'h')} > {SPEED} AND {_speed_sql('h', 'n')} > {SPEED} AND {_speed_sql('p', 'n')} <= {SPEED}, FALSE) AS jump FROM j0),
  k0 AS (SELECT *, {_P} AS h, lag({_P}) OVER ({_WR}) AS p FROM j WHERE NOT jump),
  k1 AS (SELECT *, coalesce({_haversine('p.latitude', 'p.longitude', 'h.latitude', 'h.longitude')} > {DISTANCE * 1000}, FALSE) AS distance_break, coalesce({_speed_sql('p', 'h')} > {SPEED}, FALSE) AS fast FROM k0),
  k2 AS (SELECT *, fast AND NOT distance_break AS speed_break FROM k1),
  k3 AS (SELECT *, CAST(sum(CASE WHEN distance_break OR speed_break THEN 1 ELSE 0 END) OVER ({_WR} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM k2),
  k AS (SELECT *, count(*) OVER (PARTITION BY group_id, run, segment) AS segment_points FROM k3)"""


def _segments(s: SparkSession, d: str) -> DataFrame:
    return lines.with_segments(lines.with_runs(lines.line_points(trip_points(s, d))), DISTANCE, SPEED)


_add("seq_runs", lambda s, d: lines.with_runs(trip_points(s, d)).select("group_id", "asset_id", "run", "run_points"), f"WITH {_RUN_SQL} SELECT group_id, asset_id, run, run_points FROM r")
_add("jump_removed", lambda s, d: lines.with_jumps(lines.with_runs(trip_points(s, d)).filter("run_points >= 2"), SPEED).select("asset_id", "jump"), f"WITH {_SEG_SQL} SELECT asset_id, jump FROM j")
_add("distance_split", lambda s, d: _segments(s, d).select("asset_id", "distance_break"), f"WITH {_SEG_SQL} SELECT asset_id, distance_break FROM k")
_add("speed_split", lambda s, d: _segments(s, d).select("asset_id", "speed_break", "segment"), f"WITH {_SEG_SQL} SELECT asset_id, speed_break, segment FROM k")
_LINE = ["group_id", "run", "segment", "n_points", "start_sec", "end_sec", "min_lat", "max_lat", "min_lon", "max_lon"]
_LINE_SQL = "count(*) AS n_points, min(ts_sec) AS start_sec, max(ts_sec) AS end_sec, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon"
_PATH_SQL = "string_agg(CAST(CAST(round(latitude * 100) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(longitude * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY sequence, ts_sec, asset_id) AS path"


def _path(df: DataFrame) -> DataFrame:
    at = lambda x, c: F.round(x[c] * 100).cast("long").cast("string")
    return df.withColumn("path", F.array_join(F.transform("points", lambda x: F.concat_ws(" ", at(x, "lat"), at(x, "lon"))), ";"))


_add("polyline_segments", lambda s, d: _path(lines.polylines(_segments(s, d))).select(*_LINE, "path"), f"WITH {_SEG_SQL} SELECT group_id, run, segment, {_LINE_SQL}, {_PATH_SQL} FROM k WHERE segment_points >= 2 GROUP BY group_id, run, segment")
_add("polyline_metrics", lambda s, d: lines.line_metrics(lines.line_points(trip_points(s, d)), DISTANCE, SPEED), f"""WITH {_SEG_SQL} SELECT (SELECT count(*) FROM r) AS matched, (SELECT count(*) FROM r WHERE run_points >= 2) AS accepted, (SELECT count(*) FROM j WHERE jump) AS jumps,
  (SELECT count(*) FROM k WHERE distance_break) AS distance_breaks, (SELECT count(*) FROM k WHERE speed_break) AS speed_breaks, (SELECT count(DISTINCT (group_id, run, segment)) FROM k WHERE segment_points >= 2) AS segments, (SELECT count(*) FROM k WHERE segment_points >= 2) AS rendered""")


def _one_group(s: SparkSession, d: str) -> DataFrame:
    return _path(lines.polylines(lines.with_segments(lines.with_runs(trip_points(s, d).filter("group_id = 'trip-7'"))))).select(*_LINE, "path")


def _source(s: SparkSession, d: str) -> DataFrame:
    return lines.polylines(lines.with_segments(lines.with_runs(lines.line_points(trip_points(s, d)).filter(F.col("ts_sec").between(T1 // 1000, T2 // 1000)))))


_add("group_polyline", _one_group, f"WITH {_RUN_SQL} SELECT group_id, run, CAST(0 AS BIGINT) AS segment, {_LINE_SQL}, {_PATH_SQL} FROM r WHERE group_id = 'trip-7' AND run_points >= 2 GROUP BY group_id, run")
_TILE_RUN = _RUN_SQL.replace("FROM tp)", f"FROM tp WHERE ts_sec BETWEEN {T1 // 1000} AND {T2 // 1000})")
_add("line_tile_source", lambda s, d: _source(s, d).select(*_LINE), f"WITH {_TILE_RUN} SELECT group_id, run, CAST(0 AS BIGINT) AS segment, {_LINE_SQL} FROM r WHERE run_points >= 2 GROUP BY group_id, run")


def _tile_sql(zoom: int) -> str:
    w = _d(geo.world_px(zoom))
    y = lambda c: f"(0.5 - ln((1 + sin(radians({c}))) / (1 - sin(radians({c})))) / (4 * pi())) * {w}"
    x = lambda c: f"({c} + 180) / 360 * {w}"
    t = lambda p, g: f"CAST(least(greatest(floor(({p} + {g}) / 256), 0), {2**zoom - 1}) AS BIGINT)"
    return f"""WITH {_TILE_RUN}, l AS (SELECT group_id, run, {_LINE_SQL} FROM r WHERE run_points >= 2 GROUP BY group_id, run),
      a AS (SELECT *, unnest(generate_series({t(x('min_lon'), -12)}, {t(x('max_lon'), 12)})) AS x, {t(y('max_lat'), -12)} AS y1, {t(y('min_lat'), 12)} AS y2 FROM l)
      SELECT group_id, run, {zoom} AS z, x, unnest(generate_series(y1, y2)) AS y, n_points FROM a"""


_add("tile_segments", lambda s, d: lines.tile_segments(_source(s, d), 5).select("group_id", "run", "z", "x", "y", "n_points"), _tile_sql(5))


# --- long trips, scanned in blocks; parts of lines; tiles of clipped edges

#: Points of a block: few, so that little data has many.
_BLOCK = 500


def _long_trip(s: SparkSession, d: str) -> DataFrame:
    """All events as one trip in the order of their ids, with a gap in its sequences after every 700th."""
    e = F.col("asset_id")
    return trip_points(s, d).withColumns({"group_id": F.lit("long"), "sequence": e + F.floor(e / 700), "ts_sec": e * 400, "latitude": 20 + (e % 97) / 100.0 + F.when(e % 41 == 0, 0.5).otherwise(0.0), "longitude": 30 + (e % 89) / 100.0})


_LONG_TP = f"""{TRIP_SQL.replace('tp AS', 't0 AS', 1)}, tp AS (SELECT asset_id, 'long' AS group_id, asset_id * 400 AS ts_sec, asset_id + asset_id // 700 AS sequence,
  20 + CAST(asset_id % 97 AS DOUBLE) / CAST(100 AS DOUBLE) + CASE WHEN asset_id % 41 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS latitude, 30 + CAST(asset_id % 89 AS DOUBLE) / CAST(100 AS DOUBLE) AS longitude FROM t0)"""
_LONG_SQL = _SEG_SQL.replace(TRIP_SQL, _LONG_TP)
_add("long_trip_segments", lambda s, d: lines.with_segments(lines.with_runs(_long_trip(s, d), _BLOCK), DISTANCE, SPEED).select("asset_id", "run", "run_points", "segment", "segment_points", "distance_break", "speed_break"),
     f"WITH {_LONG_SQL} SELECT asset_id, run, run_points, segment, segment_points, distance_break, speed_break FROM k")
_PARTS = 7
_add("polyline_parts", lambda s, d: lines.polyline_parts(_segments(s, d), _PARTS).select("group_id", "run", "segment", "part", "n_points", "start_sec", "end_sec"),
     f"""WITH {_SEG_SQL}, w AS (SELECT *, (row_number() OVER (PARTITION BY group_id, run, segment ORDER BY sequence, ts_sec, asset_id) - 1) // {_PARTS} AS part FROM k WHERE segment_points >= 2)
  SELECT group_id, run, segment, part, count(*) AS n_points, min(ts_sec) AS start_sec, max(ts_sec) AS end_sec FROM w GROUP BY group_id, run, segment, part""")


def _edge_sql(zoom: int, gutter: int, tile: tuple[int, int] | None = None) -> str:
    """Edges of segments, dealt to the tiles of their bounds, and clipped to these."""
    w = _d(geo.world_px(zoom))
    y = lambda c: f"(0.5 - ln((1 + sin(radians({c}))) / (1 - sin(radians({c})))) / (4 * pi())) * {w}"
    x = lambda c: f"({c} + 180) / 360 * {w}"
    t = lambda p: f"CAST(least(greatest(floor(({p}) / 256), 0), {2**zoom - 1}) AS BIGINT)"
    cut = lambda c, f: f"CASE WHEN {c}2 <> {c}1 THEN {f}(({c} * 256 - {gutter} - {c}1) / ({c}2 - {c}1), (({c} + 1) * 256 + {gutter} - {c}1) / ({c}2 - {c}1)) END"
    pixel = lambda c, k: f"round({c}1 + t{k} * ({c}2 - {c}1) - {c} * 256, 3) + 0.0 AS p{c}{k}"
    return f"""WITH {_SEG_SQL}, e0 AS (SELECT *, lag(latitude) OVER g AS la, lag(longitude) OVER g AS lo FROM k WINDOW g AS (PARTITION BY group_id, run, segment ORDER BY sequence, ts_sec, asset_id)),
  e AS (SELECT group_id, run, segment, asset_id, {x('lo')} AS x1, {y('la')} AS y1, {x('longitude')} AS x2, {y('latitude')} AS y2 FROM e0 WHERE la IS NOT NULL),
  xs AS (SELECT *, unnest(generate_series({t(f'least(x1, x2) - {gutter}')}, {t(f'greatest(x1, x2) + {gutter}')})) AS x FROM e),
  ys AS (SELECT *, unnest(generate_series({t(f'least(y1, y2) - {gutter}')}, {t(f'greatest(y1, y2) + {gutter}')})) AS y FROM xs),
  c AS (SELECT *, greatest(0.0, {cut('x', 'least')}, {cut('y', 'least')}) AS t1, least(1.0, {cut('x', 'greatest')}, {cut('y', 'greatest')}) AS t2 FROM ys {f'WHERE x = {tile[0]} AND y = {tile[1]}' if tile else ''})
  SELECT group_id, run, segment, asset_id, {zoom} AS z, x, y, {pixel('x', 1)}, {pixel('y', 1)}, {pixel('x', 2)}, {pixel('y', 2)} FROM c WHERE t1 <= t2"""


_EDGE = ["group_id", "run", "segment", "asset_id", "z", "x", "y"]


def _pixels(df: DataFrame) -> DataFrame:
    return df.select(*_EDGE, *[(F.round(c, 3) + 0.0).alias(c) for c in ("px1", "py1", "px2", "py2")])


_add("tile_edges", lambda s, d: _pixels(lines.tile_edges(_segments(s, d), 8)), _edge_sql(8, 12))
_add("one_tile", lambda s, d: _pixels(lines.one_tile(_segments(s, d), 4, 7, 5, 20)), _edge_sql(4, 20, (7, 5)))


# --- catalog

_FIELDS = ["display_name", "size_bytes", "timestamp_ms"]
_FIRST = ", ".join(f"arg_min({c}, ingest_seq) FILTER ({c} IS NOT NULL) AS {c}" for c in ("display_name", "timestamp_ms"))
_add("live_generation", lambda s, d: catalog.live(occurrences(s, d), sources(s)).select("media_id", "source_id", "ingest_seq"), f"WITH {OCC_SQL} SELECT media_id, source_id, ingest_seq FROM live")
_add("merge_first_non_null", lambda s, d: catalog.merge_occurrences(catalog.live(occurrences(s, d), sources(s)), _FIELDS), f"WITH {OCC_SQL} SELECT media_id, count(*) AS n_occurrences, {_FIRST}, max(size_bytes) AS size_bytes FROM live GROUP BY media_id")
_add("locations_last_wins", lambda s, d: catalog.last_locations(catalog.live(occurrences(s, d), sources(s)), "location_id", ["source_id", "relative_path"]),
     f"WITH {OCC_SQL} SELECT media_id, location_id, arg_max(source_id, ingest_seq) AS source_id, arg_max(relative_path, ingest_seq) AS relative_path FROM live GROUP BY media_id, location_id")
_add("dedup_assets", lambda s, d: catalog.dense_ids(catalog.merge_occurrences(catalog.live(occurrences(s, d), sources(s)), []), "media_id", "asset_id"),
     f"WITH {OCC_SQL} SELECT media_id, count(*) AS n_occurrences, row_number() OVER (ORDER BY media_id) - 1 AS asset_id FROM live GROUP BY media_id")


# --- scalar functions

_add("geo_identity_hash", lambda s, d: geo_events(s, d).filter("latitude is not null and timestamp_ms is not null").select("asset_id", values.geo_point_hash(F.col("latitude"), F.col("longitude"), F.col("timestamp_ms")).alias("hash")),
     f"WITH {GEO_SQL} SELECT asset_id, format('geo_point:v1:{{:.9f}}:{{:.9f}}:{{}}', latitude, longitude, timestamp_ms) AS hash FROM ge WHERE latitude IS NOT NULL AND timestamp_ms IS NOT NULL")
_add("semantic_hash", lambda s, d: geo_events(s, d).select("asset_id", values.semantic_hash(F.col("kind"), F.col("timestamp_ms"), F.col("end_timestamp_ms"), F.lit("x")).alias("hash")),
     f"WITH {GEO_SQL} SELECT asset_id, 'timeline:v1:' || kind || ':' || coalesce(CAST(timestamp_ms AS VARCHAR), '') || ':' || coalesce(CAST(end_timestamp_ms AS VARCHAR), '') || ':x' AS hash FROM ge")
_add("e7_roundtrip", lambda s, d: geo_events(s, d).withColumn("lat_e7", geo.to_e7("latitude", 90)).select("asset_id", "lat_e7", geo.from_e7("lat_e7").alias("lat")),
     f"WITH {GEO_SQL} SELECT asset_id, {_e7_sql('latitude', 90)} AS lat_e7, {_e7_sql('latitude', 90)} / CAST(1e7 AS DOUBLE) AS lat FROM ge")
_add("mercator_px", lambda s, d: geo_events(s, d).select("asset_id", F.round(geo.lon_to_px("longitude", 5), 4).alias("x"), F.round(geo.lat_to_px("latitude", 5), 4).alias("y")),
     f"WITH {GEO_SQL} SELECT asset_id, round((longitude + 180) / 360 * 8192, 4) AS x, round((0.5 - ln((1 + sin(radians(latitude))) / (1 - sin(radians(latitude)))) / (4 * pi())) * 8192, 4) AS y FROM ge")
_add("latlng_string_parse", lambda s, d: geo_events(s, d).select("asset_id", values.coordinate_pair(F.concat(F.col("latitude").cast("decimal(12,4)").cast("string"), F.lit("°, "), F.col("longitude").cast("decimal(12,4)").cast("string"), F.lit("°"))).alias("p")).select("asset_id", "p.lat", "p.lon"),
     f"WITH {GEO_SQL} SELECT asset_id, CASE WHEN abs(longitude) <= 180 THEN CAST(CAST(latitude AS DECIMAL(12,4)) AS DOUBLE) END AS lat, CASE WHEN abs(longitude) <= 180 THEN CAST(CAST(longitude AS DECIMAL(12,4)) AS DOUBLE) END AS lon FROM ge")
_SRC = ("wi_fi", " Cellular", "gps", "CELL", "bluetooth", "")
_add("line_source_normalise", lambda s, d: geo_events(s, d).select("asset_id", values.line_source(F.element_at(F.array(*map(F.lit, _SRC)), (F.col("asset_id") % 6 + 1).cast("int"))).alias("source")),
     f"WITH {GEO_SQL} SELECT asset_id, CASE asset_id % 6 WHEN 0 THEN 'WIFI' WHEN 1 THEN 'CELL' WHEN 2 THEN 'GPS' WHEN 3 THEN 'CELL' ELSE 'UNKNOWN' END AS source FROM ge")
_add("normalize_lon", lambda s, d: geo_events(s, d).select("asset_id", F.round(geo.normalize_lon(F.col("longitude") * 3), 6).alias("lon")),
     f"WITH {GEO_SQL}, m AS (SELECT asset_id, longitude * 3 + 180 AS v FROM ge), n AS (SELECT asset_id, v - floor(v / 360) * 360 - 180 AS x FROM m) SELECT asset_id, round(CASE WHEN x = -180 THEN 180 ELSE x END, 6) AS lon FROM n")
_add("time_index", lambda s, d: catalog.time_geo(geo_events(s, d).withColumns({c: F.lit(None).cast("double") for c in ("accuracy_m", "velocity_mps", "heading_deg", "group_id", "sequence")})).select("ts_sec", "lat_e7", "lon_e7", "asset_id", "kind", "has_geo"),
     f"WITH {GEO_SQL} SELECT coalesce(timestamp_ms // 1000, 0) AS ts_sec, {_e7_sql('latitude', 90)} AS lat_e7, {_e7_sql('longitude', 180)} AS lon_e7, asset_id, kind, latitude IS NOT NULL AND longitude IS NOT NULL AS has_geo FROM ge WHERE timestamp_ms IS NOT NULL OR latitude IS NOT NULL")

"""Registered queries of the import path: exports are written from the events in tasks, read back by the readers, and merged.

Files hold a bounded number of points each, so that their number grows with the data.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import facts, geo, values
from cairn.operators import bubbles, catalog, groups, index, lines, predicates, search
from cairn.operators.catalog import Catalog
from cairn.operators.tables import stored, work_path
from cairn.plans import catalog_queries
from cairn.plans.catalog_queries import _GROUP, _GROUP_SQL, ORACLES, QUERIES, _add, _d, _flat, _members  # noqa: F401
from cairn.plans.spec import SearchSpec
from cairn.plans.urlstate import spec_from_query
from cairn.plans.views import GEO_SQL, TRIP_SQL, geo_events, trip_points
from cairn.sources import readers
from cairn.sources.rescan import rescan
from cairn.sources.steps import import_step
from cairn.streaming.ingest import stream_imports

#: Points, or timeline segments, in a file.
POINTS, SEGMENTS = 2000, 500


def _written(df: DataFrame, per_file: int, entry: Column, head: str, tail: str, between: str, suffix: str, path: str | None = None) -> str:
    """A folder of text files made of entries (null ones are left out) in the order of asset_id, per_file ids in each.

    A new folder has no folders in it: a file of its own is a row of a task, so that neither writing nor listing the files takes
    a step of the driver for each. In a folder that is given, each file has its own, and files of other ids stay.
    """
    file = F.concat(F.floor(F.col("asset_id") / per_file).cast("string"), F.lit(suffix))
    # Events come first to the task that writes their file, as a scan of few large pieces has few tasks to make entries.
    rows = df.withColumn("file", file).repartition("file").select("asset_id", "file", entry.alias("entry"))
    found = F.filter(F.array_sort(F.collect_list(F.struct("asset_id", "entry"))), lambda x: x["entry"].isNotNull())
    files = rows.groupBy("file").agg(found.alias("found")).filter(F.size("found") > 0)
    files = files.select("file", F.concat(F.lit(head), F.array_join(F.transform("found", lambda x: x["entry"]), between), F.lit(tail)).alias("value"))
    if path is None:
        path = work_path(df.sparkSession, "export")
        files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    else:
        files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").text(path)
    return path


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _degrees(column: str) -> Column:
    return F.col(column).cast("decimal(12,4)").cast("string")


def _gpx(s: SparkSession, d: str, events: DataFrame | None = None, path: str | None = None) -> str:
    time = F.coalesce(F.concat(F.lit("<time>"), _iso(F.col("timestamp_ms")), F.lit("</time>")), F.lit(""))
    tag = F.element_at(F.array(F.lit("trkpt"), F.lit("x:rtept"), F.lit("WPT")), (F.col("asset_id") % 3 + 1).cast("int"))
    point = F.concat(F.lit("<"), tag, F.lit(' lat="'), _degrees("latitude"), F.lit('" lon="'), _degrees("longitude"), F.lit('">'), time, F.lit("</"), tag, F.lit(">"))
    return _written(geo_events(s, d) if events is None else events, POINTS, point, '<?xml version="1.0"?><gpx>', "</gpx>", "\n", "", path)


def _records(s: SparkSession, d: str) -> str:
    e7 = lambda c: F.round(F.col(c) * 10_000).cast("long") * 1000
    a, ms = F.col("asset_id"), F.col("timestamp_ms")
    location = F.struct(
        F.when(a % 3 == 0, ms.cast("string")).alias("timestampMs"), e7("latitude").alias("latitudeE7"), e7("longitude").cast("string").alias("longitudeE7"),
        F.when(a % 3 != 0, _iso(ms)).alias("timestamp"), F.when(a % 4 != 0, a % 100).alias("accuracy"), F.when(a % 5 != 0, F.lit("WIFI")).alias("source"), F.when(a % 6 == 0, a.cast("string")).alias("deviceTag"),
    )
    return _written(geo_events(s, d), POINTS, F.when(F.col("latitude").isNotNull(), F.to_json(location)), '{"locations":[', "]}", ",\n", "")


def _timeline(s: SparkSession, d: str) -> str:
    """Per event: a visit, an activity, or a path of one or two points, by its kind; a file is one list of segments."""
    at = F.concat(_degrees("latitude"), F.lit("°, "), _degrees("longitude"), F.lit("°"))
    start, end = _iso(F.col("timestamp_ms")), _iso(F.coalesce("end_timestamp_ms", F.col("timestamp_ms") + 1000))
    kind, a = F.col("kind"), F.col("asset_id").cast("string")
    step = F.struct(at.alias("point"), start.alias("time"))
    visit = F.struct(F.lit("0.5").alias("probability"), F.struct(F.concat(F.lit("P"), a).alias("placeId"), F.struct(at.alias("latLng")).alias("placeLocation")).alias("topCandidate"))
    move = F.struct(F.struct(at.alias("latLng")).alias("start"), F.struct(F.lit("WALKING").alias("type")).alias("topCandidate"))
    steps = F.when(F.col("asset_id") % 3 == 0, F.array(step, step)).otherwise(F.array(step))
    segment = F.struct(start.alias("startTime"), end.alias("endTime"), F.when(kind == "timeline_visit", visit).alias("visit"), F.when(kind == "video", move).alias("activity"), F.when(kind == "geo_point", steps).alias("timelinePath"))
    found = F.col("latitude").isNotNull() & F.col("timestamp_ms").isNotNull() & (kind != "image")
    return _written(geo_events(s, d), SEGMENTS, F.when(found, F.to_json(segment)), '{"semanticSegments":[', "]}", ",\n", "")


def _read(reader, path: str, s: SparkSession, source: str = "s") -> DataFrame:
    return reader(readers.read_files(s, path), source)


_AT = ["media_id", "latitude", "longitude", "timestamp_ms"]
_LAT, _LON = (f"CAST(CAST({c} AS DECIMAL(12,4)) AS DOUBLE)" for c in ("latitude", "longitude"))
_HASH = f"format('geo_point:v1:{{:.9f}}:{{:.9f}}:{{}}', {_LAT}, {_LON}, timestamp_ms)"
_PLACED = f"""{GEO_SQL}, ft AS (SELECT *, asset_id // {POINTS} AS file, row_number() OVER (PARTITION BY asset_id // {POINTS} ORDER BY asset_id) AS point_index FROM ge WHERE latitude IS NOT NULL)"""

_add("import_gpx", lambda s, d: _read(readers.read_gpx, _gpx(s, d), s).select(*_AT, F.col("location.point_index").alias("point_index"), "kind", "source_dataset"),
     f"WITH {_PLACED} SELECT {_HASH} AS media_id, {_LAT} AS latitude, {_LON} AS longitude, timestamp_ms, point_index, 'geo_point' AS kind, 'gpx' AS source_dataset FROM ft WHERE timestamp_ms IS NOT NULL")

_RECORD = [*_AT, "accuracy_m", "source_type", "device_tag", "point_index"]
_RECORDS_SQL = f"""WITH {_PLACED} SELECT {_HASH} AS media_id, {_LAT} AS latitude, {_LON} AS longitude, timestamp_ms, CASE WHEN asset_id % 4 <> 0 THEN CAST(asset_id % 100 AS DOUBLE) END AS accuracy_m,
  CASE WHEN asset_id % 5 <> 0 THEN 'WIFI' END AS source_type, CASE WHEN asset_id % 6 = 0 THEN CAST(asset_id AS VARCHAR) END AS device_tag, point_index FROM ft WHERE timestamp_ms IS NOT NULL"""


def _record(df: DataFrame) -> DataFrame:
    return df.withColumns({"device_tag": F.col("metadata")["deviceTag"], "point_index": F.col("location.point_index")}).select(*_RECORD)


_add("import_records", lambda s, d: _record(_read(readers.read_records, _records(s, d), s)), _RECORDS_SQL)
_add("import_records_split", lambda s, d: _record(readers.read_records_objects(s, _records(s, d), "s")), _RECORDS_SQL)

_ISO = "strftime(epoch_ms({}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_END = "coalesce(end_timestamp_ms, timestamp_ms + 1000)"
_TIMELINE_SQL = f"""WITH {GEO_SQL}, sg AS (SELECT *, row_number() OVER (PARTITION BY asset_id // {SEGMENTS} ORDER BY asset_id) AS n, {_END} AS stop FROM ge WHERE latitude IS NOT NULL AND timestamp_ms IS NOT NULL AND kind <> 'image'),
  pt AS (SELECT *, unnest(range(CASE WHEN asset_id % 3 = 0 THEN 2 ELSE 1 END)) AS step FROM sg WHERE kind = 'geo_point')
  SELECT 'geo_point' AS kind, {_HASH} AS media_id, {_LAT} AS latitude, {_LON} AS longitude, timestamp_ms, CAST(NULL AS BIGINT) AS end_timestamp_ms, CAST(NULL AS BIGINT) AS duration_ms,
    CASE WHEN asset_id % 3 = 0 THEN 'google_timeline_segment:v1:' || n || ':' || {_ISO.format('timestamp_ms')} || ':' || {_ISO.format('stop')} END AS group_id, CASE WHEN asset_id % 3 = 0 THEN step END AS sequence FROM pt
  UNION ALL SELECT CASE kind WHEN 'video' THEN 'timeline_activity' ELSE kind END, 'timeline:v1:' || CASE kind WHEN 'video' THEN 'timeline_activity' ELSE kind END || ':' || timestamp_ms || ':' || stop || ':' || format('{{:.9f}}:{{:.9f}}', {_LAT}, {_LON}) || ':' || CASE kind WHEN 'video' THEN 'WALKING' ELSE 'P' || asset_id END,
    {_LAT}, {_LON}, timestamp_ms, stop, stop - timestamp_ms, NULL, NULL FROM sg WHERE kind IN ('video', 'timeline_visit')"""
_add("import_timeline", lambda s, d: _read(readers.read_timeline, _timeline(s, d), s).select("kind", *_AT, "end_timestamp_ms", "duration_ms", "group_id", "sequence"), _TIMELINE_SQL)


def _signals(s: SparkSession, d: str) -> list[str]:
    """Per event, by its id: a raw position, an activity sample (its keys in one order or the other), a scan that no reader takes, or a frequent place."""
    a, at = F.col("asset_id"), F.concat(_degrees("latitude"), F.lit("°, "), _degrees("longitude"), F.lit("°"))
    time, text = _iso(F.col("timestamp_ms")), lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n = (a % 100).cast("string")
    position = text('{"position":{"LatLng":"', at, '","timestamp":"', time, '","source":"GPS","accuracyMeters":', n, ',"speedMetersPerSecond":"1.5"}}')
    one, two = text('{"type":"WALKING","confidence":', n, '}'), text('{"confidence":', n, ',"type":"WALKING"}')
    sample = text('{"activityRecord":{"timestamp":"', time, '","probableActivities":[', F.when(a % 8 == 1, one).otherwise(two), ']}}')
    scan = text('{"wifiScan":{"deliveryTime":"', time, '"}}')
    signal = F.when(F.col("latitude").isNotNull() & (a % 4 == 0), position).when(a % 4 == 1, sample).when(a % 4 == 2, scan)
    place = F.when((a % 4 == 3) & F.col("latitude").isNotNull(), text('{"placeLocation":"', at, '","placeId":"P', a.cast("string"), '","label":"', F.when(a % 8 == 3, F.lit("HOME")).otherwise(F.lit("")), '"}'))
    events = geo_events(s, d)
    return [_written(events, SEGMENTS, signal, '{"rawSignals":[', "]}", ",", ""), _written(events, SEGMENTS, place, '{"userLocationProfile":{"frequentPlaces":[', "]}}", ",", "")]


_SIGNALS_SQL = f"""WITH {GEO_SQL}, pl AS (SELECT *, format('{{:.9f}}:{{:.9f}}', {_LAT}, {_LON}) AS place FROM ge)
  SELECT 'geo_point' AS kind, {_HASH} AS media_id, {_LAT} AS latitude, {_LON} AS longitude, timestamp_ms, 'GPS' AS source_type, CAST(asset_id % 100 AS DOUBLE) AS accuracy_m, CAST(1.5 AS DOUBLE) AS velocity_mps, CAST(NULL AS VARCHAR) AS activities, CAST(NULL AS VARCHAR) AS label FROM pl WHERE asset_id % 4 = 0 AND latitude IS NOT NULL AND timestamp_ms IS NOT NULL
  UNION ALL SELECT 'activity_sample', 'timeline:v1:activity_sample:' || timestamp_ms || ':[{{"confidence":' || asset_id % 100 || ',"type":"WALKING"}}]', NULL, NULL, timestamp_ms, 'activity_record', NULL, NULL, '[{{"confidence":' || asset_id % 100 || ',"type":"WALKING"}}]', NULL FROM pl WHERE asset_id % 4 = 1 AND timestamp_ms IS NOT NULL
  UNION ALL SELECT 'frequent_place', 'timeline:v1:frequent_place:' || place || ':P' || asset_id || ':' || CASE WHEN asset_id % 8 = 3 THEN 'HOME' ELSE '' END, {_LAT}, {_LON}, NULL, 'frequent_place', NULL, NULL, NULL, CASE WHEN asset_id % 8 = 3 THEN 'HOME' ELSE '' END FROM pl WHERE asset_id % 4 = 3 AND latitude IS NOT NULL"""
_add("import_signals", lambda s, d: readers.read_timeline(readers.read_files(s, _signals(s, d)), "s").select("kind", *_AT, "source_type", "accuracy_m", "velocity_mps", F.col("metadata")["probableActivities"].alias("activities"), F.col("metadata")["label"].alias("label")), _SIGNALS_SQL)

# Contents of files and the formats they are of.
_CONTENTS = (
    ('{"locations": []}', "records"), ('{"rawSignals": []}', "timeline"), ('{"timelineObjects": []}', "error: semantic location history files are not supported"),
    ('{"type": "FeatureCollection"}', "error: GeoJSON is not supported"), ('[{"a": 1}]', "error: unknown JSON"), ('<x:GPX version="1.1">', "gpx"), ("plain text", "error: unknown format"),
)
_add("file_formats", lambda s, d: geo_events(s, d).select("asset_id", readers.file_format(F.element_at(F.array(*[F.lit(c) for c, _ in _CONTENTS]), (F.col("asset_id") % 7 + 1).cast("int"))).alias("format")),
     f"WITH {GEO_SQL} SELECT asset_id, CASE asset_id % 7 {' '.join(f'''WHEN {k} THEN '{f}' ''' for k, (_, f) in enumerate(_CONTENTS))} END AS format FROM ge")


def _folder(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    paths = [_gpx(s, d), _records(s, d), _timeline(s, d)]
    bad = work_path(s, "export")
    s.range(2).select(F.concat(F.lit('{"timelineObjects": '), F.col("id").cast("string"), F.lit("}")).alias("value")).write.option("maxRecordsPerFile", 1).text(bad)
    return readers.read_locations(s, [*paths, bad], "s")


def _import_files(s: SparkSession, d: str) -> DataFrame:
    items, errors = _folder(s, d)
    return items.groupBy(F.coalesce("source_dataset", F.lit("")).alias("what")).agg(F.count("*").alias("n")).unionByName(errors.groupBy(F.col("error").alias("what")).agg(F.count("*").alias("n")))


_add("import_files", _import_files, f"""WITH {GEO_SQL}, ok AS (SELECT * FROM ge WHERE latitude IS NOT NULL AND timestamp_ms IS NOT NULL)
  SELECT unnest(['gpx', 'google_records']) AS what, (SELECT count(*) FROM ok) AS n
  UNION ALL SELECT 'google_timeline', CAST(sum(CASE WHEN kind = 'geo_point' AND asset_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) FROM ok WHERE kind <> 'image'
  UNION ALL SELECT 'semantic location history files are not supported', 2""")


# --- the catalog, filled from the files

def _catalog(s: SparkSession, d: str) -> Catalog:
    """GPX points as source a, records as source b, a first import of b replaced by a second one, and a source c removed."""
    c = Catalog(s, work_path(s, "catalog"))
    gpx, records = _read(readers.read_gpx, _gpx(s, d), s, "a"), _read(readers.read_records, _records(s, d), s, "b")
    c.upsert_source("a", "Tracks")
    c.append(gpx, c.prepare_import("a"))
    c.upsert_source("b", "Records")
    c.append(records.withColumn("media_id", F.concat(F.lit("old-"), "media_id")), c.prepare_import("b"))
    c.append(records.filter("metadata['deviceTag'] is not null or accuracy_m is not null"), c.prepare_import("b"))
    c.append(_read(readers.read_gpx, _gpx(s, d), s, "c"), c.prepare_import("c"))
    c.remove_sources(["c"])
    c.materialise()
    return c


_ASSETS_SQL = f"""{_PLACED}, oc AS (SELECT {_HASH} AS media_id, timestamp_ms, CASE WHEN asset_id % 4 <> 0 THEN CAST(asset_id % 100 AS DOUBLE) END AS accuracy_m, asset_id % 6 = 0 OR asset_id % 4 <> 0 AS b, asset_id FROM ft WHERE timestamp_ms IS NOT NULL),
  aa AS (SELECT media_id, CAST(count(*) + sum(CASE WHEN b THEN 1 ELSE 0 END) AS BIGINT) AS n_occurrences, arg_min(accuracy_m, asset_id) FILTER (accuracy_m IS NOT NULL) AS accuracy_m, CAST(1 + max(CASE WHEN b THEN 1 ELSE 0 END) AS BIGINT) AS n_locations,
    min(timestamp_ms) AS timestamp_ms, row_number() OVER (ORDER BY media_id) - 1 AS asset_id FROM oc GROUP BY media_id)"""
_add("materialised_assets", lambda s, d: _catalog(s, d).assets().select("asset_id", "media_id", "n_occurrences", "accuracy_m", F.size("locations").cast("long").alias("n_locations"), "timestamp_ms"),
     f"WITH {_ASSETS_SQL} SELECT asset_id, media_id, n_occurrences, accuracy_m, n_locations, timestamp_ms FROM aa")
_add("assets_of_a_source", lambda s, d: predicates.from_source(_catalog(s, d).assets(), "b").select("media_id", "source_id", F.size("locations").cast("long").alias("n_locations"), F.get("locations", F.lit(0))["source_label"].alias("label")),
     f"WITH {_ASSETS_SQL} SELECT media_id, 'b' AS source_id, CAST(1 AS BIGINT) AS n_locations, 'b' AS label FROM aa WHERE n_locations = 2")


def _sources_of_types(s: SparkSession, d: str) -> Catalog:
    """A source for each type of events, with as many generations as its events tell; those with few events are removed."""
    c = Catalog(s, work_path(s, "catalog"))
    kinds = geo_events(s, d).groupBy("event_type").agg(F.count("*").alias("n")).collect()  # a row a type
    mean = sum(r["n"] for r in kinds) / len(kinds)
    with c.transaction():
        for r in kinds:
            c.upsert_source(r["event_type"], r["event_type"].upper())
            for _ in range(1 + r["n"] % 3):
                c.prepare_import(r["event_type"])
        c.remove_sources([r["event_type"] for r in kinds if r["n"] < mean])
    return c


_add("listed_sources", lambda s, d: _sources_of_types(s, d).list_sources().select("source_id", "label", "generation"),
     "WITH k AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT event_type AS source_id, upper(event_type) AS label, 1 + n % 3 AS generation FROM k WHERE n >= (SELECT avg(n) FROM k)")
_add("catalog_time_index", lambda s, d: _catalog(s, d).time_index().select("asset_id", "ts_sec", "lat_e7", "has_geo"),
     f"WITH {_ASSETS_SQL} SELECT asset_id, timestamp_ms // 1000 AS ts_sec, CAST(floor(CAST(string_split(media_id, ':')[3] AS DOUBLE) * CAST(1e7 AS DOUBLE) + 0.5) AS INTEGER) AS lat_e7, TRUE AS has_geo FROM aa")


# --- upkeep of the catalog: imports in batches, again, packed, scanned again

def _in_batches(s: SparkSession, d: str, again: bool = False, packed: bool = False) -> Catalog:
    """The records in three batches by their place in a file, each merged into what was there, and then the GPX points as another source."""
    c = Catalog(s, work_path(s, "catalog"))
    records, gpx = stored(_read(readers.read_records, _records(s, d), s, "b")), _read(readers.read_gpx, _gpx(s, d), s, "a")
    g = c.prepare_import("b")
    for k in (0, 1, 2, *([1] if again else [])):
        with c.transaction():
            c.append(records.filter(F.col("location.point_index") % 3 == k), g, k, "b")
            c.materialise()
    with c.transaction():
        c.append(gpx, c.prepare_import("a"))
        c.materialise()
    if packed:
        c.compact()
    return c


_BATCH_SQL = f"""WITH {_PLACED}, b AS (SELECT {_HASH} AS media_id, timestamp_ms, CASE WHEN asset_id % 4 <> 0 THEN CAST(asset_id % 100 AS DOUBLE) END AS accuracy_m, point_index % 3 AS batch, asset_id FROM ft WHERE timestamp_ms IS NOT NULL)
  SELECT row_number() OVER (ORDER BY media_id) - 1 AS asset_id, media_id, CAST(2 * count(*) AS BIGINT) AS n_occurrences, arg_min(accuracy_m, (batch, asset_id)) FILTER (accuracy_m IS NOT NULL) AS accuracy_m, min(timestamp_ms) AS timestamp_ms, CAST(2 AS BIGINT) AS n_locations FROM b GROUP BY media_id"""
_ASSET = ["asset_id", "media_id", "n_occurrences", "accuracy_m", "timestamp_ms"]
for _name, _how in (("assets_in_batches", {}), ("assets_of_a_repeated_batch", {"again": True}), ("assets_after_compaction", {"packed": True})):
    _add(_name, lambda s, d, h=_how: _in_batches(s, d, **h).assets().select(*_ASSET, F.size("locations").cast("long").alias("n_locations")), _BATCH_SQL)


def _scanned_again(s: SparkSession, d: str) -> DataFrame:
    """A folder of GPX files is imported; then of every four files one is written anew, one is deleted and one is added."""
    c, root = Catalog(s, work_path(s, "catalog")), work_path(s, "folder")
    events = geo_events(s, d)
    file = F.floor(F.col("asset_id") / POINTS) % 4
    _gpx(s, d, events.filter(file != 3), root)
    c.upsert_source("r", "Folder", root)
    rescan(c, "r")
    c.materialise()
    _gpx(s, d, events.filter((file == 1) & (F.col("asset_id") % 2 == 0) | (file == 3)), root)
    c.folder.delete_matching(f"{root}/file=*", lambda name: int(name.partition("=")[2]) % 4 == 2)
    rescan(c, "r")
    return c.materialise()


_add("rescanned_folder", lambda s, d: _scanned_again(s, d).select("asset_id", "media_id", "n_occurrences", F.get("locations", F.lit(0))["point_index"].alias("point_index")),
     f"""WITH {GEO_SQL}, ft AS (SELECT *, row_number() OVER (PARTITION BY asset_id // {POINTS} ORDER BY asset_id) AS point_index FROM ge WHERE latitude IS NOT NULL AND ((asset_id // {POINTS}) % 4 IN (0, 3) OR (asset_id // {POINTS}) % 4 = 1 AND asset_id % 2 = 0))
  SELECT row_number() OVER (ORDER BY {_HASH}) - 1 AS asset_id, {_HASH} AS media_id, CAST(1 AS BIGINT) AS n_occurrences, point_index FROM ft WHERE timestamp_ms IS NOT NULL""")


def _stepped(s: SparkSession, d: str) -> DataFrame:
    """The records files, 700 locations of each at a time, by a catalog that is opened anew for each step."""
    root, path = work_path(s, "catalog"), _records(s, d)
    while import_step(Catalog(s, root), path, "b", 700):
        pass
    return Catalog(s, root).occurrences()


_add("import_in_steps", lambda s, d: _record(_stepped(s, d)), _RECORDS_SQL)


def _grouped(s: SparkSession, d: str) -> Catalog:
    c = Catalog(s, work_path(s, "catalog"))
    with c.transaction():
        c.append(_read(readers.read_timeline, _timeline(s, d), s, "t"), c.prepare_import("t"))
        c.materialise()
    return c


_add("catalog_groups", lambda s, d: _grouped(s, d).groups().select("group_id", "count", "start_sec", "end_sec"),
     f"WITH t AS ({_TIMELINE_SQL}) SELECT group_id, count(DISTINCT media_id) AS count, min(timestamp_ms // 1000) AS start_sec, max(timestamp_ms // 1000) AS end_sec FROM t WHERE group_id IS NOT NULL GROUP BY group_id")
_add("catalog_group_points", lambda s, d: _grouped(s, d).group_points().select("group_id", "sequence", "ts_sec"), f"WITH t AS ({_TIMELINE_SQL}) SELECT group_id, sequence, timestamp_ms // 1000 AS ts_sec FROM t WHERE group_id IS NOT NULL")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The GPX folder as a stream: one run, then files that are added to it, by the same checkpoint; half of all in batches of two files."""
    c, check, root = Catalog(s, work_path(s, "catalog")), work_path(s, "checkpoint"), work_path(s, "folder")
    events = geo_events(s, d)
    late = F.floor(F.col("asset_id") / POINTS) % 2 == 1
    for part, per_batch in ((events.filter(~late), 2), (events.filter(late), 100)):
        _gpx(s, d, part, root)
        stream_imports(s, f"{root}/*/*.txt", c, "a", check, files_per_batch=per_batch).awaitTermination()
    return c.assets()


_add("stream_import", lambda s, d: _streamed(s, d).select("asset_id", "media_id", "n_occurrences", "timestamp_ms"),
     f"WITH {_PLACED} SELECT row_number() OVER (ORDER BY {_HASH}) - 1 AS asset_id, {_HASH} AS media_id, count(*) AS n_occurrences, min(timestamp_ms) AS timestamp_ms FROM ft WHERE timestamp_ms IS NOT NULL GROUP BY {_HASH}")

# --- pages by the indexes

#: Rows of a range: small ones, so that little data has many.
_RANGE = 1000


def _index(s: SparkSession, d: str) -> index.Index:
    return index.build_index(geo_events(s, d), work_path(s, "index"), _RANGE, ties="asset_id")  # media ids of more than 7 digits are cut, so they don't follow asset ids


_NEAR = SearchSpec(order="distance", center=(47.3769, 8.5417), limit=50)
for _name, _spec in (("knn_basic", {}), ("knn_kind_media", {"kind": "media"}), ("knn_offset_page", {"offset": 75}), ("knn_polar", {"center": (89.9, 15)})):
    _add(f"indexed_{_name}", lambda s, d, q=_spec: _index(s, d).knn_page(replace(_NEAR, **q)).select("media_id", "kind", "timestamp_ms", F.round("distance_m", 3).alias("distance_m")), ORACLES[_name])
_TIMED = "asset_id, media_id, kind, ts_sec, latitude, longitude"
for _name, _spec in (("time_page_desc", {}), ("time_page_asc", {"order": "timestamp_asc", "offset": 100}), ("time_page_interval_overlap", {"start_ms": catalog_queries.T1, "end_ms": catalog_queries.T2, "limit": 10_000})):
    _add(f"indexed_{_name}", lambda s, d, q=_spec: _index(s, d).time_page(replace(SearchSpec(limit=200), **q)).select("media_id", "kind", "ts_sec", "latitude", "longitude"),
         ORACLES[_name].replace(f"SELECT {_TIMED}", "SELECT " + _TIMED.partition(", ")[2]))
_add("catalog_search_page", lambda s, d: _catalog(s, d).search(SearchSpec(order="timestamp_asc", limit=40, offset=15)).select("pos", "asset_id", "media_id", F.size("locations").cast("long").alias("n_locations")),
     f"WITH {_ASSETS_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY timestamp_ms // 1000, asset_id) - 16 AS pos FROM aa) SELECT pos, asset_id, media_id, n_locations FROM k WHERE pos BETWEEN 0 AND 39")

# --- pages of whole items, probes and windows

_PAGE = SearchSpec(order="timestamp_asc", limit=300, offset=40)
_add("search_page_of_items", lambda s, d: search.search(geo_events(s, d), _PAGE).select("pos", "asset_id", "media_id", "event_type"),
     f"WITH {GEO_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY coalesce(timestamp_ms // 1000, 0), asset_id) - 1 AS p FROM ge WHERE timestamp_ms IS NOT NULL OR latitude IS NOT NULL) SELECT p - 40 AS pos, asset_id, media_id, event_type FROM k WHERE p >= 40 AND p < 340")
_URL = spec_from_query("sort=timestamp_asc&kind=media&page=2&pageSize=50&from=2024-01-05&to=2024-01-25")
_add("search_from_url", lambda s, d: search.time_page(geo_events(s, d), _URL).select("asset_id", "kind", "ts_sec"),
     f"""WITH {GEO_SQL} SELECT asset_id, kind, timestamp_ms // 1000 AS ts_sec FROM ge WHERE kind IN ('image', 'video') AND coalesce(end_timestamp_ms, timestamp_ms) >= epoch_ms(TIMESTAMP '2024-01-05') AND timestamp_ms < epoch_ms(TIMESTAMP '2024-01-26')
      ORDER BY ts_sec, asset_id LIMIT 50 OFFSET 50""")
_add("group_search_none", lambda s, d: _flat(groups.group_search(groups.group_summary(_members(s, d)), SearchSpec(), 0, probe=True)), f"WITH {_GROUP_SQL} SELECT {', '.join(_GROUP)} FROM g ORDER BY start_sec DESC, end_sec DESC, group_id DESC LIMIT 1")

for _name, _compat, _kind in (("map_points", False, None), ("map_points_compat", True, None), ("map_points_compat_kind", True, "video")):
    _all = _compat and _kind is None
    _add(_name, lambda s, d, c=_compat, k=_kind: predicates.on_map(geo_events(s, d), SearchSpec(kind=k, start_ms=catalog_queries.T1, end_ms=catalog_queries.T2), c).select("asset_id", "kind"),
         f"""WITH {GEO_SQL} SELECT asset_id, kind FROM ge WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND timestamp_ms <= {catalog_queries.T2} {'' if _all else f'AND coalesce(end_timestamp_ms, timestamp_ms) >= {catalog_queries.T1}'} {f"AND kind = '{_kind}'" if _kind else ''}""")

# --- scalar functions and filters

_add("coordinate_validity", lambda s, d: geo_events(s, d).select("asset_id", geo.valid_coordinate(F.col("latitude") * 1.5, F.col("longitude") * 1.5).alias("valid")),
     f"WITH {GEO_SQL} SELECT asset_id, coalesce(abs(latitude * 1.5) <= 90 AND abs(longitude * 1.5) <= 180, FALSE) AS valid FROM ge")
_add("line_quality_filter", lambda s, d: lines.line_points(trip_points(s, d).withColumns({"accuracy_m": F.when(F.col("asset_id") % 5 > 0, F.col("asset_id") % 50), "line_source": F.when(F.col("asset_id") % 2 == 0, "GPS").otherwise("CELL")}), ["GPS"], 20).select("asset_id"),
     f"WITH {TRIP_SQL} SELECT asset_id FROM tp WHERE sequence >= 0 AND asset_id % 2 = 0 AND (asset_id % 5 = 0 OR asset_id % 50 <= 20)")
_add("iso_times", lambda s, d: geo_events(s, d).select("asset_id", values.iso_to_ms(F.when(F.col("asset_id") % 2 == 0, _iso(F.col("timestamp_ms"))).otherwise(F.concat(F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:30")))).alias("ms")),
     f"WITH {GEO_SQL} SELECT asset_id, CASE WHEN asset_id % 2 = 0 THEN timestamp_ms ELSE timestamp_ms // 1000 * 1000 - 9000000 END AS ms FROM ge")
_add("durations", lambda s, d: geo_events(s, d).select("asset_id", values.duration_ms(F.col("timestamp_ms"), F.col("end_timestamp_ms") - 7_200_000).alias("ms")),
     f"WITH {GEO_SQL} SELECT asset_id, CASE WHEN end_timestamp_ms - 7200000 >= timestamp_ms THEN end_timestamp_ms - 7200000 - timestamp_ms END AS ms FROM ge")
_add("distance_labels", lambda s, d: geo_events(s, d).select("asset_id", values.distance_label(F.col("asset_id") * 37.0 + 0.25).alias("label")),
     f"WITH {GEO_SQL}, m AS (SELECT asset_id, asset_id * CAST(37 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x FROM ge) SELECT asset_id, CASE WHEN x < 1000 THEN format('{{}} m', CAST(x AS BIGINT)) WHEN x < 100000 THEN format('{{:.2f}} km', x / 1000) ELSE format('{{}} km', CAST(floor(x / 1000 + 0.5) AS BIGINT)) END AS label FROM m")


def _maps() -> tuple[Column, Column]:
    return F.create_map(F.lit("a"), F.col("kind"), F.lit("b"), F.when(F.col("asset_id") % 2 == 0, F.lit("x"))), F.create_map(F.lit("b"), F.lit("y"), F.lit("c"), F.col("event_type"))


_add("count_labels", lambda s, d: geo_events(s, d).select("asset_id", values.count_label(F.col("asset_id") * 709 % 3_000_017).alias("label")),
     f"WITH {GEO_SQL}, m AS (SELECT asset_id, asset_id * 709 % 3000017 AS n FROM ge) SELECT asset_id, CASE WHEN n >= 1000000 THEN format('{{:.1f}}M', round(n / CAST(100000 AS DOUBLE)) / 10) WHEN n >= 10000 THEN CAST((n + 500) // 1000 AS VARCHAR) || 'k' WHEN n >= 1000 THEN format('{{:.1f}}k', round(n / CAST(100 AS DOUBLE)) / 10) ELSE CAST(n AS VARCHAR) END AS label FROM m")
_add("item_line_sources", lambda s, d: geo_events(s, d).select("asset_id", values.item_line_source(F.when(F.col("asset_id") % 3 == 0, F.lit("gps")).when(F.col("asset_id") % 3 == 1, F.lit(" ")), F.create_map(F.lit("source"), F.when(F.col("asset_id") % 2 == 0, F.lit("Wi_Fi")))).alias("source")),
     f"WITH {GEO_SQL} SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN 'GPS' WHEN asset_id % 2 = 0 THEN 'WIFI' ELSE 'UNKNOWN' END AS source FROM ge")


def _shown(s: SparkSession, d: str) -> DataFrame:
    return _read(readers.read_records, _records(s, d), s).withColumn("locations", F.array("location"))


_add("item_facts", lambda s, d: _shown(s, d).select("media_id", F.explode(facts.item_facts()).alias("f")).select("media_id", "f.label", "f.value"),
     f"""WITH {_PLACED}, ok AS (SELECT {_HASH} AS media_id, asset_id FROM ft WHERE timestamp_ms IS NOT NULL)
  SELECT media_id, 'dataset' AS label, 'google_records' AS value FROM ok UNION ALL SELECT media_id, 'source', 'WIFI' FROM ok WHERE asset_id % 5 <> 0 UNION ALL SELECT media_id, 'accuracy', (asset_id % 100) || ' m' FROM ok WHERE asset_id % 4 <> 0""")
_add("item_source_types", lambda s, d: _shown(s, d).select("media_id", F.array_join(facts.source_types(), ",").alias("types")),
     f"WITH {_PLACED} SELECT {_HASH} AS media_id, CASE WHEN asset_id % 5 <> 0 THEN 'WIFI' ELSE '' END AS types FROM ft WHERE timestamp_ms IS NOT NULL")
_add("group_labels", lambda s, d: _read(readers.read_timeline, _timeline(s, d), s).filter("group_id is not null").select("group_id", facts.group_label(F.col("group_id")).alias("label")),
     f"WITH t AS ({_TIMELINE_SQL}) SELECT group_id, 'segment ' || string_split(group_id, ':')[3] AS label FROM t WHERE group_id IS NOT NULL")
_add("stable_json", lambda s, d: geo_events(s, d).select("asset_id", values.stable_json(F.when(F.col("asset_id") % 2 == 0, F.format_string('{"b": {"y": [%d, {"q": 1, "p": "%s"}], "x": null}, "a": true}', "asset_id", "kind")).otherwise(F.format_string('{"a":true,"b":{"x":null,"y":[%d,{"p":"%s","q":1}]}}', "asset_id", "kind"))).alias("json")),
     f"""WITH {GEO_SQL} SELECT asset_id, '{{"a":true,"b":{{"x":null,"y":[' || asset_id || ',{{"p":"' || kind || '","q":1}}]}}}}' AS json FROM ge""")


def _misordered(s: SparkSession, d: str) -> DataFrame:
    """The nearest items by the index against those of a full scan, once as they are and once with the places 10 and 11 swapped."""
    at = lambda df: df.select("media_id", "distance_m").withColumn("pos", F.monotonically_increasing_id())  # noqa: E731  one partition, in order
    want, got = at(search.knn_page(geo_events(s, d), _NEAR)), at(_index(s, d).knn_page(_NEAR))
    swapped = got.withColumn("pos", F.when(F.col("pos").isin(10, 11), 21 - F.col("pos")).otherwise(F.col("pos")))
    return search.validate_order(want, got).withColumn("swapped", F.lit(False)).unionByName(search.validate_order(want, swapped).withColumn("swapped", F.lit(True)))


_add("validated_order", _misordered, f"""WITH k AS (SELECT media_id, row_number() OVER () - 1 AS pos FROM ({ORACLES['knn_basic']}))
  SELECT a.pos, a.media_id AS expected, b.media_id AS got, 'value' AS why, TRUE AS swapped FROM k a JOIN k b ON a.pos + b.pos = 21 WHERE a.pos IN (10, 11)""")
_add("metadata_merge", lambda s, d: geo_events(s, d).select("asset_id", values.merged_metadata(*_maps()).alias("m")).select("asset_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c")),
     f"WITH {GEO_SQL} SELECT asset_id, kind AS a, CASE WHEN asset_id % 2 = 0 THEN 'x' ELSE 'y' END AS b, event_type AS c FROM ge")
_add("media_kinds", lambda s, d: geo_events(s, d).select("asset_id", values.media_kind(F.when(F.col("asset_id") % 4 == 0, "video/mp4").otherwise(""), F.concat(F.lit("d/f."), F.element_at(F.array(*map(F.lit, ("JPG", "mov", "txt"))), (F.col("asset_id") % 3 + 1).cast("int")))).alias("kind")),
     f"WITH {GEO_SQL} SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'video' WHEN asset_id % 3 = 0 THEN 'image' WHEN asset_id % 3 = 1 THEN 'video' END AS kind FROM ge")
_add("string_helpers", lambda s, d: geo_events(s, d).select("asset_id", values.non_empty(F.when(F.col("asset_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "kind"))).alias("trimmed"), values.basename(F.concat(F.lit("a/b/"), "media_id")).alias("base"), values.file_occurrence_id(F.lit("s"), F.col("media_id")).alias("sha")),
     f"WITH {GEO_SQL} SELECT asset_id, CASE WHEN asset_id % 2 = 1 THEN kind END AS trimmed, media_id AS base, sha256('s' || chr(10) || media_id) AS sha FROM ge")
_add("bubble_radii", lambda s, d: geo_events(s, d).select("asset_id", bubbles.radius(F.col("asset_id") % 2000, 1.5).alias("r")),
     f"WITH {GEO_SQL}, m AS (SELECT asset_id, asset_id % 2000 AS n FROM ge) SELECT asset_id, CASE WHEN n <= 1 THEN 8 WHEN n < 10 THEN 10 WHEN n < 100 THEN 12 WHEN n < 1000 THEN 15 ELSE 18 END * {_d(1.5)} + 2 AS r FROM m")
_add("bubbles_merged_points", lambda s, d: bubbles.merge_overlapping(catalog_queries._grid(s, d, 3, 64.0), 3, 1.5).agg(F.sum("count").alias("points"), F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon")),
     f"WITH {GEO_SQL} SELECT count(*) AS points, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon FROM ge WHERE latitude IS NOT NULL AND longitude IS NOT NULL")

"""Readers of location histories: GPX, records JSON and timeline JSON, as items with one location each.

Files are read whole (one row each) and taken apart by built-in functions, so Spark reads many files at once. Large records
files are read by read_records_objects, which splits them at object boundaries. Every reader takes paths or globs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.geo import valid_coordinate
from cairn.functions.values import coordinate_pair, duration_ms, finite, geo_point_hash, iso_to_ms, location_id, non_empty, segment_group_id, semantic_hash, semantic_location_id, stable_json
from cairn.operators.catalog import as_items

#: What a position of a raw signal may hold; numbers are read as text, as exports write either.
_TEXT = "string"
RECORD = "struct<latitudeE7:string,longitudeE7:string,timestamp:string,timestampMs:string,timestamp_upper_ms:string,accuracy:string,altitude:string,verticalAccuracy:string,velocity:string,heading:string,source:string,deviceTag:string,platformType:string,formFactor:string,osLevel:string,serverTimestamp:string,deviceTimestamp:string,batteryCharging:string,activity:string>"
RECORD_METADATA = ("deviceTag", "platformType", "formFactor", "osLevel", "serverTimestamp", "deviceTimestamp", "batteryCharging", "activity")
SEGMENT = "struct<startTime:string,endTime:string,timelinePath:array<struct<point:string,time:string>>,visit:struct<hierarchyLevel:string,probability:string,topCandidate:struct<placeId:string,semanticType:string,probability:string,placeLocation:string>>,activity:struct<distanceMeters:string,probability:string,start:string,end:string,topCandidate:struct<type:string,probability:string>>>"
SIGNAL = "struct<position:struct<LatLng:string,timestamp:string,source:string,accuracyMeters:string,accuracy:string,altitudeMeters:string,altitude:string,speedMetersPerSecond:string,speed:string,headingDegrees:string,heading:string>,activityRecord:struct<timestamp:string,probableActivities:string>,wifiScan:string>"
PLACE = "struct<placeLocation:string,placeId:string,label:string>"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of each file as text."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def file_format(content: Column) -> Column:
    """gpx, records or timeline, by content; else a message that starts with 'error:'."""
    head = F.ltrim(F.regexp_replace(content, "^﻿", ""))
    json = head.startswith("{") | head.startswith("[")
    has = lambda *keys: F.coalesce(F.greatest(*[F.get_json_object(content, f"$.{k}").isNotNull() for k in keys], F.lit(False)), F.lit(False))
    return (
        F.when(json & has("locations"), "records")
        .when(json & has("semanticSegments", "rawSignals", "userLocationProfile"), "timeline")
        .when(json & has("timelineObjects"), "error: semantic location history files are not supported")
        .when(json & (F.get_json_object(content, "$.type").isin("FeatureCollection", "Feature")), "error: GeoJSON is not supported")
        .when(json, "error: unknown JSON")
        .when(head.startswith("<") & content.rlike("(?i)<([a-z0-9_]+:)?gpx[\\s>]"), "gpx")
        .otherwise("error: unknown format")
    )


@functools.lru_cache(64)
def _place(source_id: str, label: str | None, semantic: bool) -> Column:
    """The location of an item. Kept, as a stream asks for it in each batch, and making it takes hundreds of calls of the JVM."""
    identity = semantic_location_id(F.lit(source_id), F.col("media_id")) if semantic else location_id(F.lit(source_id), *[F.col(c) for c in ("media_id", "source_dataset", "source_type", "group_id", "sequence")])
    return F.struct(
        identity.alias("id"), F.lit(source_id).alias("source_id"), F.lit(label or source_id).alias("source_label"), F.lit(None).cast(_TEXT).alias("root_path"),
        F.element_at(F.split("path", "/"), -1).alias("relative_path"), F.col("path").alias("absolute_path"), F.col("index").cast("long").alias("point_index"),
        "source_dataset", "source_type", "group_id", F.col("sequence").cast("long").alias("sequence"), "timestamp_ms", F.col("end_timestamp_ms").cast("long").alias("end_timestamp_ms"),
    )


def _located(df: DataFrame, source_id: str, label: str | None, semantic: bool = False) -> DataFrame:
    """df's items with media_id, and the file and place in it as their location."""
    out = df.withColumn("location", _place(source_id, label, semantic)).withColumns({"source_id": F.lit(source_id), "relative_path": F.element_at(F.split("path", "/"), -1)})
    return as_items(out)


def _with(df: DataFrame, **columns) -> DataFrame:
    base = {c: F.lit(None).cast(t) for c, t in (("source_type", _TEXT), ("group_id", _TEXT), ("sequence", "long"), ("end_timestamp_ms", "long")) if c not in df.columns}
    return df.withColumns(base | columns)


def _judged(points: DataFrame) -> DataFrame:
    """points with ok: they have valid coordinates and a time. The values are made before; a filter on ok that were
    pushed into their expressions would parse the text anew for each use."""
    made = [c for c in points.columns if c not in ("path", "index")]
    once = points.select("path", "index", F.inline(F.array(F.struct(*made))))
    return once.withColumn("ok", valid_coordinate("latitude", "longitude") & F.col("timestamp_ms").isNotNull())


@functools.cache
def _gpx_columns() -> tuple[Column, list[Column]]:
    """The tags of a file, and the values of a tag; kept as _place() is."""
    tag = r"(?is)<(?:[a-z0-9_]+:)?(?:trkpt|rtept|wpt)\b[^>]*?(?:/>|>.*?</(?:[a-z0-9_]+:)?(?:trkpt|rtept|wpt)\s*>)"
    attribute = lambda name: finite(F.regexp_extract("tag", rf"""(?is)^<[^>]*?\s{name}\s*=\s*["']([^"']*)["']""", 1))
    time = iso_to_ms(F.regexp_extract("tag", r"(?is)<(?:[a-z0-9_]+:)?time\b[^>]*>\s*([^<]*?)\s*</", 1))
    return F.posexplode(F.regexp_extract_all("content", F.lit(tag), F.lit(0))).alias("index", "tag"), [(F.col("index") + 1).alias("index"), attribute("lat").alias("latitude"), attribute("lon").alias("longitude"), time.alias("timestamp_ms")]


def gpx_points(files: DataFrame) -> DataFrame:
    """(path, index, latitude, longitude, timestamp_ms, ok) of every point tag; index counts all of them from 1."""
    tags, values = _gpx_columns()
    return _judged(files.select("path", tags).select("path", *values))


def read_gpx(files: DataFrame, source_id: str, label: str | None = None) -> DataFrame:
    points = gpx_points(files).filter("ok")
    points = _with(points, kind=F.lit("geo_point"), media_id=geo_point_hash(F.col("latitude"), F.col("longitude"), F.col("timestamp_ms")), source_dataset=F.lit("gpx"))
    return _located(points, source_id, label)


def _record_points(rows: DataFrame) -> DataFrame:
    """rows (path, index, r: RECORD) with the fields of an item, and ok."""
    lat, lon = (finite(F.col(f"r.{c}E7")) / 1e7 for c in ("latitude", "longitude"))
    ms = F.coalesce(iso_to_ms(F.col("r.timestamp")), *[finite(F.col(f"r.{c}")).cast("long") for c in ("timestampMs", "timestamp_upper_ms")])
    meta = F.map_filter(F.create_map(*[x for k in RECORD_METADATA for x in (F.lit(k), F.col(f"r.{k}"))]), lambda _, v: v.isNotNull())
    return _judged(rows.select(
        "path", "index", lat.alias("latitude"), lon.alias("longitude"), ms.alias("timestamp_ms"), non_empty(F.col("r.source")).alias("source_type"), meta.alias("metadata"),
        *[finite(F.col(f"r.{a}")).alias(b) for a, b in (("accuracy", "accuracy_m"), ("altitude", "altitude_m"), ("verticalAccuracy", "vertical_accuracy_m"), ("velocity", "velocity_mps"), ("heading", "heading_deg"))],
    ))


def _one_case(text: Column) -> Column:
    """Column names don't tell timestampMS from timestampMs, so the former is renamed."""
    return F.regexp_replace(text, '"timestampMS"', '"timestamp_upper_ms"')


def record_points(files: DataFrame) -> DataFrame:
    parsed = files.select("path", F.from_json(_one_case(F.col("content")), f"struct<locations:array<{RECORD}>>").alias("j"))
    return _record_points(parsed.select("path", F.posexplode("j.locations").alias("index", "r")).withColumn("index", F.col("index") + 1))


def _record_items(points: DataFrame, source_id: str, label: str | None) -> DataFrame:
    found = _with(points.filter("ok"), kind=F.lit("geo_point"), media_id=geo_point_hash(F.col("latitude"), F.col("longitude"), F.col("timestamp_ms")), source_dataset=F.lit("google_records"))
    return _located(found, source_id, label)


def read_records(files: DataFrame, source_id: str, label: str | None = None) -> DataFrame:
    return _record_items(record_points(files), source_id, label)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\]]', re.S)


def _cut(piece: str) -> tuple[bool, str, str, int, bool]:
    """Of a piece between latitudes: is it its file's first, the rest of its location, what the next one begins with, the
    number of locations without a latitude that it holds, and whether the list of locations ends in it."""
    first = not piece.lstrip().startswith(":")
    head, n, closed, open_ = "", 0, False, [] if first else [-1]  # -1: the location that the latitude before stands in
    listed = not first
    for m in _TOKEN.finditer(piece):
        if m[0] == "{":
            open_.append(m.start())
        elif m[0] == "}" and open_:
            if open_.pop() == -1:
                head = piece[: m.end()]
            elif len(open_) == first:
                n += 1
        elif m[0] == "]" and len(open_) == first and listed:
            closed = True
            break
        elif m[0] == '"locations"' and len(open_) == first:
            n, listed = 0, True
    return first, head, piece[open_[-1] :] if open_ and open_[-1] >= 0 else "", n, closed


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cut = [_cut(x) for x in b.column(4).to_pylist()]
        kinds = (pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], *[pa.array([c[k] for c in cut], t) for k, t in enumerate(kinds)]], ["path", "bytes", "block", "at", "first", "head", "tail", "n", "closed"])


def record_texts(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """((path, index, text) of every location with a latitude, (path, bytes, n, closed) of every file): n locations; closed: their list ends.

    Spark splits the files at '"latitudeE7"', so that no task holds a whole one. A location is put together from the end of one
    piece and the start of the next, within a block of the file; what a block's last piece ends with, and its number of
    locations, go to the next block by a table of one row for a block.
    """
    text = spark.read.option("lineSep", '"latitudeE7"').text(paths)
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    pieces = text.mapInArrow(_cut_pieces, "path string, bytes long, block long, at long, first boolean, head string, tail string, n long, closed boolean")
    size = F.col("n") + F.when(F.col("first"), 0).otherwise(1)
    blocks = pieces.groupBy("path", "block").agg(F.sum(size).alias("size"), F.max_by("tail", "at").alias("last"), F.bool_or("closed").alias("closed"), F.first("bytes").alias("bytes"))
    file = Window.partitionBy("path").orderBy("block")
    carried = blocks.select("path", "block", F.lag("last").over(file).alias("last"), F.coalesce(F.sum("size").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("path", "block").orderBy("at")
    rows = pieces.withColumns({"start": F.lag("tail").over(within), "index": F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.join(carried, ["path", "block"]).filter(~F.col("first"))
    whole = F.concat(F.coalesce("start", "last"), F.lit('"latitudeE7"'), F.col("head"))
    files = blocks.groupBy("path").agg(F.first("bytes").alias("bytes"), F.sum("size").alias("n"), F.bool_or("closed").alias("closed"))
    return rows.select("path", (F.col("index") + F.col("before") + 1).alias("index"), whole.alias("text")), files


def record_items(texts: DataFrame, source_id: str, label: str | None = None) -> DataFrame:
    """Items of (path, index, text) rows of record_texts()."""
    return _record_items(_record_points(texts.select("path", "index", F.from_json(_one_case(F.col("text")), RECORD).alias("r"))), source_id, label)


def read_records_objects(spark: SparkSession, paths: str | list[str], source_id: str, label: str | None = None) -> DataFrame:
    """As read_records, of files too large for a row: no task holds a whole one."""
    return record_items(record_texts(spark, paths)[0], source_id, label)


def _pair(text: Column) -> Column:
    """struct(lat, lon) from a coordinate string or an object with latLng or E7 fields."""
    inner = F.coalesce(F.get_json_object(text, "$.LatLng"), F.get_json_object(text, "$.latLng"), text)
    lat, lon = (finite(F.get_json_object(text, f"$.{c}E7")) / 1e7 for c in ("latitude", "longitude"))
    found = F.coalesce(F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon"))), coordinate_pair(inner))
    return F.when(F.contains(text, F.lit("{")), found).otherwise(coordinate_pair(text))  # text that isn't JSON costs an exception in each lookup


def _listed(df: DataFrame, items: str, *names: str) -> DataFrame:
    """(names, index, s) of each item of an array. The outer form, as Spark would compute the array twice more to filter empty ones."""
    return df.select(*names, F.posexplode_outer(items).alias("index", "s")).filter("index is not null")


def read_timeline(files: DataFrame, source_id: str, label: str | None = None) -> DataFrame:
    """Items of a timeline export: raw positions and activity samples, then segments' path points, visits and activities, then places."""
    shape = f"struct<semanticSegments:array<{SEGMENT}>,rawSignals:array<{SIGNAL}>,userLocationProfile:struct<frequentPlaces:array<{PLACE}>>>"
    one_case = F.regexp_replace("content", r'"latLng"(\s*:\s*)', '"LatLng"$1')
    j = files.select("path", F.from_json(one_case, shape).alias("j"))
    signal = _listed(j, "j.rawSignals", "path")
    segment = _listed(j, "j.semanticSegments", "path")
    place = _listed(j, "j.userLocationProfile.frequentPlaces", "path")

    def at(df: DataFrame, pair: Column) -> DataFrame:
        return df.withColumn("at", pair).filter("at is not null").withColumns({"latitude": F.col("at.lat"), "longitude": F.col("at.lon")})

    def either(*names: str) -> Column:
        return F.coalesce(*[finite(F.col(f"s.position.{n}")) for n in names])

    def known(**values: Column) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())

    raw = at(signal, _pair(F.col("s.position.LatLng"))).withColumn("timestamp_ms", iso_to_ms(F.col("s.position.timestamp"))).filter("timestamp_ms is not null")
    raw = _with(
        raw, kind=F.lit("geo_point"), media_id=geo_point_hash(F.col("latitude"), F.col("longitude"), F.col("timestamp_ms")), source_dataset=F.lit("google_timeline_raw_signals"), source_type=non_empty(F.col("s.position.source")),
        accuracy_m=either("accuracyMeters", "accuracy"), altitude_m=either("altitudeMeters", "altitude"), velocity_mps=either("speedMetersPerSecond", "speed"), heading_deg=either("headingDegrees", "heading"),
    )
    listed = F.col("s.activityRecord.probableActivities")  # what is no list counts as an empty one
    activities = F.when(F.ltrim(listed).startswith("["), F.coalesce(stable_json(listed), listed)).otherwise(F.lit("[]"))
    sample = signal.filter("s.activityRecord is not null").withColumn("timestamp_ms", iso_to_ms(F.col("s.activityRecord.timestamp"))).filter("timestamp_ms is not null")
    sample = _with(sample, kind=F.lit("activity_sample"), source_dataset=F.lit("google_timeline_raw_signals"), source_type=F.lit("activity_record"), metadata=known(probableActivities=activities))
    sample = sample.withColumn("media_id", semantic_hash(F.col("kind"), F.col("timestamp_ms"), activities))

    times = segment.withColumns({"start_ms": iso_to_ms(F.col("s.startTime")), "stop_ms": iso_to_ms(F.col("s.endTime"))})
    # Only paths of more than one valid point are groups; the place in the file's path is the sequence.
    steps = F.filter(F.transform("s.timelinePath", lambda p, i: F.struct(i.cast("long").alias("i"), _pair(p["point"]).alias("at"), iso_to_ms(p["time"]).alias("ms"))), lambda p: p["at"].isNotNull() & p["ms"].isNotNull())
    path = times.withColumn("steps", steps).select("*", F.explode_outer("steps").alias("step")).filter("step is not null")
    path = path.withColumns({"latitude": F.col("step.at.lat"), "longitude": F.col("step.at.lon"), "timestamp_ms": F.col("step.ms")})
    grouped = F.size("steps") > 1
    path = _with(
        path, kind=F.lit("geo_point"), media_id=geo_point_hash(F.col("latitude"), F.col("longitude"), F.col("timestamp_ms")), source_dataset=F.lit("google_timeline"), source_type=F.lit("timeline_path"),
        group_id=F.when(grouped, segment_group_id(F.col("index"), F.col("s.startTime"), F.col("s.endTime"))), sequence=F.when(grouped, F.col("step.i")),
    )
    interval = {"timestamp_ms": F.col("start_ms"), "end_timestamp_ms": F.col("stop_ms"), "duration_ms": duration_ms(F.col("start_ms"), F.col("stop_ms")), "source_dataset": F.lit("google_timeline")}
    visit = at(times.filter("s.visit is not null and start_ms is not null"), _pair(F.col("s.visit.topCandidate.placeLocation")))
    v = "s.visit.topCandidate"
    visit = _with(visit, **interval, kind=F.lit("timeline_visit"), source_type=F.lit("visit"), metadata=known(placeId=F.col(f"{v}.placeId"), semanticType=F.col(f"{v}.semanticType"), probability=F.col("s.visit.probability"), candidateProbability=F.col(f"{v}.probability"), hierarchyLevel=F.col("s.visit.hierarchyLevel")))
    visit = visit.withColumn("media_id", semantic_hash(F.col("kind"), F.col("timestamp_ms"), F.col("end_timestamp_ms"), F.format_string("%.9f", "latitude"), F.format_string("%.9f", "longitude"), F.col(f"{v}.placeId")))
    move = at(times.filter("s.activity is not null and start_ms is not null"), _pair(F.col("s.activity.start"))).withColumn("to", _pair(F.col("s.activity.end")))
    a = "s.activity"
    move = _with(move, **interval, kind=F.lit("timeline_activity"), source_type=F.lit("activity"), metadata=known(activityType=F.col(f"{a}.topCandidate.type"), probability=F.col(f"{a}.topCandidate.probability"), distanceMeters=finite(F.col(f"{a}.distanceMeters")), endLatitude=F.col("to.lat"), endLongitude=F.col("to.lon")))
    move = move.withColumn("media_id", semantic_hash(F.col("kind"), F.col("timestamp_ms"), F.col("end_timestamp_ms"), F.format_string("%.9f", "latitude"), F.format_string("%.9f", "longitude"), F.col(f"{a}.topCandidate.type")))
    place = _with(at(place, _pair(F.col("s.placeLocation"))), kind=F.lit("frequent_place"), timestamp_ms=F.lit(None).cast("long"), source_dataset=F.lit("google_timeline"), source_type=F.lit("frequent_place"), metadata=known(placeId=F.col("s.placeId"), label=F.col("s.label")))
    place = place.withColumn("media_id", semantic_hash(F.col("kind"), F.format_string("%.9f", "latitude"), F.format_string("%.9f", "longitude"), F.col("s.placeId"), F.col("s.label")))

    out = None
    for df, semantic in ((raw, False), (sample, True), (path, False), (visit, True), (move, True), (place, True)):
        part = _located(df.withColumn("index", F.col("index") + 1), source_id, label, semantic)
        out = part if out is None else out.unionByName(part)
    return out


#: Bytes from which a file is no longer read as one row.
LARGE_BYTES = 256 << 20


def read_locations(spark: SparkSession, paths: str | list[str], source_id: str, label: str | None = None, large_bytes: int = LARGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(items of all files whose format is known, (path, error) of the others); an unfit file doesn't stop the rest.

    Files of more than large_bytes are read as records only, in splits; other formats of that size are errors.
    """
    listed = spark.read.format("binaryFile").load(paths).filter(F.col("length") > large_bytes).select("path")  # no contents are read
    large = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in listed.collect()]  # large files are few
    rows = spark.read.text(paths, wholetext=True).filter(F.col("_metadata.file_size") <= large_bytes)  # others aren't opened
    files = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).withColumn("format", file_format(F.col("content")))
    of = lambda name: files.filter(F.col("format") == name)
    items = read_gpx(of("gpx"), source_id, label).unionByName(read_records(of("records"), source_id, label)).unionByName(read_timeline(of("timeline"), source_id, label))
    errors = files.filter(F.col("format").startswith("error:")).select("path", F.substring("format", 8, 200).alias("error"))
    if large:
        texts, whole = record_texts(spark, large)
        items = items.unionByName(record_items(texts, source_id, label))
        errors = errors.unionByName(whole.filter("n = 0 or not closed").select("path", F.lit("a large file without a closed list of locations").alias("error")))
    return items, errors

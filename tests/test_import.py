import json

import pytest
from pyspark.sql import functions as F

from cairn.operators.catalog import Catalog
from cairn.sources import readers
from cairn.sources.media import read_media_folder
from cairn.streaming.ingest import stream_imports

GPX = """<?xml version="1.0"?><g:gpx><WPT lon="-58.4" lat="-34.6"><time>2024-01-01T01:00:02.250+01:00</time></WPT><rte><rtept lat='-34.7' lon='-58.5'/>
<rtept lat="7" lon="-180.5"><time>2024-01-01T00:00:07Z</time></rtept></rte><trk><trkseg><g:trkpt lon="11.5" lat="48.1"><hdop>3</hdop>
<g:time>2024-01-01T00:00:00Z</g:time></g:trkpt></trkseg></trk></g:gpx>"""
RECORDS = {"locations": [{"latitudeE7": 481000000, "longitudeE7": "115000000", "timestamp": "2024-01-01T00:00:00.5Z", "accuracy": 12, "source": "WIFI", "activity": [{"x": 1}], "other": 1}, {"latitudeE7": 481000000, "longitudeE7": 115000000, "timestampMS": "1704067201000"}, {"latitudeE7": 981000000, "longitudeE7": 1}]}
TIMELINE = {
    "semanticSegments": [
        {"startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T01:00:00Z", "timelinePath": [{"point": "48.1°, 11.5°", "time": "2024-01-01T00:10:00Z"}, {"point": "bad", "time": "x"}, {"point": "48.2°, 11.6°", "time": "2024-01-01T00:20:00Z"}]},
        {"startTime": "2024-01-01T00:30:00Z", "endTime": "2024-01-01T00:40:00Z", "timelinePath": [{"point": "48.5°, 11.5°", "time": "2024-01-01T00:31:00Z"}]},
        {"startTime": "2024-01-01T01:00:00Z", "endTime": "2024-01-01T02:00:00Z", "visit": {"hierarchyLevel": 0, "probability": 0.9, "topCandidate": {"placeId": "P", "semanticType": "HOME", "probability": 0.5, "placeLocation": {"latLng": "48.1°, 11.5°"}}}},
        {"startTime": "2024-01-01T02:00:00Z", "endTime": "2024-01-01T03:00:00Z", "activity": {"distanceMeters": 100.5, "start": {"latLng": "48.1°, 11.5°"}, "end": {"latLng": "48.3°, 11.7°"}, "topCandidate": {"type": "WALKING", "probability": 0.7}}},
    ],
    "rawSignals": [{"position": {"LatLng": "48.1°, 11.5°", "accuracyMeters": 5, "timestamp": "2024-01-01T00:00:00Z", "source": "GPS"}}, {"wifiScan": {}}, {"activityRecord": {"timestamp": "2024-01-01T00:00:05Z", "probableActivities": [{"type": "STILL", "confidence": 0.9}]}}],
    "userLocationProfile": {"frequentPlaces": [{"placeLocation": "48.1°, 11.5°", "placeId": "P", "label": "HOME"}]},
}


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, content in (("a.gpx", GPX), ("Records.json", RECORDS), ("Timeline.json", TIMELINE), ("old.json", {"timelineObjects": []}), ("g.geojson", {"type": "FeatureCollection"}), ("x.json", {"y": 1}), ("t.txt", "hello")):
        (d / name).write_text(content if isinstance(content, str) else json.dumps(content))
    return d


def test_gpx_counts_all_tags(spark, folder):
    rows = readers.gpx_points(readers.read_files(spark, str(folder / "a.gpx"))).orderBy("index").collect()
    assert [(r["index"], r.ok, r.timestamp_ms) for r in rows] == [(1, True, 1704067202250), (2, False, None), (3, False, 1704067207000), (4, True, 1704067200000)]


def test_records_times_and_metadata(spark, folder):
    files = readers.read_files(spark, str(folder / "Records.json"))
    rows = readers.read_records(files, "s").orderBy("timestamp_ms").collect()
    assert [r.timestamp_ms for r in rows] == [1704067200500, 1704067201000]
    assert rows[0].metadata == {"activity": '[{"x":1}]'} and rows[0].accuracy_m == 12 and rows[0].source_type == "WIFI"
    assert [r.location.point_index for r in rows] == [1, 2]
    split = readers.read_records_objects(spark, str(folder / "Records.json"), "s").collect()
    assert {r.media_id for r in split} == {r.media_id for r in rows}


@pytest.mark.parametrize("block", [400, 10_000_000])
def test_split_records_equal_whole_ones(spark, tmp_path, block):
    late = lambda k: {"timestampMs": str(1704067200000 + k), "activity": [{"x": {"y": "} {"}}], "source": "a\"{", "accuracy": k, "latitudeE7": 481000000 + k, "longitudeE7": 115000000, "altitude": 3}
    early = lambda k: {"latitudeE7": 471000000 + k, "longitudeE7": 1, "timestampMs": str(1704067200000 + k)}
    rows = [late(0), {"timestampMs": "1"}, {"a": {"b": 1}}, early(2), late(3), {"source": "x"}, *[(late, early)[k % 3 == 0](k) for k in range(4, 40)]]
    for name, indent in (("a.json", None), ("b.json", 1)):
        (tmp_path / name).write_text(json.dumps({"info": {"z": {}}, "locations": rows, "end": {"e": 1}}, indent=indent))
    whole = readers.read_records(readers.read_files(spark, str(tmp_path)), "s").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        split = readers.read_records_objects(spark, str(tmp_path), "s").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(whole) == 78 and sorted(map(repr, split)) == sorted(map(repr, whole))


def test_timeline_kinds_and_groups(spark, folder):
    rows = readers.read_timeline(readers.read_files(spark, str(folder / "Timeline.json")), "s").collect()
    assert sorted(r.kind for r in rows) == ["activity_sample", "frequent_place", "geo_point", "geo_point", "geo_point", "geo_point", "timeline_activity", "timeline_visit"]
    path = sorted((r.sequence, r.group_id) for r in rows if r.source_type == "timeline_path" and r.group_id)
    assert path == [(0, "google_timeline_segment:v1:1:2024-01-01T00:00:00Z:2024-01-01T01:00:00Z"), (2, "google_timeline_segment:v1:1:2024-01-01T00:00:00Z:2024-01-01T01:00:00Z")]
    assert sum(r.source_type == "timeline_path" for r in rows) == 3  # one valid point makes no group
    visit = next(r for r in rows if r.kind == "timeline_visit")
    assert (visit.timestamp_ms, visit.end_timestamp_ms, visit.duration_ms, visit.metadata["placeId"]) == (1704070800000, 1704074400000, 3600000, "P")
    move = next(r for r in rows if r.kind == "timeline_activity")
    assert move.metadata["endLatitude"] == "48.3" and next(r for r in rows if r.kind == "frequent_place").timestamp_ms is None


def test_folder_import_collects_errors(spark, folder):
    items, errors = readers.read_locations(spark, str(folder), "s")
    assert items.count() == 2 + 2 + 8 and errors.count() == 4


def test_large_files_are_read_in_splits(spark, folder):
    small, _ = readers.read_locations(spark, str(folder / "Records.json"), "s")
    size = (folder / "Records.json").stat().st_size
    for paths in (str(folder / "Records.json"), [str(folder / "Records.json")]):
        large, errors = readers.read_locations(spark, paths, "s", large_bytes=size - 1)
        assert {r.media_id for r in large.collect()} == {r.media_id for r in small.collect()} and errors.count() == 0
    _, errors = readers.read_locations(spark, str(folder), "s", large_bytes=10)
    assert errors.filter("error like 'a large file%'").count() > 2


def test_catalog_generations_and_index_version(spark, folder, tmp_path):
    items, _ = readers.read_locations(spark, str(folder), "s1", "Mine")
    c = Catalog(spark, str(tmp_path / "catalog"))
    c.upsert_source("s1", "Mine")
    g = c.prepare_import("s1")
    c.append(items, g)
    with pytest.raises(RuntimeError):
        c.assets()
    assets = c.materialise()
    n = c.count_media()
    assert n == 11 and sorted(r.asset_id for r in assets.collect()) == list(range(n))  # the first GPX point and a raw position are one
    both = assets.filter("size(locations) = 2").collect()
    assert len(both) == 1 and both[0].accuracy_m == 5
    assert c.groups().count() == 1 and c.group_points().count() == 2
    g2 = c.prepare_import("s1")
    c.append(items.filter("kind = 'timeline_visit'"), g2)
    c.materialise()
    assert c.count_media() == 1 and [s.source_id for s in c.list_sources().collect()] == ["s1"]
    c.remove_sources(["s1"])
    c.materialise()
    assert c.count_media() == 0 and c.list_sources().count() == 0
    c.clear()
    assert not (tmp_path / "catalog").exists()


def test_streaming_import_is_repeatable(spark, folder, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    for k in range(2):
        stream_imports(spark, str(folder), c, "s1", str(tmp_path / f"check{k}"), files_per_batch=3).awaitTermination()
        assert c.count_media() == 11


def test_batches_without_items(spark, folder, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    assert c.materialise().count() == 0
    nothing, _ = readers.read_locations(spark, str(folder / "t.txt"), "007")
    c.append(nothing, c.prepare_import("007"))
    assert c.materialise().count() == 0 and c.count_media() == 0
    items, _ = readers.read_locations(spark, str(folder / "Records.json"), "007")
    c.append(items, 1, 1)
    assert {r.source_id for r in c.materialise().collect()} == {"007"} and c.count_media() == 2


def test_order_of_many_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    from cairn.operators.catalog import LOCATION

    row = spark.range(0, 130, 1, 130)
    place = F.struct(*[(F.lit("p") if f.name == "id" else F.col("id") if f.name == "timestamp_ms" else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOCATION])
    items = row.select(F.lit("m").alias("media_id"), F.lit("s").alias("source_id"), F.expr("if(id >= 5, id, null)").alias("duration_ms"), place.alias("location"))
    c = Catalog(spark, str(tmp_path / "catalog"))
    g = c.prepare_import("s")
    c.append(items, g)
    asset = c.materialise().first()
    assert asset.duration_ms == 5 and [x.timestamp_ms for x in asset.locations] == [129]
    c.append(items.filter("id < 9"), g, 1)
    asset = c.materialise().first()
    assert asset.duration_ms == 5 and [x.timestamp_ms for x in asset.locations] == [8]


def test_media_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("x/A.JPG", "b.mov", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    rows = read_media_folder(spark, str(tmp_path), "s").collect()
    assert sorted((r.kind, r.relative_path, r.display_name) for r in rows) == [("image", "x/A.JPG", "A.JPG"), ("video", "b.mov", "b.mov")]


def test_import_in_steps(spark, tmp_path):
    import json
    import random

    from cairn.operators.cancel import Cancellable, Cancelled
    from cairn.sources.readers import read_files, read_records
    from cairn.sources.steps import Unfinished, import_in_steps, import_step

    rng = random.Random(4)
    place = lambda k: {**({"latitudeE7": k * 1000, "longitudeE7": 5} if k % 11 else {"note": "]}[{"}), "timestampMs": str(k * 1000), "activity": [{"x": [k, {"y": "}]"}]}]}
    folder = tmp_path / "in"
    folder.mkdir()
    for name, n in (("a", 60), ("b", 7), ("none", 0)):
        (folder / name).write_text(json.dumps({"locations": [dict(rng.sample(sorted(place(k + 1).items()), len(place(k + 1)))) for k in range(n)], "other": [{"z": 1}]}))
    want = sorted(map(repr, read_records(read_files(spark, str(folder)), "s").select("media_id", "timestamp_ms", "location.point_index", "location.absolute_path").collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split, entries in (("700", 13), (old, 60), (old, 7)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            root, steps = str(tmp_path / f"c{split}{entries}"), 1
            job = Cancellable(spark)
            while import_step(Catalog(spark, root), str(folder), "s", entries):
                steps += 1
                if steps == 2:  # a cancelled step has no effect
                    job.cancel()
                    with pytest.raises(Cancelled):
                        import_step(Catalog(spark, root), str(folder), "s", entries, job)
            assert steps == -(-60 // entries)
            got = Catalog(spark, root).occurrences().select("media_id", "timestamp_ms", "location.point_index", "location.absolute_path")
            assert sorted(map(repr, got.collect())) == want
            assert import_in_steps(Catalog(spark, root), str(folder), "s", entries) == 1 and Catalog(spark, root).occurrences().count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = (folder / "a").read_text()
    c = Catalog(spark, str(tmp_path / "cut"))
    (tmp_path / "cut.json").write_text(whole[: whole.index('"timestampMs": "40000"')])
    with pytest.raises(Unfinished):
        import_in_steps(c, str(tmp_path / "cut.json"), "s", 20)
    assert 30 < c.occurrences().count() < 40
    (tmp_path / "cut.json").write_text(whole)
    with pytest.raises(ValueError, match="changed"):
        import_step(c, str(tmp_path / "cut.json"), "s", 20)
    (tmp_path / "odd.json").write_text('{"places": []}')
    with pytest.raises(Unfinished):
        import_in_steps(Catalog(spark, str(tmp_path / "odd")), str(tmp_path / "odd.json"), "s")


def test_timeline_files_are_parsed_once_a_kind_and_plain_places_are_no_json(spark, tmp_path):
    segment = '{"startTime":"2024-01-01T00:00:00Z","endTime":"2024-01-01T01:00:00Z","timelinePath":[{"point":"1.5°, 2.5°","time":"2024-01-01T00:00:00Z"},{"point":"{\\"latLng\\":\\"3.5°, 4.5°\\"}","time":"2024-01-01T00:01:00Z"}]}'
    (tmp_path / "t.json").write_text('{"semanticSegments":[null,' + segment + "]}")
    found = readers.read_timeline(readers.read_files(spark, str(tmp_path)), "s").filter("group_id is not null")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert [(r.latitude, r.longitude, r.sequence) for r in found.orderBy("sequence").collect()] == [(1.5, 2.5, 0), (3.5, 4.5, 1)]


def test_an_exported_folder_has_a_file_a_row_and_no_folders(spark, tmp_path):
    import os

    from cairn.plans.import_queries import _written

    rows = spark.range(10).select(F.col("id").alias("asset_id"))
    path = _written(rows, 3, F.when(F.col("asset_id") < 8, F.col("asset_id").cast("string")), "[", "]", ",", "")
    names = [n for n in os.listdir(path.removeprefix("file:")) if n.endswith(".txt")]
    assert len(names) == 3  # none for the ids from 9 on
    assert sorted(r.content.strip() for r in readers.read_files(spark, path).collect()) == ["[0,1,2]", "[3,4,5]", "[6,7]"]


def test_streamed_batches_are_merged_together_and_all_at_the_end(spark, folder, tmp_path, monkeypatch):
    merges = []
    once = Catalog.materialise
    monkeypatch.setattr(Catalog, "materialise", lambda self, full=False: merges.append(1) or once(self, full))
    root = tmp_path / "many"
    root.mkdir()
    for k in range(5):
        (root / f"{k}.gpx").write_text(f'<gpx><trkpt lat="{k}" lon="1"><time>2024-01-01T00:00:0{k}Z</time></trkpt></gpx>')
    c = Catalog(spark, str(tmp_path / "catalog"))
    stream_imports(spark, str(root), c, "s", str(tmp_path / "check"), files_per_batch=1).awaitTermination()
    assert len(c._now["appends"]) == 5 and len(merges) < 5
    assert c.up_to_date() and c.assets().count() == 5


def test_texts_are_not_parsed_again_to_filter_them(spark, folder):
    files = readers.read_files(spark, str(folder))
    for items, parse in ((readers.read_gpx(files, "a"), "regexp_extract"), (readers.read_records(files, "b"), "try_to_timestamp")):
        plan = items._jdf.queryExecution().optimizedPlan().toString().splitlines()
        filters = [x for x in plan if x.lstrip(" :+-").startswith("Filter")]
        assert filters and not any(parse in x for x in filters)


def test_a_streamed_batch_has_two_jobs_and_a_small_stream_one_merge(spark, folder, tmp_path, monkeypatch):
    merges, once = [], Catalog.materialise
    monkeypatch.setattr(Catalog, "materialise", lambda self, full=False: merges.append(1) or once(self, full))
    root = tmp_path / "many"
    root.mkdir()
    for k in range(6):
        (root / f"{k}.gpx").write_text(f'<gpx><trkpt lat="{k}" lon="1"><time>2024-01-01T00:00:0{k}Z</time></trkpt></gpx>')
    c = Catalog(spark, str(tmp_path / "catalog"))
    query = stream_imports(spark, str(root), c, "s", str(tmp_path / "check"), files_per_batch=1)
    query.awaitTermination()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))
    assert len(jobs) == 2 * 6 and len(merges) == 1
    assert c.up_to_date() and c.assets().count() == 6

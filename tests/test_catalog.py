"""The stored catalog: incremental builds, repeated batches, compaction, re-scans, cancellation, and pages by the index."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators import index as ix
from cairn.operators import search
from cairn.operators.cancel import Cancellable, Cancelled
from cairn.operators.catalog import LOCATION, Catalog, as_items
from cairn.plans import catalog_queries
from cairn.plans.spec import Bounds, SearchSpec
from cairn.plans.views import geo_events
from cairn.sources.media import read_media_folder
from cairn.sources.rescan import location_files, media_files, rescan, rescan_all

DATA = "/root/testdata/sf0.001"


def items(spark, rows, source="s"):
    """Items of (media id, file, values): values is a dict of columns."""
    shape = "media_id string, path string, name string, ms long, size long, lat double, tag string, grp string"
    df = spark.createDataFrame([(m, p, v.get("name"), v.get("ms"), v.get("size"), v.get("lat"), v.get("tag"), v.get("grp")) for m, p, v in rows], shape)
    known = {"id": F.concat("media_id", F.lit("@"), "path"), "source_id": F.lit(source), "relative_path": F.col("path"), "absolute_path": F.col("path"), "timestamp_ms": F.col("ms"), "group_id": F.col("grp")}
    place = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOCATION])
    meta = F.map_filter(F.create_map(F.lit("tag"), F.col("tag")), lambda _, v: v.isNotNull())
    return as_items(df.select("media_id", F.lit(source).alias("source_id"), F.lit("geo_point").alias("kind"), F.col("name").alias("display_name"), F.col("ms").alias("timestamp_ms"), F.col("size").alias("size_bytes"), F.col("lat").alias("latitude"), F.col("lat").alias("longitude"), F.col("grp").alias("group_id"), F.when(F.col("grp").isNotNull(), F.lit(1)).alias("sequence"), meta.alias("metadata"), place.alias("location")))


def content(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def assert_as_rebuilt(c):
    """Everything that is derived equals what a full build gives."""
    got = [content(t) for t in (c.assets(), c.time_index(), c.groups(), c.group_points())]
    other = Catalog(c.spark, c.root, c.per_range)
    with other.transaction() as s:
        other.materialise(full=True)
        want = [content(t) for t in (other.assets(), other.time_index(), other.groups(), other.group_points())]
        s.update(other._load())  # nothing is committed
    assert got == want
    assert [r.asset_id for r in c.assets().orderBy("media_id").collect()] == list(range(c.count_media()))


def numbered(lo, hi, step=1):
    return [(f"m{k:04d}", f"f{k % 7}", {"name": f"n{k}", "ms": 1000 * k, "size": k, "lat": (k % 80) + 0.5, "tag": f"t{k}"}) for k in range(lo, hi, step)]


def test_batches_are_merged_as_in_a_full_build(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"), per_range=20)
    g = c.prepare_import("s")
    c.append(items(spark, numbered(0, 400, 2)), g)
    c.materialise()
    many = c.rewritten["assets"][1]
    assert many >= 8
    # A few ids in one place: new ones, and known ones with other values.
    c.append(items(spark, [("m0010", "g", {"name": "late", "ms": 5, "size": 99, "tag": "x"}), ("m0011", "g", {"ms": 7, "lat": 3.0}), ("m0012", "f5", {"ms": 1})]), g)
    c.materialise()
    assert c.rewritten["assets"][0] == 1 and c.rewritten["assets"][1] == many and c.rewritten["time"][0] <= 2
    row = c.assets().filter("media_id = 'm0010'").first()
    assert (row.timestamp_ms, row.size_bytes, row.metadata["tag"], len(row.locations), row.n_occurrences) == (10_000, 99, "t10", 2, 2)
    # Another source, and a group.
    c.append(items(spark, [(f"m{k:04d}", "z", {"ms": k, "grp": "trip", "lat": 1.0}) for k in (3, 200, 399)], "b"), c.prepare_import("b"))
    c.materialise()
    assert 0 < c.rewritten["assets"][0] <= 3 and c.groups().count() == 1
    assert_as_rebuilt(c)
    # A new generation takes occurrences back; so does a removed source.
    c.append(items(spark, numbered(0, 30)), c.prepare_import("s"))
    c.materialise()
    c.remove_sources(["b"])
    c.materialise()
    assert_as_rebuilt(c)
    assert c.groups().count() == 0 and c.count_media() == 30
    c.materialise()  # nothing to do
    assert c.rewritten["assets"][0] == 0


def test_a_range_that_grows_is_split(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"), per_range=10)
    g = c.prepare_import("s")
    c.append(items(spark, numbered(0, 5)), g)
    c.materialise()
    c.append(items(spark, numbered(0, 300)), g)
    c.materialise()
    c.remove_sources(["s"])
    assert c.materialise().count() == 0 and c.count_media() == 0
    c.upsert_source("s", "S")
    assert c.materialise().count() == 300
    assert_as_rebuilt(c)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"), per_range=50)
    g = c.prepare_import("s")
    for b in (1, 2, 3):
        c.append(items(spark, numbered(b * 10, b * 10 + 20)), g, b)
        c.materialise()
    want = content(c.assets())
    assert c.append(items(spark, numbered(20, 40)), g, 2)
    c.materialise()
    assert content(c.assets()) == want
    c.append(items(spark, numbered(20, 25)), g, 2)  # with other content it replaces what was there
    c.materialise()
    assert_as_rebuilt(c)
    assert c.assets().filter("media_id = 'm0026'").first().n_occurrences == 1
    c.compact()
    assert not c.append(items(spark, numbered(20, 40)), g, 2)  # it is part of a compacted folder
    for n in (5, 6):  # without numbers, appends are apart and in order
        c.append(items(spark, [("t", "p", {"ms": n})]), g)
    row = c.materialise().filter("media_id = 't'").first()
    assert (row.n_occurrences, row.timestamp_ms, row.locations[0].timestamp_ms) == (2, 5, 6)


def test_compaction_keeps_rows_and_readers(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"), per_range=40)
    g = c.prepare_import("s")
    for b in range(8):
        c.append(items(spark, numbered(b * 5, b * 5 + 15)), g, b)
        c.materialise()
    old, want = c.assets(), content(c.assets())
    occurrences = content(c.occurrences())
    c.append(items(spark, numbered(0, 3)), g, 8)  # not materialised yet: left alone
    counts = c.compact()
    assert counts["appends"] == (9, 2) and counts["assets"][1] <= 2
    files = [p for p in c.occurrences().inputFiles() if "bin_" in p]
    assert len(files) == 1
    assert content(old) == want  # a reader of the old version
    c.materialise()
    assert c.rewritten["assets"][0] == 1
    assert_as_rebuilt(c)
    assert c.compact()["appends"] == (2, 1) and set(occurrences) < set(content(c.occurrences()))
    assert c.vacuum() > 8 and len(c.commits()) == 1
    c.materialise(full=True)
    assert_as_rebuilt(c)
    with pytest.raises(Exception):
        old.collect()


def test_two_writers(spark, tmp_path):
    from cairn.operators.catalog import Conflict

    a, b = (Catalog(spark, str(tmp_path / "c")) for _ in range(2))
    with pytest.raises(Conflict), a.transaction():
        a.upsert_source("x", "X")
        b.upsert_source("y", "Y")
    assert [r.source_id for r in a.sources().collect()] == ["y"]


def gpx(folder, name, *seconds):
    points = "".join(f'<trkpt lat="{s % 80}" lon="8"><time>2024-01-01T00:00:{s:02d}Z</time></trkpt>' for s in seconds)
    (folder / name).write_text(f"<gpx>{points}</gpx>")


def test_rescan_reads_only_what_changed(spark, tmp_path):
    folder = tmp_path / "in [1]+é"
    folder.mkdir()
    for name, seconds in (("a b.gpx", (1, 2)), ("b.gpx", (2, 3)), ("c.gpx", (4,)), ("d+{x}.gpx", (5,))):
        gpx(folder, name, *seconds)
    (folder / "bad.txt").write_text("nothing")
    c = Catalog(spark, str(tmp_path / "c"), per_range=3)
    c.upsert_source("s", "S", str(folder).replace("[", "\\[").replace("]", "\\]"))
    read = []

    def reader(spark, paths, *rest):
        read.extend(paths)
        return location_files(spark, paths, *rest)

    times = lambda: sorted(r.timestamp_ms // 1000 % 60 for r in c.materialise().collect())
    got = rescan(c, "s", reader)
    assert (got["scanned"], got["added"], got["read"], got["n_errors"]) == (5, 5, 5, 1) and times() == [1, 2, 3, 4, 5]
    read.clear()
    assert rescan(c, "s", reader)["read"] == 0 and read == [] and c.materialise().count() == 5
    gpx(folder, "b.gpx", 3, 7, 8)
    gpx(folder, "e.gpx", 9)
    os.remove(folder / "c.gpx")
    os.utime(folder / "d+{x}.gpx", (1, 1))
    got = rescan(c, "s", reader)
    assert {k: got[k] for k in ("scanned", "added", "changed", "removed", "touched", "read")} == {"scanned": 5, "added": 1, "changed": 1, "removed": 1, "touched": 1, "read": 2}
    assert sorted(p.rsplit("/", 1)[1] for p in read) == ["b.gpx", "e.gpx"] and times() == [1, 2, 3, 5, 7, 8, 9]
    assert c.assets().filter("timestamp_ms % 60000 = 2000").first().n_occurrences == 1
    c.compact()
    assert_as_rebuilt(c)
    gpx(folder, "b.gpx", 11)
    rescan(c, "s", reader)
    assert times() == [1, 2, 5, 9, 11]


def test_rescan_of_all_folders(spark, tmp_path):
    for name in ("m", "t"):
        (tmp_path / name).mkdir()
    (tmp_path / "m" / "x.jpg").write_bytes(b"x")
    (tmp_path / "m" / "note.txt").write_bytes(b"n")
    gpx(tmp_path / "t", "a.gpx", 1)
    c = Catalog(spark, str(tmp_path / "c"))
    for i in ("m", "t", "gone"):
        c.upsert_source(i, i.upper(), str(tmp_path / i))
    c.upsert_source("none", "no folder")
    of = lambda i: media_files if i == "m" else location_files
    got = rescan_all(c, of)
    assert (got["scanned"], got["read"], got["n_errors"], got["cancelled"]) == (3, 3, 1, False) and got["errors"][0][1] == "the folder isn't there"
    assert sorted(r.kind for r in c.materialise().collect()) == ["geo_point", "image"]
    assert content(c.assets().filter("kind = 'image'").select("media_id")) == content(read_media_folder(spark, str(tmp_path / "m"), "m").select("media_id"))
    (tmp_path / "m" / "x.jpg").unlink()
    job = Cancellable(spark)
    job.cancel()
    assert rescan_all(c, of, job)["cancelled"]
    rescan_all(c, of)
    assert [r.kind for r in c.materialise().collect()] == ["geo_point"]


def test_a_cancelled_import_leaves_the_old_generation(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.append(items(spark, numbered(0, 10)), c.prepare_import("s"))
    c.materialise()
    commits, job, out = c.commits(), Cancellable(spark), []

    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    def run():
        own = Catalog(spark, c.root)
        rows = items(spark, numbered(100, 104))
        try:
            with job, own.transaction(job):
                own.append(rows.mapInArrow(slow, rows.schema), own.prepare_import("s"))
                own.materialise()
        except Exception as e:
            out.append(e)

    thread = threading.Thread(target=run)
    began = time.time()
    thread.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < began + 15:
        time.sleep(0.1)
    time.sleep(0.5)
    job.cancel()
    thread.join(60)
    assert isinstance(out[0], Cancelled) and time.time() < began + 19
    assert c.commits() == commits and c.count_media() == 10 and c.source("s")["generation"] == 1
    with pytest.raises(Cancelled), Cancellable(spark) as late:  # cancelled between jobs
        late.cancel()
    assert spark.range(3).count() == 3


def test_a_stream_is_cancelled_and_taken_back(spark, tmp_path):
    from cairn.streaming.ingest import cancel_stream, stream_imports

    folder = tmp_path / "in"
    folder.mkdir()
    gpx(folder, "a.gpx", 1, 2)
    c = Catalog(spark, str(tmp_path / "c"))
    stream_imports(spark, str(folder), c, "s", str(tmp_path / "check")).awaitTermination()
    before = c.commits()[-1]
    gpx(folder, "b.gpx", 3)
    query = stream_imports(spark, str(folder), c, "s", str(tmp_path / "check"))
    query.awaitTermination()
    assert c.count_media() == 3
    cancel_stream(query, c, "s", before)
    assert c.materialise().count() == 2
    assert_as_rebuilt(c)


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    points = geo_events(spark, "/root/testdata/sf0.01").cache()
    return points, ix.build_index(points, str(tmp_path_factory.mktemp("index")), per_range=60)


SPECS = [
    {}, {"order": "timestamp_asc", "offset": 100}, {"kind": "video"}, {"bounds": Bounds(0, -20, 50, 60)}, {"start_ms": catalog_queries.T1, "end_ms": catalog_queries.T2, "limit": 300},
    {"has_geo": False}, {"order": "timestamp_asc", "limit": 10_000}, {"kind": "nothing"}, {"offset": 9_990}, {"offset": 20_000}, {"start_ms": 1 << 60}, {"end_ms": -5},
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("spec", SPECS, ids=str)
def test_time_pages_by_the_index(layout, spec):
    points, index = layout
    spec = SearchSpec(**{"limit": 200, **spec})
    want = [(r.media_id, r.ts_sec) for r in search.time_page(points, spec, True).collect()]
    page = index.time_page(spec, True)
    assert [(r.media_id, r.ts_sec) for r in page.collect()] == want
    if spec == SearchSpec(limit=200):
        assert len(index.read) <= 6 and len(page.inputFiles()) == len(index.read) and index.time.rows > 9000


NEAR = [
    ({"center": (47.3769, 8.5417)}, 0.1), ({"center": (47.3769, 8.5417), "kind": "media"}, 0.15), ({"center": (47.3769, 8.5417), "start_ms": catalog_queries.T1, "end_ms": catalog_queries.T2}, 0.1),
    ({"center": (47.3769, 8.5417), "bounds": Bounds(-10, -20, 40, 40)}, 0.1), ({"center": (47.3769, 8.5417), "offset": 75}, 0.1), ({"center": (0, 179.95)}, 0.1), ({"center": (89.9, 15)}, 0.1), ({"center": (-90, 0), "limit": 3}, 0.1), ({"center": (10, 10), "kind": "nothing"}, 1.0),
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("spec,part", NEAR, ids=str)
def test_nearest_by_the_index(layout, spec, part):
    points, index = layout
    spec = SearchSpec(**{"order": "distance", "limit": 50, **spec})
    want = [(r.media_id, round(r.distance_m, 6)) for r in search.knn_page(points, spec, True).collect()]
    assert [(r.media_id, round(r.distance_m, 6)) for r in index.knn_page(spec, True).collect()] == want
    assert index.rows <= part * index.place.rows


@pytest.mark.parametrize("name", ["time_page_desc", "time_page_asc", "time_page_interval_overlap"])
def test_indexed_time_pages_of_long_ids(spark, tmp_path, name):
    """Media ids are cut to 7 digits, so ids beyond them neither follow asset ids nor are unique; many events of a second."""
    import duckdb

    from cairn.plans.import_queries import ORACLES, QUERIES

    rows = spark.range(500).select(F.explode(F.array(*[F.col("id") + x for x in (0, 999_990, 9_999_000, 10_000_000, 35_999_000)])).alias("event_id"), F.col("id").alias("user_id"))
    rows = rows.withColumns({"ts": F.timestamp_seconds(F.lit(catalog_queries.T1 // 1000) + F.col("user_id") % 2), "event_type": F.lit("view")})
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(ORACLES[f"indexed_{name}"])
    names = [d[0] for d in found.description]
    got = QUERIES[f"indexed_{name}"](spark, str(tmp_path)).collect()
    assert [tuple(r[c] for c in names) for r in got] == found.fetchall() and len(got) >= 200


def test_an_index_with_ties_is_updated(spark, tmp_path):
    rows = [(f"m{-k % 7}{k:03d}", 2 * k - 100, 1_000_000 + 1000 * (k % 2)) for k in range(100)]
    points = spark.createDataFrame(rows, "media_id string, asset_id long, timestamp_ms long").selectExpr("*", "'image' kind", "null::long end_timestamp_ms", "asset_id / 10.0D latitude", "1.0D longitude")
    index = ix.build_index(points, str(tmp_path / "i"), per_range=10, ties="asset_id")
    gone = points.filter("asset_id between -10 and 10")
    new = gone.selectExpr("* except (asset_id)", "asset_id + 1 asset_id")
    index, _ = ix.update_index(index, gone, new, str(tmp_path / "i"), per_range=10)
    want = search.time_page(points.join(gone, "asset_id", "left_anti").unionByName(new), SearchSpec(limit=200))
    assert [r.asset_id for r in index.time_page(SearchSpec(limit=200)).collect()] == [r.asset_id for r in want.collect()]


def test_nearest_of_one_place(spark, tmp_path):
    points = geo_events(spark, DATA).withColumns({c: F.floor(F.col(c) / 10) * 10.0 for c in ("latitude", "longitude")})
    index = ix.build_index(points, str(tmp_path), per_range=60)
    spec = SearchSpec(order="distance", center=(12, 34), limit=50)
    assert [r.media_id for r in index.knn_page(spec).collect()] == [r.media_id for r in search.knn_page(points, spec).collect()]


def test_lowest_distance_is_a_bound():
    import math
    import random

    rng = random.Random(5)
    for _ in range(2000):
        lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        a, b = sorted(rng.uniform(-90, 90) for _ in range(2))
        x, y = sorted(rng.uniform(-180, 180) for _ in range(2))
        low = ix.lowest_distance_m(lat, lon, {"min_lat": a, "max_lat": b, "min_lon": x, "max_lon": y})
        for _ in range(20):
            p, q = rng.choice([a, b, rng.uniform(a, b)]), rng.choice([x, y, rng.uniform(x, y)])
            h = math.sin(math.radians(p - lat) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(lat)) * math.sin(math.radians(q - lon) / 2) ** 2
            assert low <= 2 * 6_371_008.8 * math.asin(min(1, math.sqrt(h))) + 1e-3


def test_search_of_the_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"), per_range=25)
    c.append(items(spark, numbered(0, 200)), c.prepare_import("s"))
    c.append(items(spark, numbered(50, 60), "b"), c.prepare_import("b"))
    assets = c.materialise()
    for spec in (SearchSpec(limit=7, offset=3), SearchSpec(order="distance", center=(20.0, 20.0), limit=9), SearchSpec(source_id="b", limit=50), SearchSpec(kind="nothing")):
        got, want = c.search(spec).collect(), search.search(assets, spec).collect()
        assert [(r.pos, r.asset_id, r.source_id, len(r.locations)) for r in got] == [(r.pos, r.asset_id, r.source_id, len(r.locations)) for r in want]
    page = c.search(SearchSpec(limit=5))
    assert len([p for p in page.inputFiles()]) <= 2


def test_small_ranges_share_tasks_and_large_ones_do_not(spark, tmp_path, monkeypatch):
    from cairn.operators import ranges as rg

    monkeypatch.setattr(rg, "TASKS", 4)
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias(rg.KEY), "id")
    table = rg.write_ranges(rows, str(tmp_path / "t"), 10)
    tasks = {int(r["path"].rpartition("r_=")[2]) >> 32 for r in table.ranges}
    assert len(tasks) <= 4 and 100 <= len(table.ranges) <= 104 and max(r["n"] for r in table.ranges) <= 10
    assert [r["at"] for r in table.numbered(spark, "at").orderBy("id").collect()] == list(range(1000))
    # An update of all ranges: neighbours share tasks by their sizes, not by a hash.
    new = spark.range(500).select(F.lpad(F.col("id").cast("string"), 6, "0").alias(rg.KEY), (F.col("id") + 5000).alias("id"))
    again, stale = rg.update_ranges(table, new.select(rg.KEY), new, str(tmp_path / "t"), 10)
    assert again.rows == 1000 and max(r["n"] for r in again.ranges) <= 10 and len(stale) >= 50
    assert [r["at"] for r in again.numbered(spark, "at").orderBy(F.expr("if(id >= 5000, id - 5000, id)")).collect()] == list(range(1000))


def test_small_ranges_share_folders_and_are_told_apart(spark, tmp_path, monkeypatch):
    from cairn.operators import ranges as rg

    monkeypatch.setattr(rg, "TASKS", 4)
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias(rg.KEY), "id")
    table = rg.write_ranges(rows, str(tmp_path / "t"), 10)
    assert len({r["path"] for r in table.ranges}) <= 4 < 100 <= len(table.ranges)  # else each range is a listing of its own
    few = [table.ranges[k] for k in (3, 4, 50)]
    got = [r["id"] for r in table.read(spark, few).orderBy("id").collect()]
    assert got == [i for i in range(1000) if any(r["lo"] <= f"{i:06d}" <= r["hi"] for r in few)] and len(got) == sum(r["n"] for r in few)
    # Ranges that an update replaced stay in the folders that others are in, and aren't read.
    new = spark.range(100, 103).select(F.lpad(F.col("id").cast("string"), 6, "0").alias(rg.KEY), (F.col("id") + 5000).alias("id"))
    again, stale = rg.update_ranges(table, new.select(rg.KEY), new, str(tmp_path / "t"), 10)
    want = sorted([i for i in range(1000) if not 100 <= i < 103] + [5100, 5101, 5102])
    assert len(stale) <= 2 and [r["id"] for r in again.read(spark).orderBy("id").collect()] == want
    monkeypatch.setattr(rg, "MAX_IDS", 5)
    monkeypatch.setattr(rg, "MAX_SPANS", 1)
    assert [r["id"] for r in again.read(spark).orderBy("id").collect()] == want
    assert [r["id"] for r in table.read(spark).orderBy("id").collect()] == list(range(1000))


def test_ids_of_many_states_are_merged_as_others(spark, monkeypatch):
    from cairn.operators import catalog as cat

    rows = spark.range(400).select(F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 7).cast("string"))).alias("media_id"), F.when(F.col("id") % 3 == 1, F.col("id")).alias("timestamp_ms"), F.col("id").alias("ingest_seq"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("metadata"))
    states = cat.as_states(cat.as_items(rows).withColumn("ingest_seq", F.monotonically_increasing_id()).join(rows.select("media_id").distinct(), "media_id"))
    states = states.localCheckpoint()
    plain = content(cat.merge_states(states).select("media_id", "n_occurrences", "timestamp_ms", "metadata"))
    # States are dealt as they are: no aggregate combines them before the exchange.
    plan = cat.merge_states(states)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "REPARTITION_BY_COL" in plan
    monkeypatch.setattr(cat, "HOT_STATES", 100)
    assert cat._hot_ids(states) == ["hot"]
    assert content(cat.merge_states(states).select("media_id", "n_occurrences", "timestamp_ms", "metadata")) == plain and len(plain) == 8


def test_ranges_that_lose_none_or_all_of_their_rows_are_not_joined(spark, tmp_path, monkeypatch):
    from cairn.operators import ranges

    keyed = lambda ids, by: spark.createDataFrame([(f"{i:04d}", i * by) for i in ids], "key_ string, v long")
    found = lambda table: {r["key_"]: r["v"] for r in table.read(spark).collect()}
    joined, once = [], ranges.bounded
    monkeypatch.setattr(ranges, "bounded", lambda keys, *a: joined.append(1) or once(keys, *a))
    old = ranges.write_ranges(keyed(range(0, 400, 2), 1), str(tmp_path / "t"), 20)
    assert len(old.ranges) > 5
    all_of = [int(k) for r in old.ranges[1:3] for k in range(int(r["lo"]), int(r["hi"]) + 1, 2)]
    gone = {r["id"]: r["n"] for r in old.ranges[1:3]}
    new, stale = ranges.update_ranges(old, keyed(all_of, 1), keyed([*all_of, 399, 401], 3), str(tmp_path / "t"), 20, gone=gone)
    want = {f"{i:04d}": i for i in range(0, 400, 2)} | {f"{i:04d}": 3 * i for i in [*all_of, 399, 401]}
    assert not joined and len(stale) == 3 and found(new) == want and new.rows == len(want)
    # Some rows of a range, and a key that isn't there: it is looked up which rows go.
    new, stale = ranges.update_ranges(new, keyed([0, 2, 3], 1), keyed([2], 5), str(tmp_path / "t"), 20)
    want.pop("0000")
    assert len(joined) == 2 and len(stale) == 1 and found(new) == want | {"0002": 10} and new.rows == len(want)

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geo, values
from cairn.operators import bubbles, lines, search, tables
from cairn.operators.components import connected_components
from cairn.operators.predicates import from_source, matching
from cairn.plans.spec import Bounds, SearchSpec

CITY = [("zurich-a", 47.3769, 8.5417, 100), ("zurich-b", 47.3769, 8.5417, 200), ("basel", 47.5596, 7.5886, 300), ("munich", 48.1351, 11.582, 400), ("east", 0.0, 179.9, 500), ("west", 0.0, -179.9, 600), ("pole", 89.9, 15.0, 700), ("no-time", 45.4408, 12.3155, None), ("no-place", None, None, 800)]


@pytest.fixture(scope="module")
def city(spark):
    rows = [(i, m, "image" if i % 2 else "geo_point", la, lo, t, None) for i, (m, la, lo, t) in enumerate(CITY)]
    return spark.createDataFrame(rows, "asset_id long, media_id string, kind string, latitude double, longitude double, timestamp_ms long, end_timestamp_ms long")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ids(df):
    return [r.media_id for r in df.collect()]


def test_haversine(spark):
    d = lambda *a: one(spark, geo.haversine_m(*map(F.lit, a)))
    assert d(1.0, 2.0, 1.0, 2.0) == 0
    assert d(0.0, 179.9, 0.0, -179.9) == pytest.approx(22239, abs=20)
    assert d(90.0, 0.0, -90.0, 50.0) == pytest.approx(math.pi * geo.EARTH_RADIUS_M)


def test_nearest_pages(city):
    near = lambda **k: ids(search.knn_page(city, SearchSpec(order="distance", center=(47.3769, 8.5417), **k)))
    assert near(limit=3) == ["zurich-a", "zurich-b", "basel"]
    assert near(limit=2, offset=2) == ["basel", "munich"]
    assert "no-time" in near() and "no-place" not in near()
    assert near(start_ms=200, end_ms=400) == ["zurich-b", "basel", "munich"]
    assert near(bounds=Bounds(-1, 170, 1, 180)) == ["east"]
    assert near(kind="media", limit=1) == ["zurich-b"]
    page = search.search(city, SearchSpec(order="distance", center=(0, 180), limit=2)).collect()
    assert [(r.pos, r.media_id) for r in page] == [(0, "east"), (1, "west")]


def test_time_pages(city):
    assert ids(search.time_page(city, SearchSpec(limit=2))) == ["no-place", "no-time"]  # one second: by id
    asc = ids(search.time_page(city, SearchSpec(order="timestamp_asc")))
    assert len(asc) == 9
    spec = SearchSpec(limit=9)
    assert not search.limit_reached(search.time_page(city, spec, probe=True), spec)
    spec = SearchSpec(limit=8)
    assert search.limit_reached(search.time_page(city, spec, probe=True), spec)
    assert ids(search.list_media(city, SearchSpec(order="timestamp_asc", limit=2))) == ["no-time", "zurich-a"]
    assert ids(search.list_media(city, SearchSpec(limit=1000)))[-1] == "no-time"


def test_time_filter_meets_intervals(spark):
    df = spark.createDataFrame([("a", 10, 50), ("b", 10, None), ("c", None, None)], "media_id string, timestamp_ms long, end_timestamp_ms long")
    df = df.withColumns({"kind": F.lit("image"), "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    assert ids(matching(df, SearchSpec(start_ms=50))) == ["a"]
    assert ids(matching(df, SearchSpec(start_ms=51))) == []
    assert ids(matching(df, SearchSpec(end_ms=10))) == ["a", "b"]
    assert len(ids(matching(df, SearchSpec(has_geo=False)))) == 3


def test_lookup_keeps_order_and_repeats(spark, city):
    want = spark.createDataFrame([("basel", 0), ("gone", 1), ("pole", 2), ("basel", 3)], "media_id string, pos long")
    assert ids(search.lookup(city, want, "media_id")) == ["basel", "pole", "basel"]


def test_upsert_remove_validate(spark, city):
    new = city.filter("media_id = 'basel'").withColumn("latitude", F.lit(1.0))
    assert search.upsert(city, new).filter("latitude = 1.0").count() == 1
    assert search.remove(city, new.select("media_id")).count() == 8
    assert search.validate(city, city) == {"missing": 0, "unexpected": 0}


def test_order_is_validated_but_for_ties(spark):
    page = lambda *rows: spark.createDataFrame([(i, m, d) for i, (m, d) in enumerate(rows)], "pos long, media_id string, distance_m double")
    want = page(("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0), ("e", 3.0))
    why = lambda got: sorted((r.pos, r.why) for r in search.validate_order(want, got).collect())
    assert why(want) == []
    assert why(page(("a", 1.0), ("c", 2.0), ("b", 2.0 + 1e-9), ("d", 3.0), ("f", 3.0))) == []  # ties, one of which goes on after the page
    assert why(page(("b", 2.0), ("a", 1.0), ("c", 2.0), ("d", 3.0), ("e", 3.0))) == [(0, "value"), (1, "value")]
    assert why(page(("a", 1.0), ("b", 2.0), ("x", 2.0), ("d", 3.0), ("e", 3.0))) == [(2, "order")]
    assert why(page(("d", 1.0), ("b", 2.0), ("c", 2.0), ("a", 3.0), ("e", 3.0))) == [(0, "order"), (3, "order")]
    assert why(page(("a", 1.0), ("b", 2.1), ("c", 2.0), ("d", 3.0))) == [(1, "value"), (4, "missing")]


def test_stable_json_and_labels(spark):
    j = lambda t: one(spark, values.stable_json(F.lit(t)))
    assert j('{"b":1, "a":[{"z":"é","y":2.50}]}') == '{"a":[{"y":2.5,"z":"é"}],"b":1}' == j('{"a":[{"y":2.5,"z":"é"}],"b":1}')
    assert j("{bad") is None and j('{"a":1,"a":2}') is None
    assert [one(spark, values.count_label(F.lit(n))) for n in (7, 999, 1000, 1250, 12_600, 2_340_000)] == ["7", "999", "1.0k", "1.3k", "13k", "2.3M"]


def test_source_filter_narrows_locations(spark):
    df = spark.createDataFrame([("m", "s1", "p", [("s1", "p"), ("s2", "q")])], "media_id string, source_id string, relative_path string, locations array<struct<source_id:string,relative_path:string>>")
    row = from_source(df, "s2").first()
    assert (row.source_id, row.relative_path, len(row.locations)) == ("s2", "q", 1)
    assert from_source(df, "s3").count() == 0


def test_bubbles_count_all_points(city):
    points = city.filter("latitude is not null")
    grid = bubbles.bubble_grid(points, 3, 64.0)
    assert grid.agg(F.sum("count")).first()[0] == 8
    row = grid.filter("count = 2").collect()
    assert all(r.asset_id is None for r in row) and grid.filter("count = 1 and asset_id is null").count() == 0
    wide = bubbles.merge_overlapping(bubbles.capped(grid), 3, 6.0)
    assert wide.agg(F.sum("count")).first()[0] == 8 and wide.count() < grid.count()
    assert bubbles.cell_px(None, 1024, 768, 5000) == 64 and bubbles.cell_px(1, 1024, 768, 100) == pytest.approx(math.sqrt(1024 * 768 / 100))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_the_whole_grid_is_merged_and_capped_last(spark):
    from cairn.functions.geo import MAX_MERCATOR_LAT, world_px
    from cairn.plans.catalog_queries import QUERIES, _grid

    grid = _grid(spark, "/root/testdata/sf0.01", 4, 64.0).cache()
    rows = bubbles.merge_overlapping(grid, 4, 1.5).collect()
    assert grid.count() > 500 and sum(r["count"] for r in rows) == grid.agg(F.sum("count")).first()[0]
    lat = np.radians(np.clip([r.latitude for r in rows], -MAX_MERCATOR_LAT, MAX_MERCATOR_LAT))
    x, y = (np.array([r.longitude for r in rows]) + 180) / 360 * world_px(4), (0.5 - np.log((1 + np.sin(lat)) / (1 - np.sin(lat))) / (4 * math.pi)) * world_px(4)
    r = bubbles.bubble_radius(np.array([r["count"] for r in rows]), 1.5)
    apart = np.hypot(x[:, None] - x, y[:, None] - y) - r[:, None] - r
    assert (apart[np.triu_indices(len(rows), 1)] > -1e-6).all()
    fullest = sorted(((r["count"], r["cell_id"]) for r in rows), key=lambda c: (-c[0], c[1]))[:500]
    assert sorted((r["count"], r["cell_id"]) for r in QUERIES["bubbles_merged"](spark, "/root/testdata/sf0.01").collect()) == sorted(fullest)


def merged_plainly(rows, zoom, scale):
    """{cell id: (count, latitude, longitude, bounds)}: all pairs of circles are compared, and touching ones merged, until none touch."""
    size = geo.world_px(zoom)
    while True:
        at = []
        for r in rows:
            q = math.sin(math.radians(max(-geo.MAX_MERCATOR_LAT, min(geo.MAX_MERCATOR_LAT, r["lat"]))))
            step = next(v for top, v in ((2, 8), (10, 10), (100, 12), (1000, 15), (math.inf, 18)) if r["n"] < top)
            at.append(((r["lon"] + 180) / 360 * size, (0.5 - math.log((1 + q) / (1 - q)) / (4 * math.pi)) * size, step * scale + 2))
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if math.hypot(at[i][0] - at[j][0], at[i][1] - at[j][1]) < at[i][2] + at[j][2]:
                    root[find(i)] = find(j)
        parts = {}
        for i, r in enumerate(rows):
            parts.setdefault(find(i), []).append(r)
        if len(parts) == len(rows):
            return {r["id"]: (r["n"], r["lat"], r["lon"], *r["box"]) for r in rows}
        rows = []
        for p in parts.values():
            n = sum(r["n"] for r in p)
            mean = {c: p[0][c] if len(p) == 1 else sum(r[c] * r["n"] for r in p) / n for c in ("lat", "lon")}
            rows.append({"id": min(p, key=lambda r: (-r["n"], r["id"]))["id"], "n": n, **mean, "box": [f(r["box"][k] for r in p) for k, f in enumerate((min, max, min, max))]})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("zoom,scale", [(4, 3.0), (3, 5.0)])
def test_merged_bubbles_equal_brute_force(spark, zoom, scale):
    from cairn.plans.catalog_queries import _grid

    grid = _grid(spark, "/root/testdata/sf0.001", zoom, 64.0).cache()
    rows = [{"id": r.cell_id, "n": r["count"], "lat": r.latitude, "lon": r.longitude, "box": [r.min_lat, r.max_lat, r.min_lon, r.max_lon]} for r in grid.collect()]
    got = {r.cell_id: (r["count"], r.latitude, r.longitude, r.min_lat, r.max_lat, r.min_lon, r.max_lon) for r in bubbles.merge_overlapping(grid, zoom, scale).collect()}
    want = merged_plainly(rows, zoom, scale)
    assert got.keys() == want.keys() and len(want) < len(rows)
    assert all(got[k][0] == want[k][0] and got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


TRIP = "asset_id long, group_id string, ts_sec long, sequence long, latitude double, longitude double"


def trip(spark, *points):
    return spark.createDataFrame([(i, g, t, s, la, lo) for i, (g, s, t, la, lo) in enumerate(points)], TRIP)


def metrics(df, **k):
    return lines.line_metrics(lines.line_points(df), **k).first().asDict()


def test_gaps_split_runs(spark):
    df = trip(spark, *[("g", s, s * 10, 48.0, 11.0 + s / 1000) for s in (0, 1, 3, 4)], ("g", None, 99, 48.0, 11.0), ("h", 5, 1, 48.0, 11.0))
    found = lines.polylines(lines.with_segments(lines.with_runs(lines.line_points(df)))).collect()
    assert sorted(r.n_points for r in found) == [2, 2]
    runs = lines.with_runs(trip(spark, ("g", 1, 1, 0.0, 0.0), ("g", 1, 2, 0.0, 0.0), ("g", 2, 3, 0.0, 0.0)))
    assert sorted(r.run_points for r in runs.collect()) == [1, 2, 2]  # repeated sequences break a run


def test_isolated_jump_is_removed(spark):
    df = trip(spark, ("g", 0, 0, 48.13, 11.58), ("g", 1, 60, 5.0, 30.0), ("g", 2, 120, 48.131, 11.581))
    assert metrics(df, break_speed_kmh=300) == {"matched": 3, "accepted": 3, "jumps": 1, "distance_breaks": 0, "speed_breaks": 0, "segments": 1, "rendered": 2}


def test_distance_break(spark):
    df = trip(spark, ("g", 0, 0, 48.0, 11.0), ("g", 1, 600, 48.001, 11.0), ("g", 2, 90000, 49.0, 11.0))
    assert metrics(df, max_distance_km=25) == {"matched": 3, "accepted": 3, "jumps": 0, "distance_breaks": 1, "speed_breaks": 0, "segments": 1, "rendered": 2}


def test_all_vertices_stay(spark):
    df = trip(spark, *[("g", i, i, 48 + math.sin(i / 10) / 100, 11 + i / 1e4) for i in range(2000)])
    row = lines.polylines(lines.with_segments(lines.with_runs(df))).first()
    assert row.n_points == 2000 == len(row.points)
    tiles = lines.tile_segments(lines.polylines(lines.with_segments(lines.with_runs(df))), 10).collect()
    assert tiles and all(t.z == 10 and len(t.pixels) == 2000 for t in tiles)


def test_scalar_functions(spark):
    f = lambda c: one(spark, c)
    assert f(values.geo_point_hash(F.lit(47.1), F.lit(8.25), F.lit(1000).cast("long"))) == "geo_point:v1:47.100000000:8.250000000:1000"
    assert f(values.iso_to_ms(F.lit("2024-01-01T01:00:00.250+01:00"))) == 1704067200250
    assert f(values.iso_to_ms(F.lit("2024-01-01"))) == 1704067200000 and f(values.iso_to_ms(F.lit("nope"))) is None
    assert tuple(f(values.coordinate_pair(F.lit("48.13°, 11.57°, 5")))) == (48.13, 11.57)
    assert f(values.coordinate_pair(F.lit("91, 1"))) is None and f(values.coordinate_pair(F.lit("x"))) is None
    assert f(geo.to_e7(F.lit(95.0), 90)) == 900000000 and f(geo.to_e7(F.lit(None).cast("double"), 90)) is None
    assert f(geo.normalize_lon(F.lit(-180.0))) == 180 and f(geo.normalize_lon(F.lit(540.0))) == 180
    assert f(geo.px_to_lat(geo.lat_to_px(F.lit(47.5), 9), 9)) == pytest.approx(47.5)
    assert [f(values.media_kind(F.lit(m), F.lit(p))) for m, p in (("", "a/B.JPG"), ("video/x", "a.jpg"), ("", "a.mov"), ("", "a"))] == ["image", "video", "video", None]
    assert f(values.merged_metadata(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}
    assert [f(values.distance_label(F.lit(x))) for x in (12.4, 1234.0, 123456.0)] == ["12 m", "1.23 km", "123 km"]
    assert values.day_bound_ms("2024-01-01", zone="UTC") == 1704067200000 and values.day_bound_ms("2024-01-01", end=True) == 1704153599999
    assert values.day_bound_ms("x") is None and values.day_bound_ms("2024-01-01T00:00:00Z") == 1704067200000


@pytest.mark.parametrize("few", [1_000_000, 3])
def test_components_of_a_hub(spark, monkeypatch, few):
    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", few)  # few: joins take the hot keys apart
    monkeypatch.setattr(tables, "HOT_PARTS", 5)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 330)] + [(7, 7), (199, 250), (400, 250)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(1, 200), 250, 400]}, **{i: 300 for i in range(301, 331)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [1_000_000, 3])
def test_groups_join_whichever_way(spark, monkeypatch, few):
    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", few)
    monkeypatch.setattr(tables, "HOT_PARTS", 5)
    rows = spark.range(300).select("id", F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 90).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 5")
    got = tables.join_groups(rows, groups, ["k"]).collect()
    k = lambda i: 0 if i < 100 else i % 90
    size = {j: sum(k(i) == j for i in range(300)) for j in range(90)}
    assert sorted((r.id, r.n) for r in got) == [(i, size[k(i)]) for i in range(300) if k(i) != 5]
    got = tables.join_groups(rows, groups, ["k"], how="left").collect()
    assert sorted((r.id, r.n or 0) for r in got) == [(i, size[k(i)] if k(i) != 5 else 0) for i in range(300)]

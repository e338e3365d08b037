"""Long trips in blocks, parts of lines, and tiles of clipped edges, against plain versions."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions.geo import world_px
from cairn.operators import lines
from cairn.plans.views import trip_points

DATA = "/root/testdata/sf0.001"
TRIP = "asset_id long, group_id string, ts_sec long, sequence long, latitude double, longitude double"


def content(df):
    return sorted(map(repr, df.select(*sorted(c for c in df.columns if c not in (lines.BLOCK, "from"))).collect()))


@pytest.fixture(scope="module")
def trips(spark):
    """A trip of most points with gaps, repeated and missing sequences, and many short ones."""
    rng, rows, seq = random.Random(1), [], 0
    for i in range(900):
        seq += rng.choice([1] * 30 + [0, 2, 9])
        rows.append((i, "long", i * 60 + rng.randint(0, 40), None if i > 880 else seq, 48 + rng.random() / 50 + (rng.random() < 0.05) * 2, 11 + i / 900))
    for i in range(900, 1100):
        rows.append((i, f"t{i % 40}", i, i // 40, 10 + rng.random(), 10.0))
    rows += [(2000, None, 1, 1, 1.0, 1.0)]
    return spark.createDataFrame(rows, TRIP).repartition(5).cache()


@pytest.mark.parametrize("block", [7, 200])
def test_blocks_change_nothing(trips, block):
    def all_of(**k):
        runs = lines.with_runs(trips, **k)
        cut = lines.with_segments(runs, 60.0, 30.0)
        return [content(t) for t in (runs, lines.with_jumps(runs, 30.0), cut, lines.polylines(cut), lines.polyline_parts(cut, 5), lines.tile_edges(cut, 9), lines.line_metrics(trips, 60.0, 30.0, **k))]

    want, got = all_of(), all_of(block_points=block)
    assert got == want and all(want)
    runs = lines.with_runs(trips, block)
    sizes = [r["count"] for r in runs.filter(F.col(lines.BLOCK) > 0).groupBy(lines.BLOCK).count().collect()]
    assert len(sizes) >= 900 / block - 1 and max(sizes) < 900 and sum(sizes) == 900
    jumps = lines.line_metrics(trips, 60.0, 30.0, block).first()
    assert jumps["jumps"] > 5 and jumps["speed_breaks"] + jumps["distance_breaks"] > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_blocks_of_the_events(spark):
    points = trip_points(spark, DATA)
    cut = lambda **k: content(lines.with_segments(lines.with_runs(points, **k), 60.0, 20.0))
    assert cut(block_points=20) == cut()


def clip(x1, y1, x2, y2, box):
    """The part of a line within a box, by halving: plain and slow."""
    t = [0.0, 1.0]
    for a, d, low, high in ((x1, x2 - x1, box[0], box[2]), (y1, y2 - y1, box[1], box[3])):
        if d == 0:
            if not low <= a <= high:
                return None
            continue
        p, q = sorted(((low - a) / d, (high - a) / d))
        t = [max(t[0], p), min(t[1], q)]
    return None if t[0] > t[1] else (x1 + t[0] * (x2 - x1), y1 + t[0] * (y2 - y1), x1 + t[1] * (x2 - x1), y1 + t[1] * (y2 - y1))


def pixel(lat, lon, zoom):
    s = math.sin(math.radians(max(-85.0511287798066, min(85.0511287798066, lat))))
    return (lon + 180) / 360 * world_px(zoom), (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * world_px(zoom)


def test_edges_are_clipped_to_all_their_tiles(spark):
    rng, zoom, gutter = random.Random(2), 4, 20
    at = [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(40)] + [(0.0, 0.0), (0.0, 50.0), (60.0, 50.0), (60.0, 50.0)]
    df = spark.createDataFrame([(i, "g", i, i, la, lo) for i, (la, lo) in enumerate(at)], TRIP)
    cut = lines.with_segments(lines.with_runs(df))
    want = {}
    for i in range(1, len(at)):
        (x1, y1), (x2, y2) = pixel(*at[i - 1], zoom), pixel(*at[i], zoom)
        for x in range(16):
            for y in range(16):
                part = clip(x1, y1, x2, y2, (x * 256 - gutter, y * 256 - gutter, x * 256 + 256 + gutter, y * 256 + 256 + gutter))
                if part:
                    want[i, x, y] = [v - 256 * o for v, o in zip(part, (x, y, x, y))]
    got = {(r.asset_id, r.x, r.y): [r.px1, r.py1, r.px2, r.py2] for r in lines.tile_edges(cut, zoom, gutter).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert all(-gutter - 1e-6 <= v <= 256 + gutter + 1e-6 for v in sum(got.values(), []))
    for tile in ((7, 5), (0, 0), (15, 15), (8, 8)):
        own = {r.asset_id: [r.px1, r.py1, r.px2, r.py2] for r in lines.one_tile(cut, zoom, *tile, gutter).collect()}
        assert own.keys() == {i for i, x, y in want if (x, y) == tile} and all(own[i] == pytest.approx(want[i, *tile], abs=1e-6) for i in own)


def test_a_world_wide_line_makes_as_many_rows_as_tiles_it_crosses(spark):
    df = spark.createDataFrame([(0, "g", 0, 0, -80.0, -179.0), (1, "g", 1, 1, 80.0, 179.0)], TRIP)
    n = lines.tile_edges(lines.with_segments(lines.with_runs(df)), 14, 0).count()
    (x1, y1), (x2, y2) = pixel(-80.0, -179.0, 14), pixel(80.0, 179.0, 14)
    crossed = abs(x2 // 256 - x1 // 256) + abs(y2 // 256 - y1 // 256) + 1
    assert abs(n - crossed) <= 2  # corners


def test_many_blocks_are_cut_by_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "CUTS", 4)
    e = F.col("id")
    points = spark.range(1000).select(F.lit("g").alias("group_id"), e.alias("asset_id"), e.alias("sequence"), e.alias("ts_sec"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"))
    cut = lines.in_blocks(points, 5)
    blocks = cut.groupBy(lines.BLOCK).agg(F.count("*").alias("n"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi")).orderBy(lines.BLOCK).collect()
    assert sum(b.n for b in blocks) == 1000 and max(b.n for b in blocks) <= 5
    assert all(a.hi < b.lo for a, b in zip(blocks, blocks[1:]))
    assert len({b[lines.BLOCK] >> 33 for b in blocks}) <= 5

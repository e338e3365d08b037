"""Every registered catalog query against its SQL on the smallest tables."""

import collections
import os

import duckdb
import pytest

from cairn.plans.import_queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    result = oracle.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in result.fetchall()]
    assert collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))
    assert got or "probe" in name or "group_search" in name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_merged_bubbles_keep_all_points_and_do_not_touch(spark):
    import math

    from cairn.functions.geo import MAX_MERCATOR_LAT, world_px
    from cairn.operators.bubbles import bubble_radius

    import numpy as np

    from cairn.operators.bubbles import merge_overlapping
    from cairn.plans.catalog_queries import _grid

    grid = _grid(spark, DATA, 4, 64.0)
    rows = merge_overlapping(grid, 4, 1.5).collect()
    assert sum(r["count"] for r in rows) == sum(r["count"] for r in grid.collect())
    first = sorted(rows, key=lambda r: (-r["count"], r.cell_id))[:500]  # the query's cap comes last
    assert [r.cell_id for r in QUERIES["bubbles_merged"](spark, DATA).collect()] == [r.cell_id for r in first]
    size = world_px(4)
    at = []
    for r in rows:
        s = math.sin(math.radians(max(-MAX_MERCATOR_LAT, min(MAX_MERCATOR_LAT, r.latitude))))
        at.append(((r.longitude + 180) / 360 * size, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * size, bubble_radius(np.array([r["count"]]), 1.5)[0]))
    for i, (x, y, d) in enumerate(at):
        for u, v, e in at[:i]:
            assert math.hypot(x - u, y - v) >= d + e - 1e-6


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 50

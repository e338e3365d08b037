"""Pages in time or distance order, lookups and counts.

A page is ordered on narrow columns first (Spark keeps the top rows of each partition, then of those), and joined back to
wide rows by id: the ids of a page are at most MAX_PAGE + 1 rows, so they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.geo import haversine_m
from cairn.functions.values import ms_to_sec
from cairn.operators.predicates import at_time, geo_is, matching, searchable
from cairn.operators.tables import bounded
from cairn.plans.spec import SearchSpec


def _page(keys: DataFrame, order: list[Column], spec: SearchSpec, probe: bool) -> DataFrame:
    return keys.orderBy(*order).offset(spec.offset).limit(spec.limit + probe)


def time_page(assets: DataFrame, spec: SearchSpec, probe: bool = False) -> DataFrame:
    """Items by (second, asset id); probe: one more row than the limit, which tells that more follow."""
    spec = spec.page()
    asc = spec.order == "timestamp_asc"
    keys = matching(searchable(assets), spec).withColumn("ts_sec", F.coalesce(ms_to_sec("timestamp_ms"), F.lit(0)))
    order = [F.col(c).asc() if asc else F.col(c).desc() for c in ("ts_sec", "asset_id")]
    return _page(keys, order, spec, probe)


def knn_page(assets: DataFrame, spec: SearchSpec, probe: bool = False) -> DataFrame:
    """Exact nearest items to spec.center, with distance_m; distances that agree to a micrometre go by media id."""
    spec = spec.page()
    lat, lon = spec.center
    near = matching(assets, spec, points=True).withColumn("distance_m", haversine_m(lat, lon, "latitude", "longitude"))
    return _page(near, [F.round("distance_m", 6).asc(), F.col("media_id").asc()], spec, probe)


def search(assets: DataFrame, spec: SearchSpec) -> DataFrame:
    """A page of whole assets, in order, with pos (0-based place in the page)."""
    narrow = [c for c in assets.columns if c not in ("metadata", "locations")]
    page = knn_page(assets.select(*narrow), spec) if spec.order == "distance" else time_page(assets.select(*narrow), spec)
    extra = [c for c in page.columns if c not in assets.columns]
    ids = page.select("asset_id", F.monotonically_increasing_id().alias("pos"), *extra)  # one partition, in order
    return assets.join(F.broadcast(ids), "asset_id").orderBy("pos")


def limit_reached(page_with_probe: DataFrame, spec: SearchSpec) -> bool:
    return page_with_probe.count() > spec.page().limit


def list_media(assets: DataFrame, spec: SearchSpec) -> DataFrame:
    """By (millisecond, media id): nulls first ascending, last descending; ids ascending in both."""
    spec = spec.page()
    first = F.col("timestamp_ms").asc_nulls_first() if spec.order == "timestamp_asc" else F.col("timestamp_ms").desc_nulls_last()
    return matching(assets, spec).orderBy(first, "media_id").offset(spec.offset).limit(spec.limit)


def lookup(assets: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Assets for the rows (key, pos) of ids, by pos; missing ids are dropped, repeated ones repeated. Few ids are sent to the assets."""
    return assets.join(bounded(ids.select(key, "pos")), key).orderBy("pos")


def geo_points(assets: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """All located items in a range of times, in no order: a total sort is left to those who need it."""
    found = assets.filter(geo_is(True) & at_time(start_ms, end_ms))
    return found.select("media_id", "kind", "latitude", "longitude", "timestamp_ms")


def kind_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("kind").agg(F.count("*").alias("n"), F.count("latitude").alias("n_geo"), F.count("timestamp_ms").alias("n_time"))


def upsert(points: DataFrame, incoming: DataFrame, key: str = "media_id") -> DataFrame:
    return points.join(incoming, key, "left_anti").unionByName(incoming)


def remove(points: DataFrame, gone: DataFrame, key: str = "media_id") -> DataFrame:
    return points.join(gone, key, "left_anti")


def validate(expected: DataFrame, got: DataFrame) -> dict[str, int]:
    """Rows that only one of two results has."""
    return {"missing": expected.exceptAll(got).count(), "unexpected": got.exceptAll(expected).count()}


def validate_order(expected: DataFrame, got: DataFrame, value: str = "distance_m", tolerance: float = 1e-6, key: str = "media_id") -> DataFrame:
    """(pos, expected, got, why) for each place at which two pages, both with pos, key and value, don't agree.

    Values at a place agree within the tolerance; then other ids may stand there (ties in another order), if each page has
    them, or if it is the page's last value, which may go on after the page. why: value, order, missing or unexpected.
    """
    a = expected.select("pos", F.col(key).alias("expected"), F.col(value).alias("v1"))
    b = got.select("pos", F.col(key).alias("got"), F.col(value).alias("v2"))
    both = a.join(b, "pos", "full_outer")
    known = both.join(a.select(F.col("expected").alias("e"), F.col("v1").alias("own1")), F.col("got") == F.col("e"), "left").join(b.select(F.col("got").alias("g"), F.col("v2").alias("own2")), F.col("expected") == F.col("g"), "left")
    last = F.broadcast(a.agg(F.max("v1").alias("last")))  # one row
    near = lambda x, y: F.coalesce(F.abs(F.col(x) - F.col(y)) <= tolerance, F.lit(False))
    tie = (near("own1", "v1") | F.col("own1").isNull() & near("v2", "last")) & (near("own2", "v2") | F.col("own2").isNull() & near("v1", "last"))
    why = (
        F.when(F.col("got").isNull(), "missing").when(F.col("expected").isNull(), "unexpected")
        .when(~near("v1", "v2"), "value").when((F.col("expected") != F.col("got")) & ~tie, "order")
    )
    return known.join(last).withColumn("why", why).filter("why is not null").select("pos", "expected", "got", "why")

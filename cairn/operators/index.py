"""The search index: narrow rows in two layouts, by time and by place, and pages that read only the ranges they need.

By time, keys are (second, media id), or (second, another unique column); a page reads ranges from one end until it is full. By place, keys are a Z-order curve
of coordinates, so a range covers a small box; nearest neighbours take ranges by the lowest distance of
their boxes and squares, about twice as many rows each time, until no other range can hold a nearer item. Pages are exact and equal those of search.time_page and search.knn_page, if asset ids
follow media ids, or name the index's ties.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.geo import EARTH_RADIUS_M, haversine_m, to_e7
from cairn.functions.values import ms_to_sec
from cairn.operators.predicates import matching, searchable
from cairn.operators.ranges import KEY, ROWS, Ranges, update_ranges, write_ranges
from cairn.operators.tables import stored
from cairn.plans.spec import SearchSpec

#: Bits of either coordinate in a place key.
PLACE_BITS = 16
#: Distances computed in Python and by Spark may differ by rounding.
SLACK_M = 1e-3

_OPTIONAL = {"accuracy_m": "double", "velocity_mps": "double", "heading_deg": "double", "group_id": "string", "sequence": "long"}
#: Statistics of ranges, as SQL.
TIME_STATS = {"last_ms": "max(coalesce(end_timestamp_ms, timestamp_ms))", "first_ms": "min(timestamp_ms)"}
PLACE_STATS = {"min_lat": "min(latitude)", "max_lat": "max(latitude)", "min_lon": "min(longitude)", "max_lon": "max(longitude)"}


def index_rows(assets: DataFrame, ties: str = "media_id") -> DataFrame:
    """The narrow rows of assets with a time or coordinates, with the column ties; other columns that assets lacks are null."""
    geo = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    own = F.array("source_id") if "source_id" in assets.columns else F.array().cast("array<string>")
    sources = F.array_distinct(F.transform("locations", lambda x: x["source_id"])) if "locations" in assets.columns else own
    return searchable(assets).select(
        "media_id", "kind", F.coalesce(ms_to_sec("timestamp_ms"), F.lit(0)).cast("long").alias("ts_sec"), "timestamp_ms", "end_timestamp_ms", "latitude", "longitude",
        F.when(geo, to_e7("latitude", 90)).alias("lat_e7"), F.when(geo, to_e7("longitude", 180)).alias("lon_e7"), geo.alias("has_geo"), sources.alias("source_ids"),
        *[(F.col(c) if c in assets.columns else F.lit(None)).cast(t).alias(c) for c, t in _OPTIONAL.items()],
        *([] if ties == "media_id" else [ties]),
    )


def by_time(rows: DataFrame, ties: str = "media_id") -> DataFrame:
    """ties: the column, a string or a whole number, that orders rows of a second."""
    tie = F.col(ties)
    if not isinstance(rows.schema[ties].dataType, T.StringType):  # as text in the order of numbers, negative ones first
        tie = F.lpad(F.hex(tie.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return rows.withColumn(KEY, F.concat(F.lpad(F.col("ts_sec").cast("string"), 10, "0"), tie))


def _spread(x: Column) -> Column:
    """The PLACE_BITS bits of x at every second place."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def by_place(rows: DataFrame) -> DataFrame:
    """The rows with coordinates."""
    cell = lambda c, span: F.greatest(F.lit(0), F.least(F.lit((1 << PLACE_BITS) - 1), F.floor((F.col(c) + span / 2) / span * (1 << PLACE_BITS)))).cast("long")
    z = _spread(cell("longitude", 360.0)).bitwiseOR(F.shiftleft(_spread(cell("latitude", 180.0)), 1))
    return rows.filter("has_geo").withColumn(KEY, F.concat(F.lpad(F.lower(F.hex(z)), PLACE_BITS // 2, "0"), "media_id"))


def lowest_distance_m(lat: float, lon: float, box: dict) -> float:
    """The great-circle distance from a point to the nearest one of a box, in metres; 0 within it."""
    p, lo, hi = math.radians(lat), math.radians(box["min_lat"]), math.radians(box["max_lat"])
    if box["min_lon"] <= lon <= box["max_lon"]:
        return EARTH_RADIUS_M * max(0.0, lo - p, p - hi)
    best = math.pi
    for edge in (box["min_lon"], box["max_lon"]):  # along a meridian the distance's cosine is a wave with one crest
        turn = math.cos(math.radians(edge - lon))
        crest = math.atan2(math.sin(p), math.cos(p) * turn)
        for q in (lo, hi, *([crest] if lo <= crest <= hi else [])):
            best = min(best, math.acos(max(-1.0, min(1.0, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * turn))))
    return EARTH_RADIUS_M * best


def _cells(lo: int, hi: int) -> Iterator[dict]:
    """The squares of the curve from lo to hi, as boxes: few, and each as large as it can be."""
    while lo <= hi:
        level = 0
        while level < PLACE_BITS and lo % (4 << 2 * level) == 0 and lo + (4 << 2 * level) - 1 <= hi:
            level += 1
        x, y = (sum((lo >> 2 * k + side & 1) << k for k in range(PLACE_BITS)) for side in (0, 1))
        a, b = 360.0 / (1 << PLACE_BITS), 180.0 / (1 << PLACE_BITS)
        yield {"min_lon": x * a - 180, "max_lon": (x + (1 << level)) * a - 180, "min_lat": y * b - 90, "max_lat": (y + (1 << level)) * b - 90}
        lo += 1 << 2 * level


def _from_place(lat: float, lon: float, ranges: list[dict]) -> Iterator[tuple[float, dict]]:
    """(a distance that no item of the range is below, the range), nearest first. Boxes come first; squares are looked at when their turn comes."""

    def safe(d: float) -> float:
        return d * (1 - 1e-9) - SLACK_M

    heap = [(safe(lowest_distance_m(lat, lon, r)), i, False) for i, r in enumerate(ranges)]
    heapq.heapify(heap)
    while heap:
        d, i, exact = heapq.heappop(heap)
        r = ranges[i]
        if exact:
            yield d, r
            continue
        parts = []
        for c in _cells(*(int(r[k][: PLACE_BITS // 2], 16) for k in ("lo", "hi"))):
            own = {"min_lat": max(c["min_lat"], r["min_lat"]), "max_lat": min(c["max_lat"], r["max_lat"]), "min_lon": max(c["min_lon"], r["min_lon"]), "max_lon": min(c["max_lon"], r["max_lon"])}
            if own["min_lat"] <= own["max_lat"] and own["min_lon"] <= own["max_lon"]:
                parts.append(lowest_distance_m(lat, lon, own))
        heapq.heappush(heap, (max(d, safe(min(parts))) if parts else d, i, True))


@dataclass
class Index:
    """Both layouts. read holds the ranges that the last page needed, and rows their rows; ties orders items of a second."""

    spark: SparkSession
    time: Ranges
    place: Ranges
    read: list[dict] = field(default_factory=list)
    ties: str = "media_id"

    @property
    def rows(self) -> int:
        return sum(r["n"] for r in self.read)

    def _found(self, layout: Ranges, ranges: list[dict], spec: SearchSpec, points: bool) -> DataFrame:
        self.read = ranges
        rows = layout.read(self.spark, ranges)
        rows = rows if spec.source_id is None else rows.filter(F.array_contains("source_ids", spec.source_id))
        return matching(rows, SearchSpec(**{**spec.__dict__, "source_id": None}), points=points)

    def time_page(self, spec: SearchSpec, probe: bool = False) -> DataFrame:
        """As search.time_page, of index rows."""
        spec = spec.page()
        asc, need = spec.order == "timestamp_asc", spec.offset + spec.limit + probe
        ranges = [r for r in self.time.ranges if (spec.start_ms is None or (r["last_ms"] or -1) >= spec.start_ms) and (spec.end_ms is None or r["first_ms"] is not None and r["first_ms"] <= spec.end_ms)]
        ranges = ranges if asc else ranges[::-1]
        take, before = 0, 0
        while take < len(ranges):
            step = before
            while take < len(ranges) and (before < need or before < 2 * step):
                before += ranges[take]["n"]
                take += 1
            if take == len(ranges) or self._found(self.time, ranges[:take], spec, False).limit(need).count() >= need:
                break
        rows = self._found(self.time, ranges[:take], spec, False)
        return rows.orderBy(F.col(KEY).asc() if asc else F.col(KEY).desc()).offset(spec.offset).limit(spec.limit + probe)

    def knn_page(self, spec: SearchSpec, probe: bool = False) -> DataFrame:
        """As search.knn_page, of index rows."""
        spec = spec.page()
        (lat, lon), need, b = spec.center, spec.offset + spec.limit + probe, spec.bounds
        ranges = [r for r in self.place.ranges if b is None or r["max_lat"] >= b.min_lat and r["min_lat"] <= b.max_lat and r["max_lon"] >= b.min_lon and r["min_lon"] <= b.max_lon]
        order = _from_place(lat, lon, ranges)
        near: list[dict] = []
        ahead = next(order, None)  # the next range, and its lowest distance

        def nearest() -> DataFrame:
            rows = self._found(self.place, list(near), spec, True).withColumn("distance_m", haversine_m(lat, lon, "latitude", "longitude"))
            return rows.orderBy(F.round("distance_m", 6).asc(), F.col("media_id").asc())

        bound, goal = math.inf, need
        while ahead and ahead[0] <= bound:
            while ahead and ahead[0] <= bound and sum(r["n"] for r in near) < goal:
                near.append(ahead[1])
                ahead = next(order, None)
            last = nearest().offset(need - 1).limit(1).collect()
            bound = last[0]["distance_m"] if last else math.inf
            goal = 2 * sum(r["n"] for r in near)
        return nearest().offset(spec.offset).limit(spec.limit + probe)


def build_index(assets: DataFrame, path: str, per_range: int = ROWS, kept: bool = False, ties: str = "media_id") -> Index:
    """Both layouts of assets (media ids, or the column ties, are unique and not null), written under path. kept: assets are stored already."""
    rows = index_rows(assets, ties) if kept else stored(index_rows(assets, ties))
    time, place = write_ranges(by_time(rows, ties), f"{path}/time", per_range, TIME_STATS, True), write_ranges(by_place(rows), f"{path}/place", per_range, PLACE_STATS, True)
    return Index(assets.sparkSession, time, place, ties=ties)


def update_index(index: Index, gone: DataFrame, new: DataFrame, path: str, per_range: int = ROWS) -> tuple[Index, dict[str, int]]:
    """(the index without the assets of gone and with those of new, numbers of rewritten ranges). By place, media ids must be unique."""
    ties = index.ties
    old, rows = index_rows(gone, ties), index_rows(new, ties)

    def updated(layout: Ranges, keyed: Callable[[DataFrame], DataFrame], name: str, stats: dict[str, str]) -> tuple[Ranges, list[dict]]:
        removed = keyed(old).select(KEY)
        lost = {layout.ranges[i]["id"]: n for i, n in layout.belonging(removed).items()}  # the index has all of gone
        return update_ranges(layout, removed, keyed(rows), f"{path}/{name}", per_range, stats, lost)

    time, t = updated(index.time, lambda df: by_time(df, ties), "time", TIME_STATS)
    place, p = updated(index.place, by_place, "place", PLACE_STATS)
    return Index(index.spark, time, place, ties=ties), {"time": len(t), "place": len(p)}

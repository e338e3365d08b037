"""Searches as URL query strings: from, to, sort, kind, page, pageSize, lat, lon and a box; unfit values are left out."""

from __future__ import annotations

import math
import re
from urllib.parse import parse_qs, urlencode

from cairn.functions.values import KINDS, day_bound_ms
from cairn.plans.spec import ORDERS, Bounds, SearchSpec

PAGE_SIZES, PAGE_SIZE = (50, 100, 250, 500), 100
BOX = ("minLat", "minLon", "maxLat", "maxLon")


def _held(x: float, most: float) -> float:
    return max(-most, min(most, x))


def _short(x: float) -> str:
    return f"{x:.6f}".rstrip("0").rstrip(".")


def spec_from_query(query: str, center: tuple[float, float] = (0.0, 0.0), zone: str = "UTC") -> SearchSpec:
    """center: where distances are measured from if the query doesn't say."""
    given = {k: v[0] for k, v in parse_qs(query.lstrip("?")).items()}

    def number(key: str) -> float | None:
        try:
            x = float(given[key])
        except (KeyError, ValueError):
            return None
        return x if math.isfinite(x) else None

    def day(key: str, end: bool) -> int | None:
        value = given.get(key, "")
        return day_bound_ms(value, end, zone) if re.fullmatch(r"\d{4}-\d\d-\d\d(T\d\d:\d\d)?", value) else None

    page, size = (number(k) for k in ("page", "pageSize"))
    size = int(size) if size is not None and int(size) in PAGE_SIZES else PAGE_SIZE
    page = int(page) if page is not None and page >= 1 else 1
    box, at = [number(k) for k in BOX], (number("lat"), number("lon"))
    bounds = None
    if None not in box:
        lats, lons = sorted(_held(x, 90) for x in box[::2]), sorted(_held(x, 180) for x in box[1::2])
        bounds = Bounds(lats[0], lons[0], lats[1], lons[1])
    kind = given.get("kind")
    return SearchSpec(
        kind=kind if kind in (*KINDS, "media") else "all", bounds=bounds, start_ms=day("from", False), end_ms=day("to", True),
        order=given["sort"] if given.get("sort") in ORDERS else ORDERS[0], center=center if None in at else (_held(at[0], 90), _held(at[1], 180)), limit=size, offset=(page - 1) * size,
    )


def query_from_spec(spec: SearchSpec, days: tuple[str, str] = ("", ""), center: tuple[float, float] = (0.0, 0.0)) -> str:
    """The shortest query that spec_from_query reads as spec; days: the date inputs, which a spec doesn't keep."""
    out = {k: v for k, v in zip(("from", "to"), days) if v}
    out |= {"sort": spec.order} if spec.order != ORDERS[0] else {}
    out |= {"kind": spec.kind} if spec.kind not in (None, "all") else {}
    out |= {"page": str(spec.offset // spec.limit + 1)} if spec.offset >= spec.limit else {}
    out |= {"pageSize": str(spec.limit)} if spec.limit != PAGE_SIZE else {}
    if spec.order == "distance" and spec.center and any(abs(a - b) >= 1e-6 for a, b in zip(spec.center, center)):
        out |= dict(zip(("lat", "lon"), map(_short, spec.center)))
    if b := spec.bounds:
        out |= dict(zip(BOX, map(_short, (b.min_lat, b.min_lon, b.max_lat, b.max_lon))))
    return urlencode(out)

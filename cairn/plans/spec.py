"""The query: filters, order and page of a search."""

from __future__ import annotations

from dataclasses import dataclass, replace

MAX_PAGE, DEFAULT_PAGE, MAX_BUBBLES, DEFAULT_BUBBLES, DEFAULT_GROUPS = 10_000, 500, 5_000, 500, 50
ORDERS = ("timestamp_desc", "timestamp_asc", "distance")


@dataclass(frozen=True)
class Bounds:
    """A closed box of coordinates; it doesn't wrap at the antimeridian."""

    min_lat: float
    min_lon: float
    max_lat: float
    max_lon: float


@dataclass(frozen=True)
class SearchSpec:
    kind: str | None = None  # a kind, 'media' (image or video), 'all' or None
    has_geo: bool | None = None
    bounds: Bounds | None = None
    start_ms: int | None = None
    end_ms: int | None = None
    source_id: str | None = None
    order: str = "timestamp_desc"
    center: tuple[float, float] | None = None  # latitude and longitude, for distance
    limit: int = DEFAULT_PAGE
    offset: int = 0

    def page(self, limit: int | None = None) -> SearchSpec:
        """With its limit held to 1 to MAX_PAGE and its offset to 0 or more."""
        return replace(self, limit=max(1, min(MAX_PAGE, limit or self.limit)), offset=max(0, self.offset))

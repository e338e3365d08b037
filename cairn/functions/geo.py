"""Geographic expressions: distances, Web Mercator pixels, fixed-point coordinates. All are built-in column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
MAX_MERCATOR_LAT = 85.0511287798066
TILE_PX = 256


def _col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.when(a > 1.0, F.lit(1.0)).otherwise(F.sqrt(a)))  # null if a coordinate is


def normalize_lon(lon) -> Column:
    """Longitude in (-180, 180]."""
    x = F.pmod(_col(lon) + 180.0, F.lit(360.0)) - 180.0
    return F.when(x == -180.0, F.lit(180.0)).otherwise(x)


def valid_coordinate(lat, lon) -> Column:
    return F.coalesce(_col(lat).between(-90, 90) & _col(lon).between(-180, 180), F.lit(False))


def to_e7(degrees, bound: float) -> Column:
    """Degrees, clamped to +-bound, as 1e-7 degrees with halves rounded up."""
    x = _col(degrees)  # greatest and least skip nulls
    return F.when(x.isNotNull(), F.floor(F.greatest(F.lit(-float(bound)), F.least(F.lit(float(bound)), x)) * 1e7 + 0.5).cast("int"))


def from_e7(value) -> Column:
    return _col(value).cast("double") / 1e7


def world_px(zoom: int) -> float:
    return float(TILE_PX * 2 ** max(0, min(24, math.floor(zoom))))


def lon_to_px(lon, zoom: int) -> Column:
    return (_col(lon) + 180.0) / 360.0 * F.lit(world_px(zoom))


def lat_to_px(lat, zoom: int) -> Column:
    s = F.sin(F.radians(F.greatest(F.lit(-MAX_MERCATOR_LAT), F.least(F.lit(MAX_MERCATOR_LAT), _col(lat)))))
    return F.when(_col(lat).isNotNull(), (0.5 - F.ln((1.0 + s) / (1.0 - s)) / (4 * math.pi)) * F.lit(world_px(zoom)))


def px_to_lon(x, zoom: int) -> Column:
    return _col(x) / F.lit(world_px(zoom)) * 360.0 - 180.0


def px_to_lat(y, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * _col(y) / F.lit(world_px(zoom))))))


def speed_kmh(distance_m: Column, seconds: Column) -> Column:
    """0 where no time passes."""
    return F.when(seconds > 0, distance_m / seconds * 3.6).otherwise(F.lit(0.0))

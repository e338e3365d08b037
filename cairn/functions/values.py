"""Time, string, identity and metadata expressions."""

from __future__ import annotations

from datetime import date, datetime, time, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA_KINDS = ("image", "video")
KINDS = ("image", "video", "geo_point", "timeline_visit", "timeline_activity", "activity_sample", "frequent_place")
_ISO = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?)\s*(Z|z|[+-]\d{2}:?\d{2})?)?\s*$"


def ms_to_sec(ms: Column | str) -> Column:
    """Whole epoch seconds, held in 32 bits without a sign."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.least(F.greatest(F.floor(ms / 1000), F.lit(0)), F.lit(4294967295)).cast("long")


def iso_to_ms(text: Column) -> Column:
    """ISO 8601 text as epoch milliseconds; null if it isn't one. Without a zone it is UTC."""
    day, clock, zone = (F.regexp_extract(text, _ISO, k) for k in (1, 2, 3))
    zone = F.when((zone == "") | (F.lower(zone) == "z"), F.lit("+00:00")).otherwise(F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    stamp = F.concat(day, F.lit("T"), F.when(clock == "", F.lit("00:00:00")).otherwise(clock), zone)
    return F.unix_millis(F.when(day != "", F.try_to_timestamp(stamp)))


def finite(text: Column) -> Column:
    """A finite double from a number or its text, else null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def duration_ms(start: Column, end: Column) -> Column:
    return F.when(end >= start, end - start)


def day_bound_ms(value: str | None, end: bool = False, zone: str = "UTC") -> int | None:
    """A date input: a day's first or last millisecond in the zone, an exact time with a T, None if it is invalid."""
    if not value:
        return None
    try:
        if "T" in value:
            at = datetime.fromisoformat(value.replace("Z", "+00:00"))
            at = at if at.tzinfo else at.replace(tzinfo=ZoneInfo(zone))
        else:
            at = datetime.combine(date.fromisoformat(value), time(23, 59, 59, 999000) if end else time(), ZoneInfo(zone))
    except ValueError:
        return None
    return round(at.astimezone(timezone.utc).timestamp() * 1000)


def non_empty(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def joined(*parts: Column) -> Column:
    """Parts with colons between them; a missing part is empty, not left out."""
    out: list[Column] = []
    for p in parts:
        out += [F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))]
    return F.concat(*out[1:])


def geo_point_hash(lat: Column, lon: Column, ms: Column) -> Column:
    return F.format_string("geo_point:v1:%.9f:%.9f:%d", lat, lon, ms)


def semantic_hash(kind: Column, *parts: Column) -> Column:
    return joined(F.lit("timeline:v1"), kind, *parts)


def location_id(source: Column, content: Column, dataset: Column, kind: Column, group: Column, sequence: Column) -> Column:
    return joined(F.lit("geo_point_location:v2"), source, content, dataset, kind, group, sequence)


def semantic_location_id(source: Column, content: Column) -> Column:
    return joined(F.lit("semantic_location:v1"), source, content)


def segment_group_id(index: Column, start: Column, end: Column) -> Column:
    """Of a timeline segment with 0-based index."""
    return joined(F.lit("google_timeline_segment:v1"), index + 1, start, end)


def file_occurrence_id(source: Column, path: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("\n"), path).cast("binary"), 256)


def line_source(source: Column) -> Column:
    """WIFI, CELL, GPS or UNKNOWN from a free source name."""
    up = F.upper(F.trim(source))
    up = F.when(up == "WI_FI", F.lit("WIFI")).when(up == "CELLULAR", F.lit("CELL")).otherwise(up)
    return F.when(up.isin("WIFI", "CELL", "GPS"), up).otherwise(F.lit("UNKNOWN"))


def item_line_source(source_type: Column, metadata: Column) -> Column:
    """line_source() of an item: its source type, or where that is missing the source in its metadata."""
    return line_source(F.coalesce(non_empty(source_type), metadata["source"]))


def coordinate_pair(text: Column) -> Column:
    """struct(lat, lon) from '48.13°, 11.57°'; null unless both are valid. What follows a second comma is ignored."""
    parts = F.split(text, ",")
    lat, lon = (finite(F.regexp_replace(F.get(parts, F.lit(k)), r"[^0-9.\-]", "")) for k in (0, 1))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def merged_metadata(existing: Column, incoming: Column) -> Column:
    """Two string maps; what exists wins."""
    return F.map_zip_with(existing, incoming, lambda _, a, b: F.coalesce(a, b))


def stable_json(text: Column) -> Column:
    """JSON text with the keys of all its objects in order, without spaces: equal for values that differ in key order only.

    Null for what isn't JSON, or repeats a key. Numbers lose what they don't need (2.50 is 2.5).
    """
    return F.to_json(F.try_parse_json(text))


def distance_label(metres: Column) -> Column:
    """Metres, or kilometres with two digits or none; halves are rounded up, as the decimal numbers are written."""
    return F.when(metres < 1000, F.format_string("%d m", F.round(metres).cast("long"))).when(metres < 100_000, F.format_string("%.2f km", metres / 1000)).otherwise(F.format_string("%d km", F.round(metres / 1000).cast("long")))


def count_label(n: Column) -> Column:
    """A bubble's number: with one digit and k from 1 000 on, whole k from 10 000, one digit and M from 1 000 000."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 10_000, F.concat(F.round(n / 1000).cast("long").cast("string"), F.lit("k")))
        .when(n >= 1000, F.format_string("%.1fk", n / 1000)).otherwise(n.cast("string"))
    )


def media_kind(mime: Column, path: Column) -> Column:
    """image or video, by MIME type first and file extension then; else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(mime.startswith("image/"), F.lit("image")).when(mime.startswith("video/"), F.lit("video"))
        .when(ext.isin(*IMAGE_EXTENSIONS), F.lit("image")).when(ext.isin(*VIDEO_EXTENSIONS), F.lit("video"))
    )


# Extensions of media files.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "heic", "heif", "tif", "tiff", "avif")
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "webm", "avi", "mkv", "3gp")

"""What is shown of an item: labelled facts, the sources it was seen by, and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_label(x: Column, digits: int = 0) -> Column:
    """With commas between thousands and up to so many digits after the point, halves rounded up."""
    text = F.format_number(F.round(x.cast("double"), digits), digits)
    text = F.regexp_replace(text, r"\.?0+$", "") if digits else text
    return F.regexp_replace(text, "^-0$", "0")


def metres_label(x: Column) -> Column:
    far = F.concat(number_label(x / 1000, 1), F.lit(" km"))
    return F.when(F.abs(x) >= 1000, far).otherwise(F.concat(F.when(x < 10, number_label(x, 1)).otherwise(number_label(x)), F.lit(" m")))


def group_label(group: Column) -> Column:
    """Groups of timeline segments are named by the segment's number, others by their id."""
    number = F.get(F.split(group, ":"), F.lit(2))
    return F.when(group.startswith("google_timeline_segment:v1:") & (number != ""), F.concat(F.lit("segment "), number)).otherwise(group)


def source_types() -> Column:
    """The distinct source types of an item and its locations, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array("source_type"), F.coalesce(F.transform("locations", lambda x: x["source_type"]), F.array().cast("array<string>"))))))


def item_facts() -> Column:
    """The facts of an asset as an array of (label, value), without those that are missing or empty. A number that is no number is missing."""
    number = lambda key: F.col("metadata")[key].try_cast("double")
    group = F.coalesce("group_id", F.get(F.filter(F.transform("locations", lambda x: x["group_id"]), lambda g: g.isNotNull()), F.lit(0)))
    sequence = F.coalesce("sequence", F.get(F.filter(F.transform("locations", lambda x: x["sequence"]), lambda q: q.isNotNull()), F.lit(0)))
    end = F.format_string("%.5f, %.5f", number("endLatitude"), number("endLongitude"))
    facts = {
        "dataset": F.col("source_dataset"), "source": F.col("source_type"),
        "accuracy": metres_label(F.col("accuracy_m")), "altitude": metres_label(F.col("altitude_m")), "vertical accuracy": metres_label(F.col("vertical_accuracy_m")),
        "velocity": F.concat(number_label(F.col("velocity_mps") * 3.6, 1), F.lit(" km/h")), "heading": F.concat(number_label(F.col("heading_deg")), F.lit("°")),
        "group": group_label(group), "sequence": number_label(sequence + 1),
        "activity": F.col("metadata")["activityType"], "semantic type": F.col("metadata")["semanticType"], "place id": F.col("metadata")["placeId"], "place": F.col("metadata")["label"],
        "distance": metres_label(number("distanceMeters")), "probability": F.concat(number_label(F.coalesce(number("probability"), number("topCandidateProbability")) * 100), F.lit("%")),
        "end": F.when(number("endLatitude").isNotNull() & number("endLongitude").isNotNull(), end),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in facts.items()])
    return F.filter(rows, lambda f: F.coalesce(f["value"], F.lit("")) != "")

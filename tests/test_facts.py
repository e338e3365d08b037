"""Displayed facts of an item."""


def test_facts_of_an_item(spark):
    from pyspark.sql import functions as F

    from cairn.functions.facts import item_facts, source_types
    from cairn.operators.catalog import LOCATION, as_items

    row = spark.range(1).select(
        F.lit(1234.5).alias("accuracy_m"), F.lit(9.25).alias("altitude_m"), F.lit(10.0).alias("velocity_mps"), F.lit("GPS").alias("source_type"), F.lit("").alias("source_dataset"),
        F.create_map(F.lit("probability"), F.lit("0.505"), F.lit("distanceMeters"), F.lit("x"), F.lit("endLatitude"), F.lit("1.5"), F.lit("endLongitude"), F.lit("-2")).alias("metadata"),
    )
    place = F.struct(*[F.lit({"group_id": "google_timeline_segment:v1:7:a:b", "source_type": "CELL", "sequence": 1999}.get(f.name)).cast(f.dataType).alias(f.name) for f in LOCATION])
    got = as_items(row).withColumn("locations", F.array(place)).select(item_facts().alias("f"), source_types().alias("s")).first()
    want = {"source": "GPS", "accuracy": "1.2 km", "altitude": "9.3 m", "velocity": "36 km/h", "group": "segment 7", "sequence": "2,000", "probability": "51%", "end": "1.50000, -2.00000"}
    assert {x.label: x.value for x in got.f} == want and got.s == ["CELL", "GPS"]

"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import tables
from cairn.operators.tables import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) as (id, component): each vertex of an edge with the smallest id it is connected to.

    Every step aggregates minima before it shuffles, and joins them back by join_groups, so that the edges of a vertex
    with many neighbours are spread over tasks. The number of rounds is about logarithmic in the longest path. Nulls and
    loops are left out, repeated edges count once; no edges, no rows.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    few = 2 * e.count() <= tables.MAX_BROADCAST_ROWS  # edges don't get more

    def tie(rows: DataFrame, low: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(low), "u") if few else tables.join_groups(rows, saved(low), ["u"])

    while True:
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = tie(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = large if few else saved(large)
        # Small star: every smaller neighbour of u, and u, is tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = tie(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = saved(small.filter("u > v").distinct())
        stars = new.groupBy("u").agg(F.count("*").alias("n"))
        # It is over when each u has one v, and no v is a u.
        if stars.filter("n > 1").isEmpty() and new.join(new.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("v").alias("component"))
        e = new

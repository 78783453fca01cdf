"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.tables import written


def _mark(edges: DataFrame) -> tuple:
    # order-free summary: equal edge sets give equal sums
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``edges(a, b)``: the smallest id that can be reached.

    Repeated edges, loops and an empty list are fine. Every round writes the edges to the
    shared folder, so lineage stays short and no label passes through the driver.
    """
    now = written(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"),
        ).select("e.u", "e.v").filter("u <> v").distinct()
        now, before = written(small), mark
        mark = _mark(now)
        if mark == before:
            break
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())

"""Connected groups of an edge list in a number of rounds that grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.tables import written


def connected(edges: DataFrame) -> DataFrame:
    """``(id, group)`` for both ends of ``edges(id_a, id_b)``: the lowest id that can be reached.

    Every id points to an id no higher than itself. A round moves what an id's root points to down to the lowest
    pointer among the neighbours of its members, then lets every id point where its pointer points. A row per edge and round is
    aggregated by id before it is shuffled, so a hub costs no more than its edges.
    """
    both = written(edges.filter("id_a <> id_b").select("id_a", "id_b").unionByName(
        edges.filter("id_a <> id_b").select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).distinct())
    now = written(both.groupBy("id_a").agg(F.min("id_b").alias("low")).select(F.col("id_a").alias("id"), F.least("id_a", "low").alias("group")))
    while True:
        seen = both.join(now.toDF("id_b", "other"), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.min("other").alias("other"))
        offered = written(now.join(seen, "id").select("id", "group", F.least("group", "other").alias("best")))
        moved = offered.groupBy("group").agg(F.min("best").alias("to")).filter("to < group")
        hooked = now.join(moved.toDF("id", "to"), "id", "left").join(offered.select("id", "best"), "id").select(
            "id", F.least("group", "best", F.coalesce("to", "group")).alias("group"))
        hooked = written(hooked)
        jumped = written(hooked.join(hooked.toDF("group", "further"), "group").select("id", F.col("further").alias("group")))
        changed = not jumped.join(now.toDF("id", "old"), "id").filter("group <> old").isEmpty()
        now = jumped
        if not changed:
            return now

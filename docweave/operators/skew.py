"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def hot_keys(counts: DataFrame, key: str, share: int = SHARE) -> DataFrame | None:
    """Keys that hold more than 1/``share`` of all rows, with a number of salts each.

    ``counts(key, n)`` gives the rows per key. There are fewer than ``share`` such keys
    whatever the data size, so the result is a small local table. None if there is none.
    """
    total = counts.agg(F.sum("n")).scalar()
    hot = counts.filter(F.col("n") * share > total).select(
        key, F.ceil(F.col("n") * share / total).cast("int").alias("_salts"))
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame | None, spread: str) -> DataFrame:
    """Inner equi-join on ``key``; rows of hot keys in ``big`` are split over salts.

    The matching rows of ``small`` are repeated once per salt. ``spread`` names a column
    of ``big`` that tells the rows of one key apart.
    """
    if hot is None:
        return big.join(small, key)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = big.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), salts).cast("int")
    ).drop("_salts")
    right = small.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    ).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")

"""Positions and running sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.tables import written


def _sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partitioned by the order, each partition sorted and numbered.

    The slice number comes from the partition that range partitioning chose, so rows of a
    lower slice precede those of a higher one. The result is written once: the slices are read
    twice and sampled range bounds need not repeat if a task is run again.
    """
    parted = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    return written(parted)


def running(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """Add running sums over the whole table in ``order`` (which must be unique).

    Each slice sums its own rows; the totals of earlier slices, one row per slice, are
    added by a broadcast join.
    """
    sliced = _sliced(df.select("*", *(e.alias(f"_in_{n}") for n, e in sums.items())), order)
    totals = sliced.groupBy("_slice").agg(*(F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", *(
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    upto = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.join(F.broadcast(offsets), "_slice")
    for n in sums:
        out = out.withColumn(n, F.sum(f"_in_{n}").over(upto) + F.col(f"_o_{n}"))
    return out.select(*df.columns, *sums)


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based position of every row in ``order``."""
    return running(df, order, **{name: F.lit(1).cast("bigint")})

"""Conversation sessions and bounded histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.ranks import _sliced

GAP_SECONDS = 300
HISTORY = 10


def sessionize(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Sessions of ``events(user_id, ts, event_id)``: a gap longer than ``gap_seconds`` starts one.

    Rows are range-partitioned by (user, time), so one busy user spreads over tasks.
    Each slice needs from the earlier ones only their last row and number of sessions.
    """
    s = _sliced(events.select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"])
    here = Window.partitionBy("_slice").orderBy("user_id", "ts", "event_id")
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last = s.groupBy("_slice").agg(F.max(F.struct("user_id", "ts")).alias("last"))
    before = last.select("_slice", F.max("last").over(earlier).alias("before"))

    previous = F.coalesce(F.lag(F.struct("user_id", "ts")).over(here), F.col("before"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = micros("ts") - micros("previous.ts")
    opens = (
        F.col("previous").isNull() | (F.col("previous.user_id") != F.col("user_id")) | (gap > gap_seconds * 1_000_000)
    )
    flagged = (
        s.join(F.broadcast(before), "_slice").withColumn("previous", previous)
        .select("_slice", "user_id", "ts", "event_id", opens.cast("bigint").alias("opens"))
    )
    counts = flagged.groupBy("_slice").agg(F.sum("opens").alias("n"))
    offset = counts.select("_slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered = flagged.join(F.broadcast(offset), "_slice").withColumn(
        "session", F.sum("opens").over(here.rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset"))
    return (
        numbered.groupBy("session", "user_id")
        .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n_events"))
        .drop("session")
    )


def history(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """Last ``n`` turns of every conversation; long ones are cut inside each task first."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w).cast("bigint")).filter(F.col("back") <= n)


def conversation_prompt(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """One prompt per conversation from its bounded history."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"), F.lit("\n"))
    lines = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return history(turns, n).groupBy("conv_id").agg(
        F.concat(F.array_join(F.transform(lines, lambda e: e["line"]), ""), F.lit("Assistant: ")).alias("prompt"))

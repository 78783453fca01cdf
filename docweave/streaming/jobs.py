"""Structured Streaming forms of the stateful operators.

Every job takes a streaming DataFrame and folders for output and checkpoint, and runs
with ``availableNow`` unless another trigger is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.operators import feedback as fb
from docweave.operators.ranks import global_rank
from docweave.operators.sessions import GAP_SECONDS, HISTORY
from docweave.operators.tables import written

AVAILABLE = {"availableNow": True}


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder as a file stream; the table is one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a stream takes no single file by its name, but by a pattern that only this name fits
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _each_batch(stream: DataFrame, save, checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE)).foreachBatch(save).start()
    )


def feedback_counters(log: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running feedback statistics per category. State and output hold one row per category."""
    stats = fb.feedback_stats(fb.complete(log), "predicted")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return _each_batch(stats, save, checkpoint, "complete", trigger)


def latest_epoch(spark: SparkSession, out: str) -> DataFrame:
    """Output of the last batch."""
    all_epochs = spark.read.parquet(out)
    return all_epochs.filter(F.col("epoch") == all_epochs.agg(F.max("epoch")).scalar()).drop("epoch")


def with_end(events: DataFrame, days: int = 1) -> DataFrame:
    """Bounded events and an end mark: one row without a user, later than all others.

    Once it has been read, the watermark closes every session of the input.
    """
    end = events.agg((F.max("ts") + F.make_interval(days=F.lit(days))).alias("ts"))
    return events.unionByName(end.select(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), "ts"))


def session_stream(events: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes",
                   gap_seconds: int = GAP_SECONDS, trigger: dict | None = None) -> StreamingQuery:
    """Sessions, written once the watermark has passed their end.

    An event at exactly the gap still joins. Events later than ``delay`` are dropped, the
    sessions still open at the end stay in the state; a bounded input gets an end mark (``with_end``).
    """
    sessions = (
        events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w"))
        .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n_events"))
        .drop("w")
    )
    return (
        sessions.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE)).start()
    )


def history_stream(events: DataFrame, out: str, checkpoint: str, keep: int = HISTORY,
                   gap_seconds: int = GAP_SECONDS, delay: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Last ``keep`` entries of every user's current session, after each batch.

    The state holds at most ``keep`` entries of a user, and goes once the watermark has passed the end of the
    session: a later event begins a new one in any case. What was written stays. Rows arrive in pieces and in any
    order: each piece is merged into the newest entries and dropped. Events later than ``delay`` are not taken.
    """
    def latest(key, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = pd.DataFrame({"micros": list(state.get[0]), "event_id": list(state.get[1])}) if state.exists else None
        for piece in pieces:
            piece = piece[["micros", "event_id"]]
            both = piece if kept is None else pd.concat([kept, piece])
            kept = both.sort_values(["micros", "event_id"]).tail(keep)
        state.update((kept["micros"].tolist(), kept["event_id"].tolist()))
        over = int(kept["micros"].iloc[-1]) // 1000 + gap_seconds * 1000 + 1
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        breaks = (kept["micros"].diff() > gap_seconds * 1_000_000).to_numpy()
        start = int(breaks.nonzero()[0][-1]) if breaks.any() else 0
        now = kept.iloc[start:]
        yield pd.DataFrame({
            "user_id": key[0], "event_id": now["event_id"].to_numpy(), "back": range(len(now), 0, -1)})

    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    rows = timed.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("micros"))
    updates = rows.groupBy("user_id").applyInPandasWithState(
        latest, "user_id long, event_id long, back long", "micros array<long>, ids array<long>",
        "update", GroupStateTimeout.EventTimeTimeout)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return _each_batch(updates, save, checkpoint, "update", trigger)


def current_histories(spark: SparkSession, out: str) -> DataFrame:
    """Newest history of every user."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy("user_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, ["user_id", "epoch"], "left_semi").drop("epoch")


def implicit_feedback(classified: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Confident conversation as positive feedback."""
    return (
        fb.implicit(classified).writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE)).start()
    )


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def learning_stream(log: DataFrame, out: str, checkpoint: str, interval: int = 50,
                    min_confidence: float = 0.75, per_category: int = 30, trigger: dict | None = None) -> StreamingQuery:
    """Learn examples each time ``interval`` feedback entries have come in, from these entries.

    Entries are numbered in order of time within a batch, and batches in order of arrival; a batch may
    complete any number of updates, all in one pass. An update learns confidently misclassified queries, the newest ``per_category`` of
    each category; a query counts in the first update that sees it. Folders: ``pending`` the entries since
    the last update, ``counts`` entries and updates so far, ``examples`` what was learned. Every folder is keyed by batch, so a
    repeated batch overwrites its own output only, and no batch reads entries of finished updates.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        counts = _read_or_none(spark, f"{out}/counts")
        last = None if counts is None else counts.filter(F.col("epoch") < epoch).orderBy(F.desc("epoch")).first()
        before, done = (last.total, last.updates) if last else (0, 0)
        numbered = global_rank(batch, ["ts", "entry_id"], "pos").withColumn("pos", F.col("pos") + before)
        if last and (open_ones := _read_or_none(spark, f"{out}/pending/epoch={last.epoch}")) is not None:
            numbered = open_ones.unionByName(numbered)
        numbered = written(numbered)
        total = before + batch.count()
        updates = total // interval
        if updates > done:
            seen = numbered.filter(F.col("pos") <= updates * interval).withColumn(
                "update_no", F.floor((F.col("pos") - 1) / interval).cast("bigint") + 1)
            wrong = seen.filter(~F.col("is_correct") & (F.col("confidence") >= min_confidence)).groupBy(
                "query_id", F.col("correct").alias("category")).agg(F.min(F.struct("update_no", "ts", "entry_id")).alias("e")).select(
                "query_id", "category", "e.*")
            known = _read_or_none(spark, f"{out}/examples")
            if known is not None:
                wrong = wrong.join(known.filter(F.col("epoch") < epoch).select("query_id", "category"), ["query_id", "category"], "left_anti")
            fb.newest_per(wrong, per_category, "update_no", "category").select("query_id", "category", "update_no", "pos").write.mode(
                "overwrite").parquet(f"{out}/examples/epoch={epoch}")
        numbered.filter(F.col("pos") > updates * interval).write.mode("overwrite").parquet(f"{out}/pending/epoch={epoch}")
        spark.createDataFrame([(total, updates)], "total long, updates long").write.mode("overwrite").parquet(
            f"{out}/counts/epoch={epoch}")

    return _each_batch(log, step, checkpoint, "append", trigger)


def corpus_stream(docs: DataFrame, chunker, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep chunks in step with arriving ``(doc_id, version, text)``; NULL text deletes.

    Each batch appends digests and chunks of the documents that really changed; nothing
    older is rewritten. ``current_chunks`` reads the newest version of every document.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("doc_id").agg(F.max_by("text", "version").alias("text"))
        seen = _read_or_none(spark, f"{out}/documents")
        if seen is not None:
            touched = seen.filter(F.col("epoch") < epoch).join(batch.select("doc_id"), "doc_id", "left_semi")
            now = touched.groupBy("doc_id").agg(
                F.max_by("digest", "epoch").alias("known"))
            fresh = fresh.join(now, "doc_id", "left").filter(
                ~F.col("known").eqNullSafe(F.coalesce(F.md5("text"), F.lit("")))).drop("known")
        chunker(fresh.filter("text is not null")).write.mode("overwrite").parquet(f"{out}/chunks/epoch={epoch}")
        fresh.select("doc_id", F.coalesce(F.md5("text"), F.lit("")).alias("digest")).write.mode("overwrite").parquet(
            f"{out}/documents/epoch={epoch}")

    return _each_batch(docs, step, checkpoint, "append", trigger)


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    newest = spark.read.parquet(f"{out}/documents").groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{out}/chunks").join(newest, ["doc_id", "epoch"], "left_semi").drop("epoch")


"""Streaming jobs over the given tables, run to the end of the available data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.operators import chunking, intents
from docweave.operators.ranks import global_rank
from docweave.operators.tables import shared_folder, written
from docweave.plans import derived
from docweave.plans.corpus import CHUNKS
from docweave.plans.derived import with_inputs
from docweave.plans.intents import PATTERN
from docweave.plans.learning import STATS
from docweave.plans.registry import query
from docweave.sources.tables import table
from docweave.streaming import jobs


def _folders(spark) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _stream_of(df):
    """A derived table as a file stream."""
    spark = df.sparkSession
    table = written(df)
    return spark.readStream.schema(df.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])


def _in_parts(df, order: list[str], parts: int, run) -> None:
    """``run(stream)`` again and again while ``df`` arrives in ``parts`` by its order; a run goes on from the last one's checkpoint."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}/in"
    ranked = written(global_rank(df, order, "_pos"))
    n = ranked.count()
    for i in range(parts):
        ranked.filter((F.col("_pos") > n * i // parts) & (F.col("_pos") <= n * (i + 1) // parts)).drop("_pos").write.mode(
            "append").parquet(folder)
        run(spark.readStream.schema(df.schema).parquet(folder))


@query("feedback_stream", with_inputs("feedback", f"""
SELECT predicted, {STATS} FROM (SELECT * REPLACE (coalesce(is_correct, predicted = correct) AS is_correct) FROM feedback)
GROUP BY 1"""))
def feedback_stream(spark, sf):
    out, checkpoint = _folders(spark)
    jobs.feedback_counters(_stream_of(derived.feedback(spark, sf)), out, checkpoint).awaitTermination()
    return jobs.latest_epoch(spark, out)


@query("session_stream", """
WITH gaps AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 300 SECONDS, true) AS opens FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM gaps)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM numbered GROUP BY user_id, s""")
def session_stream(spark, sf):
    """All sessions of the table: an end mark moves the watermark past the last of them."""
    out, checkpoint = _folders(spark)
    events = jobs.with_end(table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")))
    jobs.session_stream(_stream_of(events), out, checkpoint).awaitTermination()
    done = spark.read.parquet(out).filter("user_id is not null")
    return done.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n_events")


@query("history_stream", """
WITH gaps AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 300 SECONDS, true) AS opens FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM gaps)
SELECT user_id, event_id, back FROM numbered n WHERE back <= 10
  AND s = (SELECT max(s) FROM numbered m WHERE m.user_id = n.user_id)""")
def history_stream(spark, sf):
    """Current histories after the events have arrived in three parts; sessions that are over leave the state."""
    out, checkpoint = _folders(spark)
    events = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    _in_parts(events, ["ts", "event_id"], 3, lambda stream: jobs.history_stream(stream, out, checkpoint).awaitTermination())
    return jobs.current_histories(spark, out)


@query("implicit_feedback_stream", with_inputs("query_log", f"""--cte {PATTERN}
SELECT query_id, category AS predicted, confidence, true AS is_correct FROM pattern
WHERE category = 'CONVERSATION' AND confidence > 0.8"""))
def implicit_feedback_stream(spark, sf):
    out, checkpoint = _folders(spark)
    classified = intents.classify_pattern(_stream_of(derived.query_log(spark, sf)))
    jobs.implicit_feedback(classified, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("learning_stream", with_inputs("feedback", """--cte
numbered AS (SELECT *, row_number() OVER (ORDER BY ts, entry_id) AS n, count(*) OVER () AS total FROM feedback),
updates AS (SELECT *, (n - 1) // 50 + 1 AS update_no FROM numbered WHERE n <= total // 50 * 50),
fresh AS (SELECT query_id, correct AS category, update_no, ts, entry_id FROM updates WHERE NOT is_correct AND confidence >= 0.3
  QUALIFY row_number() OVER (PARTITION BY query_id, correct ORDER BY update_no, ts, entry_id) = 1)
SELECT * FROM (SELECT query_id, category, update_no,
  row_number() OVER (PARTITION BY update_no, category ORDER BY ts DESC, entry_id DESC) AS pos FROM fresh) WHERE pos <= 30"""))
def learning_stream(spark, sf):
    """Examples learned by update while the log arrives in ten parts by time."""
    out, checkpoint = _folders(spark)
    _in_parts(derived.feedback(spark, sf), ["ts", "entry_id"], 10,
              lambda stream: jobs.learning_stream(stream, out, checkpoint, min_confidence=0.3).awaitTermination())
    return spark.read.parquet(f"{out}/examples").select("query_id", "category", "update_no", "pos")


@query("corpus_stream", f"WITH {CHUNKS} SELECT doc_id, chunk_index, text FROM chunks")
def corpus_stream(spark, sf):
    """Chunks after all documents have arrived on the stream."""
    out, checkpoint = _folders(spark)
    docs = jobs.table_stream(spark, sf, "documents").select("doc_id", F.lit(0).alias("version"), "text")
    jobs.corpus_stream(docs, chunking.chunk_fixed, out, checkpoint).awaitTermination()
    return jobs.current_chunks(spark, out).select("doc_id", "chunk_index", "text")

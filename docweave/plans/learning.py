"""Feedback statistics, selection and learning; conversations and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.operators import feedback as fb
from docweave.operators import intents, sessions
from docweave.operators.examples import ExampleStore
from docweave.operators.prototypes import nearest_example
from docweave.operators.tables import shared_folder
from docweave.plans import derived
from docweave.plans.derived import with_inputs
from docweave.plans.intents import NEAREST, PATTERN, QKEY, s_greedy
from docweave.plans.registry import query, s_count
from docweave.sources.tables import table

STATS = """count(*) AS total, count_if(is_correct)::BIGINT AS correct, count_if(NOT is_correct)::BIGINT AS incorrect,
  (sum(confidence::DECIMAL(20, 8)) FILTER (is_correct))::DOUBLE / nullif(count_if(is_correct), 0) AS avg_confidence_correct,
  (sum(confidence::DECIMAL(20, 8)) FILTER (NOT is_correct))::DOUBLE / nullif(count_if(NOT is_correct), 0)
    AS avg_confidence_incorrect,
  round(count_if(is_correct) / nullif(count(is_correct), 0), 6) AS accuracy"""


@query("feedback_stats", with_inputs("feedback", f"SELECT {STATS} FROM feedback"))
def feedback_stats(spark, sf):
    return fb.feedback_stats(derived.feedback(spark, sf))


@query("feedback_by_category", with_inputs("feedback", f"""
SELECT predicted, {STATS} FROM (SELECT * REPLACE (coalesce(is_correct, predicted = correct) AS is_correct) FROM feedback)
GROUP BY 1"""))
def feedback_by_category(spark, sf):
    return fb.feedback_stats(fb.complete(derived.feedback(spark, sf)), "predicted")


@query("feedback_entries", with_inputs("feedback", """
SELECT entry_id, predicted, correct, confidence FROM feedback WHERE NOT is_correct ORDER BY ts DESC, entry_id DESC LIMIT 100"""))
def feedback_entries(spark, sf):
    return fb.feedback_entries(derived.feedback(spark, sf), 100, only_incorrect=True).select(
        "entry_id", "predicted", "correct", "confidence")


@query("training_selection", with_inputs("feedback", """--cte
valid AS (SELECT *, row_number() OVER (PARTITION BY predicted ORDER BY ts DESC, entry_id DESC) AS pos,
    count(*) OVER (PARTITION BY predicted) AS n, count(*) OVER () AS total
  FROM (SELECT * FROM feedback ORDER BY ts DESC, entry_id DESC LIMIT 1000) WHERE is_correct AND confidence >= 0.25)
SELECT predicted, entry_id, pos, confidence FROM valid WHERE n >= 5 AND total >= 10 AND pos <= 10"""))
def training_selection(spark, sf):
    return fb.training_selection(derived.feedback(spark, sf), min_confidence=0.25).select(
        "predicted", "entry_id", "pos", "confidence")


@query("train_from_feedback", with_inputs("query_vectors", f"""--cte {NEAREST},
right_ones AS (SELECT b.query_id, b.category, v.text, v.embedding FROM query_best b JOIN query_vectors v USING (query_id)
  JOIN query_log l USING (query_id) WHERE l.session_id % 4 <> 0 AND {s_count('v.text')} >= 3),
nearest AS (SELECT c.query_id, max(coalesce(round(list_dot_product(c.embedding, e.embedding::DOUBLE[])
    / nullif(sqrt(list_dot_product(c.embedding, c.embedding)), 0)
    / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6), 0)) AS score
  FROM right_ones c JOIN embeddings e ON e.label = c.category GROUP BY 1),
picked AS (SELECT * FROM (SELECT * FROM right_ones QUALIFY row_number() OVER (PARTITION BY category, {QKEY} ORDER BY query_id) = 1)
  JOIN nearest USING (query_id) WHERE score <= 0.35), {s_greedy("picked", 0.7)}"""))
def train_from_feedback(spark, sf):
    """Queries whose nearest category was confirmed become descriptions of it, if they are novel."""
    vectors, log = derived.query_vectors(spark, sf), derived.query_log(spark, sf)
    predicted = nearest_example(vectors, derived.vectors(spark, sf)).select("query_id", F.col("category").alias("predicted"))
    verdicts = predicted.join(log.select("query_id", (F.col("session_id") % 4 != 0).alias("is_correct")), "query_id")
    return intents.train_from_feedback(verdicts, vectors, derived.vectors(spark, sf), below=0.35, apart=0.7).drop("description")


@query("example_centroids", """
WITH dims AS (SELECT label AS category, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT category, pos::BIGINT AS dim, round(avg(x), 6) AS value, count(*) AS n FROM dims GROUP BY 1, 2""")
def example_centroids(spark, sf):
    """Centroids after examples were added in three batches that overlap; equal to those of all vectors at once."""
    v = derived.vectors(spark, sf).withColumnRenamed("doc_id", "example_id")
    store = ExampleStore(spark, f"{shared_folder(spark)}/examples/{uuid.uuid4().hex}")
    for part in ("example_id % 3 = 0", "example_id % 2 = 0", "true"):
        store.add(v.filter(part))
    return store.centroids().select("category", F.posexplode("embedding").alias("pos", "value"), "n").select(
        "category", (F.col("pos") + 1).cast("bigint").alias("dim"), F.round("value", 6).alias("value"), "n")


@query("update_batches", with_inputs("feedback", """
SELECT entry_id, row_number() OVER (ORDER BY ts, entry_id) AS pos,
  (row_number() OVER (ORDER BY ts, entry_id) - 1) // 50 AS batch FROM feedback"""))
def update_batches(spark, sf):
    return fb.update_batches(derived.feedback(spark, sf)).select("entry_id", "pos", "batch")


@query("learn_examples", with_inputs("feedback", """--cte
wrong AS (SELECT * FROM feedback WHERE NOT is_correct AND confidence >= 0.3 ORDER BY ts DESC, entry_id DESC LIMIT 100),
known AS (SELECT query_id, correct AS category FROM feedback WHERE is_correct IS NULL OR query_id % 13 = 0),
fresh AS (SELECT query_id, correct AS category, confidence,
    row_number() OVER (PARTITION BY correct ORDER BY ts DESC, entry_id DESC) AS pos
  FROM wrong w WHERE NOT EXISTS (FROM known k WHERE k.query_id = w.query_id AND k.category = w.correct))
SELECT query_id, category, pos, confidence FROM fresh WHERE pos <= 30"""))
def learn_examples(spark, sf):
    log = derived.feedback(spark, sf)
    known = log.filter("is_correct IS NULL OR query_id % 13 = 0").select("query_id", F.col("correct").alias("category"))
    return fb.learn_examples(log, known, min_confidence=0.3)


@query("query_history", with_inputs("feedback", """
SELECT is_correct AS successful, query_id, pos FROM (SELECT *, row_number() OVER (
  PARTITION BY is_correct ORDER BY ts DESC, entry_id DESC) AS pos FROM feedback WHERE is_correct IS NOT NULL)
WHERE pos <= 100"""))
def query_history(spark, sf):
    return fb.query_history(derived.feedback(spark, sf)).select(
        F.col("is_correct").alias("successful"), "query_id", "pos")


@query("keep_last", with_inputs("feedback", """
SELECT entry_id FROM feedback ORDER BY ts DESC, entry_id DESC LIMIT 500"""))
def keep_last(spark, sf):
    return fb.newest(derived.feedback(spark, sf), 500).select("entry_id")


@query("implicit_feedback", with_inputs("query_log", f"""--cte {PATTERN}
SELECT query_id, category AS predicted, confidence, true AS is_correct FROM pattern
WHERE category = 'CONVERSATION' AND confidence > 0.8"""))
def implicit_feedback(spark, sf):
    return fb.implicit(intents.classify_pattern(derived.query_log(spark, sf)))


@query("sessionize", """
WITH gaps AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 300 SECONDS, true) AS opens FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM gaps)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM numbered
GROUP BY user_id, s""")
def sessionize(spark, sf):
    return sessions.sessionize(table(spark, sf, "events"))


@query("conversation_history", """
SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
  FROM conversations) WHERE back <= 10""")
def conversation_history(spark, sf):
    return sessions.history(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "back")


@query("conversation_prompt", """
SELECT conv_id, string_agg(upper(role[1]) || substr(role, 2) || ': ' || text || chr(10), '' ORDER BY turn)
  || 'Assistant: ' AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
WHERE back <= 10 GROUP BY 1""")
def conversation_prompt(spark, sf):
    return sessions.conversation_prompt(table(spark, sf, "conversations"))

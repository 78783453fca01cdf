"""Feedback log: statistics, selection and learning.

The log is ``(entry_id, query_id, predicted, correct, confidence, is_correct, ts)``.
``is_correct`` may be NULL; such rows count only in the total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.scores import exact_mean
from docweave.operators.ranks import global_rank


def complete(log: DataFrame) -> DataFrame:
    """Fill a missing verdict from the two categories."""
    return log.withColumn("is_correct", F.coalesce("is_correct", F.col("predicted") == F.col("correct")))


def feedback_stats(log: DataFrame, *by: str) -> DataFrame:
    ok, bad = F.col("is_correct"), ~F.col("is_correct")
    return log.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("correct"),
        F.count_if(bad).alias("incorrect"),
        exact_mean(F.col("confidence"), ok).alias("avg_confidence_correct"),
        exact_mean(F.col("confidence"), bad).alias("avg_confidence_incorrect"),
        F.round(F.try_divide(F.count_if(ok), F.count_if(ok) + F.count_if(bad)), 6).alias("accuracy"),
    )


def newest(log: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` entries over all; a top-n per partition, then one merge of at most n each."""
    return log.orderBy(F.desc("ts"), F.desc("entry_id")).limit(n)


def feedback_entries(log: DataFrame, limit: int = 100, category=None, only_incorrect: bool = False) -> DataFrame:
    if category is not None:
        log = log.filter(F.col("predicted") == category)
    if only_incorrect:
        log = log.filter(~F.col("is_correct"))
    return newest(log, limit)


def newest_per(log: DataFrame, n: int, *by: str) -> DataFrame:
    """Newest ``n`` entries per group; groups are cut inside each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("entry_id"))
    return log.withColumn("pos", F.row_number().over(w).cast("bigint")).filter(F.col("pos") <= n)


def training_selection(log: DataFrame, min_confidence: float = 0.8, min_samples: int = 10,
                       min_per_category: int = 5, per_category: int = 10, window: int | None = 1000) -> DataFrame:
    """Confident, correct entries for training: the newest per well-covered category.

    ``window`` limits the search to the newest entries of the whole log.
    """
    log = newest(log, window) if window else log
    valid = log.filter(F.col("is_correct") & (F.col("confidence") >= min_confidence))
    sizes = valid.groupBy("predicted").agg(F.count("*").alias("n"))
    enough = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar() >= min_samples
    kept = sizes.filter((F.col("n") >= min_per_category) & enough).select("predicted")
    return newest_per(valid.join(kept, "predicted", "left_semi"), per_category, "predicted")


def update_batches(log: DataFrame, interval: int = 50) -> DataFrame:
    """Number of the learning update each entry belongs to, in order of arrival."""
    return global_rank(log, ["ts", "entry_id"], "pos").withColumn(
        "batch", F.floor((F.col("pos") - 1) / interval).cast("bigint"))


def learn_examples(log: DataFrame, known: DataFrame, min_confidence: float = 0.75,
                   recent: int | None = 100, per_category: int = 30) -> DataFrame:
    """Confidently misclassified queries to add as examples of their correct category.

    ``known(query_id, category)`` are existing examples. Only the newest ``recent`` entries are
    looked at; None takes all.
    """
    wrong = log.filter(~F.col("is_correct") & (F.col("confidence") >= min_confidence))
    wrong = newest(wrong, recent) if recent else wrong
    new = wrong.withColumn("category", F.col("correct")).join(known, ["query_id", "category"], "left_anti")
    return newest_per(new, per_category, "category").select("query_id", "category", "pos", "confidence")


def query_history(log: DataFrame, n: int = 100) -> DataFrame:
    """Last ``n`` successful and last ``n`` unsuccessful queries."""
    return newest_per(log.filter("is_correct is not null"), n, "is_correct")


def implicit(classified: DataFrame, above: float = 0.8) -> DataFrame:
    """Confident conversation needs no verdict: positive feedback at once. Also runs on a stream."""
    return classified.filter((F.col("category") == "CONVERSATION") & (F.col("confidence") > above)).select(
        "query_id", F.col("category").alias("predicted"), "confidence", F.lit(True).alias("is_correct"))

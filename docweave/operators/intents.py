"""Combining intent classifiers, reusing results, and learning descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import intent
from docweave.functions import text as tx
from docweave.functions.scores import exact_mean
from docweave.functions.vectors import cosine
from docweave.operators.tables import written
from docweave.operators.vector import vector_topk

# Votes of the pattern and the vector classifier.
PATTERN_WEIGHT, VECTOR_WEIGHT = 0.6, 0.4


def classify_pattern(queries: DataFrame) -> DataFrame:
    q = F.col("text")
    return queries.select("query_id", "text", intent.pattern_category(q).alias("category"),
                          intent.pattern_confidence(q).alias("confidence"))


def classify_ensemble(queries: DataFrame, vector_votes: DataFrame) -> DataFrame:
    """Weighted vote of the pattern rules and ``vector_votes(query_id, category, score)``.

    With two voters the sums per category are a plain comparison, ties go to the rules.
    """
    pattern = classify_pattern(queries).withColumnRenamed("category", "p_cat").withColumnRenamed("confidence", "p")
    both = pattern.join(vector_votes.select("query_id", F.col("category").alias("v_cat"), F.col("score").alias("v")), "query_id")
    agree = F.col("p_cat") == F.col("v_cat")
    wp, wv = F.col("p") * PATTERN_WEIGHT, F.col("v") * VECTOR_WEIGHT
    rules_win = agree | (wp >= wv)
    weight = F.when(agree, wp + wv).when(rules_win, wp).otherwise(wv)
    mean = F.when(agree, (F.col("p") + F.col("v")) / 2).when(rules_win, F.col("p")).otherwise(F.col("v"))
    find = F.startswith(F.lower("text"), F.lit("find "))
    return both.select(
        "query_id",
        F.when(find, F.lit(intent.SEARCH)).when(rules_win, F.col("p_cat")).otherwise(F.col("v_cat")).alias("category"),
        F.when(find, F.lit(1.0)).otherwise(0.7 * weight + 0.3 * mean).alias("confidence"),
        agree.alias("agree"),
    )


def classify_cascade(first: DataFrame, second: DataFrame, trust_first: float = 0.7, trust_second: float = 0.6) -> DataFrame:
    """First classifier where it is sure, else the second where that is sure, else the first."""
    s = second.select("query_id", F.col("category").alias("c2"), F.col("score").alias("s2"))
    take_second = (F.col("score") < trust_first) & (F.col("s2") >= trust_second)
    return first.join(s, "query_id", "left").select(
        "query_id",
        F.when(take_second, F.col("c2")).otherwise(F.col("category")).alias("category"),
        F.when(take_second, F.col("s2")).otherwise(F.col("score")).alias("score"),
    )


def category_stats(classified: DataFrame, threshold: float) -> DataFrame:
    c = F.col("confidence")
    return classified.groupBy("category").agg(
        F.count("*").alias("calls"), exact_mean(c).alias("avg_confidence"),
        F.count_if(c >= threshold).alias("above"), F.count_if(c < threshold).alias("below"))


def query_reuse(log: DataFrame) -> DataFrame:
    """Per normalized query: first request, requests, and how many a result cache would answer."""
    return (
        log.groupBy(tx.query_key(F.col("text")).alias("query_key"))
        .agg(F.min("query_id").alias("first_id"), F.count("*").alias("requests"))
        .withColumn("hits", F.col("requests") - 1)
    )


def reuse_stats(log: DataFrame) -> DataFrame:
    return query_reuse(log).agg(
        F.count("*").alias("misses"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.round(100 * F.try_divide(F.sum("hits"), F.sum("requests")), 2).alias("hit_rate"))


def split_cached(queries: DataFrame, cached: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Queries answered by ``cached(query_key, k)`` and those still to compute."""
    keyed = queries.withColumn("query_key", tx.query_key(F.col("text")))
    known = cached.filter(F.col("k") == k).select("query_key")
    return keyed.join(known, "query_key", "left_semi"), keyed.join(known, "query_key", "left_anti")


# Limits for learned descriptions.
NOVEL_BELOW = 0.85
MIN_WORDS = 3
MAX_NEW = 4


def novel_examples(candidates: DataFrame, prototypes: DataFrame, below: float = NOVEL_BELOW,
                   max_new: int = MAX_NEW, apart: float = NOVEL_BELOW) -> DataFrame:
    """Up to ``max_new`` queries per category unlike every prototype of that category and unlike each other.

    ``candidates(query_id, text, category, embedding)`` are taken in order of id; of equal texts (by query key) the
    first one counts. One that is accepted bars later ones more than ``apart`` like it. As many rounds as examples are
    wanted decide this: the first open candidate of a category is accepted, and those like it go.
    """
    long_enough = candidates.filter(tx.word_count(F.col("text")) >= MIN_WORDS)
    nearest = vector_topk(long_enough, prototypes, 1, within="category").select("query_id", "score")
    first = long_enough.groupBy("category", tx.query_key(F.col("text"))).agg(F.min("query_id").alias("query_id")).select("query_id")
    still = written(
        long_enough.join(first, "query_id", "left_semi").join(nearest, "query_id", "left")
        .filter(F.coalesce("score", F.lit(-1.0)) <= below)
        .select("query_id", "category", "embedding", intent.description_of(F.col("text")).alias("description")))
    accepted = None
    for pos in range(1, max_new + 1):
        chosen = written(still.groupBy("category").agg(F.min_by(F.struct("query_id", "embedding", "description"), "query_id").alias("e")).select(
            "category", F.col("e.query_id").alias("chosen"), F.col("e.embedding").alias("chosen_embedding"), F.col("e.description").alias("description")))
        row = chosen.select(F.col("chosen").alias("query_id"), "category", F.lit(pos).cast("bigint").alias("pos"), "description")
        accepted = row if accepted is None else accepted.unionByName(row)
        if pos < max_new:
            met = still.join(chosen.drop("description"), "category")
            still = written(met.filter((F.col("query_id") != F.col("chosen")) & (
                F.round(cosine(F.col("embedding"), F.col("chosen_embedding")), 6) <= apart)).select(still.columns))
    return accepted


def train_from_feedback(log: DataFrame, queries: DataFrame, prototypes: DataFrame, below: float = NOVEL_BELOW,
                        max_new: int = MAX_NEW, apart: float = NOVEL_BELOW) -> DataFrame:
    """Confirmed entries of ``log(query_id, predicted, is_correct)`` as candidates for their category."""
    confirmed = log.filter("is_correct").select("query_id", F.col("predicted").alias("category"))
    return novel_examples(confirmed.join(queries.select("query_id", "text", "embedding"), "query_id"),
                          prototypes, below, max_new, apart)

"""Vector intent classifiers: nearest example, nearest description, centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators.vector import centroids, vector_topk


def nearest_example(queries: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Category of the most similar prototype: ``(query_id, category, score)``.

    The best category by its own best prototype is the category of the best prototype.
    """
    best = vector_topk(queries, prototypes, 1).select("query_id", "doc_id", "score")
    return best.join(prototypes.select("doc_id", "category"), "doc_id").select("query_id", "category", "score")


def with_default(category: Column, score: Column, threshold: float, default) -> Column:
    return F.when(score < threshold, F.lit(default)).otherwise(category)


def classify_nearest(queries: DataFrame, prototypes: DataFrame, threshold: float = 0.65,
                     default="DOCUMENT_QUERY") -> DataFrame:
    """Nearest example; below the threshold the default category keeps the score."""
    return nearest_example(queries, prototypes).withColumn(
        "category", with_default(F.col("category"), F.col("score"), threshold, default))


# Prefixes that mean a search without asking the vectors.
SEARCH_PREFIXES = ["find ", "search ", "locate "]


def classify_zero_shot(queries: DataFrame, descriptions: DataFrame, threshold: float = 0.65,
                       search="DOCUMENT_SEARCH", default="DOCUMENT_QUERY") -> DataFrame:
    """Search prefixes are decided by rule; only the other queries meet the vectors."""
    by_rule = tx.starts_with_any(F.lower("text"), SEARCH_PREFIXES)
    ruled = queries.filter(by_rule).select("query_id", F.lit(search).alias("category"), F.lit(0.95).alias("score"))
    return ruled.unionByName(classify_nearest(queries.filter(~by_rule), descriptions, threshold, default))


def classify_centroid(queries: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Category with the most similar mean vector: ``(query_id, category, score)``."""
    means = centroids(prototypes).withColumn(
        "doc_id", F.row_number().over(Window.orderBy("category")).cast("bigint"))
    best = vector_topk(queries, means, 1)
    return best.join(means.select("doc_id", "category"), "doc_id").select("query_id", "category", "score")


def centroid_or_length(category: Column, score: Column, query: Column, threshold: float = 0.75) -> tuple[Column, Column]:
    """Weak centroid matches fall back on length: up to three words is conversation."""
    weak = score < threshold
    guess = F.when(tx.word_count(query) <= 3, F.lit("CONVERSATION")).otherwise(F.lit("DOCUMENT_QUERY"))
    return F.when(weak, guess).otherwise(category), F.when(weak, F.lit(0.6)).otherwise(score)

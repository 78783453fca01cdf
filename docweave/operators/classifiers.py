"""Classifiers by name, on the seed examples and descriptions or on learned ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import intent
from docweave.functions.vectors import hashed_embedding
from docweave.operators import intents, prototypes
from docweave.operators.tables import written

# Names a classifier can be asked for, and what they stand for.
NAMES = {
    "pattern": "pattern", "regex": "pattern",
    "embedding": "embedding", "embeddings": "embedding", "neural": "embedding",
    "ensemble": "ensemble", "hybrid": "ensemble",
    "zero-shot": "zero-shot",
}
THRESHOLD = 0.65


def seed_prototypes(spark: SparkSession, seeds: dict[str, list[str]], embedder=None) -> DataFrame:
    """The fixed seed texts, embedded: ``(doc_id, category, text, embedding)``."""
    rows = [(i, c, t) for i, (c, t) in enumerate((c, t) for c, ts in seeds.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, category string, text string")
    return df.withColumn("embedding", (embedder or hashed_embedding())("text"))


def classify(queries: DataFrame, name: str, embedder=None, examples: DataFrame | None = None,
             descriptions: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(query_id, category, confidence)`` of ``queries(query_id, text)``; unknown names mean "embedding"."""
    kind = NAMES.get(name, "embedding")
    if kind == "pattern":
        return intents.classify_pattern(queries).drop("text")
    spark = queries.sparkSession
    embedded = written(queries.select("query_id", "text").withColumn("embedding", (embedder or hashed_embedding())("text")))
    if kind == "zero-shot":
        known = seed_prototypes(spark, intent.SEED_DESCRIPTIONS, embedder) if descriptions is None else descriptions
        return prototypes.classify_zero_shot(embedded, known, threshold).withColumnRenamed("score", "confidence")
    known = seed_prototypes(spark, intent.SEED_EXAMPLES, embedder) if examples is None else examples
    votes = prototypes.classify_nearest(embedded, known, threshold)
    if kind == "embedding":
        return votes.withColumnRenamed("score", "confidence")
    return intents.classify_ensemble(queries, votes).select("query_id", "category", F.col("confidence"))

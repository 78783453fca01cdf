"""From raw documents to token ids: quality, lines, near duplicates, benchmark passages, pieces.

Each stage takes all rows that the one before kept, as written Parquet. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import chosen_path, decontaminate, lattice_pieces, line_templates, weak_labels
from docweave.operators.tables import written
from docweave.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer of weak labels takes for good and not toxic; the others go."""
    return weak_labels.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur; ``n_chars`` follows the text."""
    out = line_templates.cleaned(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (shingles of five words, similarity 0.8)."""
    return chosen_path.distinct_documents(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages that make up a twentieth of their words."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document that is left."""
    pieces = lattice_pieces.encode(docs.select("doc_id", "text"), check=True)
    return pieces.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), "piece_ids", "lossless")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]

#: The classifier learns and the segmentation is drawn: SQL cannot tell these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

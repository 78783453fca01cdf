"""Keeping a chunk table in step with a changing corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doc_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(doc_id, change)`` with change new, modified or deleted; only digests are shuffled."""
    o = old.select("doc_id", F.md5("text").alias("old_key"))
    n = new.select("doc_id", F.md5("text").alias("new_key"))
    change = (
        F.when(F.col("old_key").isNull(), "new")
        .when(F.col("new_key").isNull(), "deleted")
        .when(F.col("old_key") != F.col("new_key"), "modified")
    )
    return o.join(n, "doc_id", "full_outer").select("doc_id", change.alias("change")).filter("change is not null")


def merge_chunks(chunks: DataFrame, new: DataFrame, changes: DataFrame,
                 chunker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunks after the changes: those of changed documents replaced, of deleted ones gone."""
    kept = chunks.join(changes.select("doc_id"), "doc_id", "left_anti")
    fresh = chunker(new.join(changes.filter("change <> 'deleted'"), "doc_id", "left_semi"))
    return kept.unionByName(fresh)


def needs(force: bool, store_exists: bool, any_change: bool) -> str:
    """What a refresh has to do."""
    if force or not store_exists:
        return "rebuild"
    return "incremental" if any_change else "load"

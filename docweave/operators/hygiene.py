"""Placeholder, duplicate and oversize checks on ``documents(doc_id, text)``."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators.setsim import jaccard_groups, set_groups, similar_sets
from docweave.operators.tables import written

# Limits of the checks and the marks dropped before texts are compared.
MIN_CHARS = 20
NEAR_DUPLICATE = 0.85
LARGE_BYTES = 30000
MARKS = r"(?s)#+ |```.*?```|\*\*|\*|__|\[.*?\]\(.*?\)"

#: Items of a group of documents that one task decides.
IN_TASK = 4_000_000


def is_placeholder(text: Column) -> Column:
    return F.length(tx.strip(text)) < MIN_CHARS


def is_large(text: Column) -> Column:
    return F.octet_length(text) > LARGE_BYTES


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Texts that occur more than once: lowest id and number of copies."""
    return (
        docs.groupBy(F.md5("text").alias("text_key"))
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def word_sets(docs: DataFrame) -> DataFrame:
    cleaned = F.regexp_replace("text", MARKS, "")
    return docs.select(F.col("doc_id").alias("id"), F.array_distinct(tx.words(cleaned)).alias("items"))


def near_duplicates(docs: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Pairs of near-equal documents, factored over equal word sets."""
    return similar_sets(word_sets(docs), threshold, strict=True)


def near_duplicate_groups(docs: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """``(group_id, doc_id)``: all documents that likenesses join with others, under the lowest id of their group.

    One row per document, however many of a group are alike.
    """
    reps, same = set_groups(word_sets(docs))
    groups = jaccard_groups(reps, threshold, strict=True)
    same = same.join(groups.toDF("id_a", "group"), "id_a", "left").select(
        F.coalesce("group", "id_a").alias("group_id"), "id_a", F.col("id_b").alias("doc_id"))
    named = groups.select(F.col("group").alias("group_id"), F.col("id").alias("doc_id"))
    return named.unionByName(same.select("group_id", "doc_id")).unionByName(same.select("group_id", F.col("id_a").alias("doc_id"))).distinct()


def _kept_in_order(group: pa.Table, threshold: float) -> pa.Table:
    """Ids of a group that are not like a kept lower one; a kept set is met through its items."""
    group = group.sort_by("id")
    items = group.column("items").combine_chunks()
    begin = items.offsets.to_numpy() - items.offsets[0].as_py()
    code = items.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    holders: list[list[int]] = [[] for _ in range(int(code.max(initial=-1)) + 1)]
    kept, sizes = [], []
    for row in range(len(group)):
        own = code[begin[row]:begin[row + 1]].tolist()
        common = Counter(h for c in own for h in holders[c])
        if all(n / (len(own) + sizes[h] - n) <= threshold for h, n in common.items()):
            for c in own:
                holders[c].append(len(kept))
            kept.append(row)
            sizes.append(len(own))
    return pa.table({"id": group.column("id").combine_chunks().take(pa.array(kept, pa.int64()))})


def drop_duplicates(docs: DataFrame, threshold: float = NEAR_DUPLICATE, in_task: int = IN_TASK) -> DataFrame:
    """Documents without an equal or near-equal kept one of lower id.

    Ids are decided in order: in a chain of likenesses a document stays if all lower ones that are
    like it go themselves. Documents of different groups cannot be alike, so each group is decided
    for itself. One with up to ``in_task`` items is decided in one task; in a larger one the lowest open id stays, which removes
    all that are like it, until what is open fits.
    """
    reps, same = set_groups(word_sets(docs))
    lost = same.select(F.col("id_b").alias("doc_id"))
    held = written(reps.select("id", "n", "items").join(jaccard_groups(reps, threshold, strict=True), "id"))
    grouped, kept = held.select("id"), None
    while True:
        sizes = held.groupBy("group").agg(F.sum("n").alias("all_items"), F.min("id").alias("first"))
        large = written(sizes.filter(F.col("all_items") > in_task))
        fits = held.join(large, "group", "left_anti").groupBy("group").applyInArrow(
            lambda t: _kept_in_order(t, threshold), f"id {held.schema['id'].dataType.simpleString()}")
        kept = written(fits) if kept is None else kept.unionByName(written(fits))
        if large.isEmpty():
            break
        firsts = large.join(held.select(F.col("id").alias("first"), F.col("items").alias("first_items")), "first").select(
            "group", "first", "first_items")
        kept = kept.unionByName(firsts.select(F.col("first").alias("id")))
        alike = F.size(F.array_intersect("items", "first_items")) / F.size(F.array_union("items", "first_items")) > threshold
        held = written(held.join(firsts, "group").filter((F.col("id") != F.col("first")) & ~alike).select(held.columns))
    lost = lost.unionByName(grouped.join(kept, "id", "left_anti").select(F.col("id").alias("doc_id")))
    lost = lost.distinct()
    # texts without any word have no word set; equal ones still are duplicates
    wordless = docs.filter(tx.word_count(F.regexp_replace("text", MARKS, "")) == 0)
    kept = wordless.groupBy(F.md5("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    extra = wordless.select("doc_id").join(kept, "doc_id", "left_anti")
    return docs.join(lost.unionByName(extra), "doc_id", "left_anti")


def hygiene_summary(docs: DataFrame) -> DataFrame:
    """One row: placeholders, surplus copies, large documents."""
    flags = docs.agg(
        F.count("*").alias("documents"),
        F.count_if(is_placeholder(F.col("text"))).alias("placeholders"),
        F.count_if(is_large(F.col("text"))).alias("large"),
    )
    copies = exact_duplicates(docs).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus_copies"))
    return flags.withColumn("surplus_copies", copies.scalar())

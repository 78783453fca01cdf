"""Dropping recurring lines by log templates, in DataFrame functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, with
runs of digits as a variable field. The leaf is the line's template: the first half of the tokens
(six at least, all of a shorter line) are constant, those behind are variable.

A template recurs if it stands in at least ``min_docs`` different texts. Equal texts count once, so
copies of a document do not make its lines recurring, whereas boilerplate, put into different texts, counts each time.
With ``surroundings`` it recurs instead if at least ``min_docs`` documents are the first to bring it between some
pair of neighbours (the templates of the lines before and after).
Recurring lines are dropped from all documents but the first that has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.skew import hot_keys, salted_join
from docweave.operators.tables import written

MIN_DOCS = 10
LEAST = 6


def template(line: Column) -> Column:
    """The template of a line as one string; empty for a blank line."""
    tokens = F.filter(F.split(F.regexp_replace(line, "[0-9]+", "<*>"), r"[ \t\r]+"), lambda t: t != "")
    return F.element_at(F.transform(F.array(tokens), _leaf), 1)


def _leaf(tokens: Column) -> Column:
    n = F.size(tokens)
    lead = F.greatest(F.ceil(n / 2).cast("int"), F.least(n, F.lit(LEAST)))
    return F.when(n == 0, "").otherwise(F.concat_ws(" ", n.cast("string"), F.array_join(F.slice(tokens, F.lit(1), lead), " ")))


def _around(leaves: Column) -> Column:
    """A hash of the templates before and after each line; there is a blank line before the first and after the last."""
    blank = F.array(F.xxhash64(F.lit("")))
    return F.zip_with(F.concat(blank, leaves), F.concat(F.slice(leaves, F.lit(2), F.size(leaves)), blank), lambda a, b: F.xxhash64(a, b))


def _placed(documents: DataFrame, key: str, text: str, surroundings: bool = False) -> DataFrame:
    """``(doc, mark, at, leaf)``: every line that is not blank, with hashes of its text and template; ``around`` if asked."""
    leaves = documents.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("mark"),
        F.transform(F.split(text, "\n"), lambda x: F.xxhash64(template(x))).alias("leaves"))
    # outer: else a filter on the size of the array goes below the explode and makes every template twice
    if surroundings:
        both = F.zip_with("leaves", _around(F.col("leaves")), lambda leaf, around: F.struct(leaf.alias("leaf"), around.alias("around")))
        lines = leaves.select("doc", "mark", F.posexplode_outer(both).alias("at", "e")).select("doc", "mark", "at", "e.leaf", "e.around")
    else:
        lines = leaves.select("doc", "mark", F.posexplode_outer("leaves").alias("at", "leaf"))
    return lines.filter(F.col("leaf").isNotNull() & (F.col("leaf") != F.xxhash64(F.lit(""))))


def recurring(documents: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
              surroundings: bool = False) -> DataFrame:
    """``(leaf, keeper, n)``: hashes of recurring templates, the smallest key of a document with each, and its lines."""
    if surroundings:
        new = _placed(documents, key, text, True).groupBy("leaf", "around").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
        return new.groupBy("leaf", "doc").agg(F.sum("n").alias("n")).groupBy("leaf").agg(
            F.count("*").alias("docs"), F.min("doc").alias("keeper"), F.sum("n").alias("n")).filter(
            F.col("docs") >= min_docs).select("leaf", "keeper", "n")
    different = _placed(documents, key, text).groupBy("leaf", "mark").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    return different.groupBy("leaf").agg(F.count("*").alias("texts"), F.min("doc").alias("keeper"), F.sum("n").alias("n")).filter(
        F.col("texts") >= min_docs).select("leaf", "keeper", "n")


def drop_recurring(documents: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                   surroundings: bool = False) -> DataFrame:
    """``documents`` without recurring lines, and ``n_lines`` and ``n_dropped`` per document.

    Blank lines are never dropped. A null text stays null with no lines; an empty one has one
    blank line. A text that loses all its lines becomes empty, its row stays. Rows without a key
    are neither counted nor changed. Rows with the same key and text are treated alike and count as one
    document. Extra columns pass through; those with the name of an added one are replaced.
    """
    found = written(recurring(documents, key, text, min_docs, surroundings))
    hot = hot_keys(found.select("leaf", "n"), "leaf")
    gone = (
        salted_join(_placed(documents, key, text), found.drop("n"), "leaf", hot, spread="doc").filter("doc <> keeper")
        .groupBy("doc", "mark").agg(F.collect_set("at").alias("_gone"))
        .withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    )
    rows = documents.withColumn("_own_mark", F.xxhash64(text))
    joined = rows.join(gone, (rows[key] == gone["_doc"]) & (rows["_own_mark"] == gone["_mark"]), "left")
    lines = F.split(text, "\n")
    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(
        F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("_gone", i)), "\n"))
    out = joined.withColumns({
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint"),
        "n_dropped": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("bigint"), text: kept})
    return out.drop("_own_mark", "_doc", "_mark", "_gone")


def cleaned(documents: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``documents`` without recurring lines, with their own columns, whatever these are called."""
    clash = {c: f"_kept_{c}" for c in documents.columns if c in ("n_lines", "n_dropped")}
    out = drop_recurring(documents.withColumnsRenamed(clash), key, text, min_docs)
    return out.select(*(F.col(clash.get(c, c)).alias(c) for c in documents.columns))

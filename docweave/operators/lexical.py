"""Inverted index and exact BM25 retrieval for a whole batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators.postings import (
    DOCUMENT, SHARD_DOCS, Postings, Store, blocked, every_pair, grouped, inverse_frequency, many, saturation, scan, search, shard_count, shard_of,
)
from docweave.operators.skew import hot_keys, salted_join
from docweave.operators.tables import written
from docweave.sources.tables import exists

K1 = 1.5
B = 0.75

#: Characters of text that make a posting at most once; for the number of shards.
CHARS_PER_POSTING = 4


@dataclass(frozen=True)
class LexicalIndex:
    """``rows(doc_id, dl, term, tf)``: one per document and term, and one per document.

    The document row carries the length of documents whose terms are not indexed, so
    collection statistics need no second pass over the texts.
    """

    rows: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.rows.filter(F.col("term") != DOCUMENT)

    @property
    def terms(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def stats(self) -> DataFrame:
        return self.rows.filter(F.col("term") == DOCUMENT).agg(
            F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))

    def write(self, path: str, partitions: int = 64) -> None:
        """Persist sorted by term, so that looking up terms skips most row groups."""
        (self.rows.repartitionByRange(partitions, "term", "doc_id").sortWithinPartitions("term", "doc_id")
         .write.mode("overwrite").parquet(path))

    @staticmethod
    def read(spark: SparkSession, path: str) -> "LexicalIndex":
        return LexicalIndex(spark.read.parquet(path))


def doc_tokens(corpus: DataFrame) -> DataFrame:
    """One row per token of ``corpus(doc_id, text)`` and one per document with tokens."""
    toks = corpus.select("doc_id", tx.tokens(F.col("text")).alias("toks"))
    # no filter on the tokens: it would move below and tokenize every text twice
    listed = F.when(F.size("toks") > 0, F.array_append("toks", F.lit(DOCUMENT))).otherwise(F.array().cast("array<string>"))
    return toks.select("doc_id", F.size("toks").cast("bigint").alias("dl"), F.explode(listed).alias("term"))


def build_index(corpus: DataFrame, only_terms: DataFrame | None = None) -> LexicalIndex:
    """Index ``corpus(doc_id, text)``; documents without tokens are skipped.

    With ``only_terms(term)`` all other postings are dropped before the shuffle. Without, texts are shuffled by document, which are
    smaller than their postings.
    """
    rows = doc_tokens(corpus if only_terms is not None else corpus.select("doc_id", "text").repartition("doc_id"))
    if only_terms is not None:
        wanted = only_terms.unionByName(only_terms.limit(1).select(F.lit(DOCUMENT).alias("term")))
        rows = rows.join(wanted, "term", "left_semi")
    # tokens are counted inside the task that has the document
    return LexicalIndex(rows.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")))


def term_lists(corpus: DataFrame) -> DataFrame:
    """``(doc_id, terms, tfs, dls)``: a row per document; texts are shuffled once, by document."""
    entry = F.struct("term", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
    return build_index(corpus).rows.groupBy("doc_id").agg(F.collect_list(entry).alias("e")).select(
        "doc_id", F.col("e.term").alias("terms"), F.col("e.tf").alias("tfs"), F.col("e.dl").alias("dls"))


def extend_index(index: LexicalIndex, new_docs: DataFrame) -> LexicalIndex:
    """Add documents whose id is not indexed yet; statistics re-aggregate from the rows."""
    known = index.rows.filter(F.col("term") == DOCUMENT).select("doc_id")
    fresh = build_index(new_docs.join(known, "doc_id", "left_anti"))
    return LexicalIndex(index.rows.unionByName(fresh.rows))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf)``; a repeated query token counts each time."""
    return (
        queries.select("query_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def _idf(stats: Row):
    return inverse_frequency(F.col("df"), stats.n_docs)


def _saturation(stats: Row, k1: float, b: float):
    return saturation(F.col("tf"), F.col("dl"), stats.n_tokens / max(stats.n_docs, 1), k1, b)


def bm25_pairs(pairs: DataFrame, queries: DataFrame, corpus: DataFrame,
               k1: float = K1, b: float = B) -> DataFrame:
    """Score given ``pairs(query_id, doc_id)``; pairs sharing no term score 0."""
    qt = written(query_terms(queries))
    index = LexicalIndex(written(build_index(corpus, qt.select("term").distinct()).rows))
    stats = index.stats.first()
    weights = qt.join(index.terms, "term").select(
        "query_id", "term", (F.col("qtf") * _idf(stats)).alias("w"))
    hits = (
        index.postings.select("doc_id", "term", _saturation(stats, k1, b).alias("g"))
        .join(pairs, "doc_id")
        .join(weights, ["query_id", "term"])
        .select("query_id", "doc_id", (F.col("w") * F.col("g")).alias("s"))
    )
    return (
        hits.unionByName(pairs.select("query_id", "doc_id", F.lit(0.0).alias("s")))
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum("s"), 6).alias("score"))
    )


def _ranked(top: DataFrame) -> DataFrame:
    best_score = F.max("score").over(Window.partitionBy("query_id"))
    return top.withColumn(
        "rel_score", F.round(F.when(best_score > 0, F.col("score") / best_score).otherwise(0.0), 6)
    ).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "score", "rel_score")


def bm25_topk(queries: DataFrame, corpus: DataFrame | None, k: int = 4,
              index: LexicalIndex | None = None, k1: float = K1, b: float = B, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Exact BM25 top-k of every query: ``(query_id, doc_id, rank, score, rel_score)``.

    Postings of the queries' terms are laid in blocks; blocks whose bounds cannot bring a document into the top k are
    not scored. With more queries than one set, documents are scanned with their terms instead, a large set of queries at a time.
    """
    qt = written(query_terms(queries))
    if index is None and many(qt):
        return _ranked(scan(qt, written(term_lists(corpus)), k, k1, b, shard_docs))
    wanted = qt.select("term").distinct()
    if index is None:
        rows = build_index(corpus, wanted).rows
        n_docs, chars = corpus.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        n_rows = chars // CHARS_PER_POSTING
    else:
        rows = index.rows.join(
            wanted.unionByName(wanted.limit(1).select(F.lit(DOCUMENT).alias("term"))), "term", "left_semi")
        n_docs, n_rows = index.stats.first()[0], rows.count()
    # the rows that stand for documents make blocks too: one table has postings and statistics
    every = written(blocked(rows, n_docs, n_rows, shard_docs=shard_docs)[0])
    sizes = every.filter(F.col("term") == DOCUMENT).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.aggregate("dls", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()
    blocks = every.filter(F.col("term") != DOCUMENT)
    return _ranked(search(qt, Postings(blocks, *sizes), k, k1, b))


def store_index(corpus: DataFrame, path: str, shard_docs: int = SHARD_DOCS) -> Store:
    """Write an index of ``corpus(doc_id, text)`` to ``path``, or add the documents that the one there does not know."""
    spark = corpus.sparkSession
    store = Store(spark, path)
    texts, chars = corpus.select("doc_id", "text"), corpus.select("doc_id", F.length("text").alias("chars"))
    first = 0
    if exists(spark, f"{path}/sizes"):
        first, known = store.next_shard(), store.lengths().select("doc_id")
        texts, chars = (x.join(known, "doc_id", "left_anti") for x in (texts, chars))
    n_docs, n_chars = chars.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    if not n_docs:
        return store
    shards = shard_count(n_docs, n_chars // CHARS_PER_POSTING, shard_docs)
    # texts are sent once, by shard; their postings are counted and grouped in the task that has the shard
    toks = texts.withColumn("shard", shard_of(shards, first)).repartition(2 * shards, "shard").select(
        "shard", "doc_id", tx.tokens(F.col("text")).alias("toks"))
    listed = F.when(F.size("toks") > 0, F.array_append("toks", F.lit(DOCUMENT))).otherwise(F.array().cast("array<string>"))
    terms = toks.select("shard", "doc_id", F.size("toks").cast("bigint").alias("dl"), F.explode(listed).alias("term"))
    store.add(grouped(terms.groupBy("shard", "doc_id", "dl", "term").agg(F.count("*").alias("tf"))), first, shards)
    return store


def search_store(queries: DataFrame, store: Store, k: int = 4, k1: float = K1, b: float = B) -> DataFrame:
    """As ``bm25_topk``, over a stored index: texts are not read, only the blocks of the queries' terms."""
    qt = written(query_terms(queries))
    return _ranked(search(qt, store.postings(qt), k, k1, b))


def bm25_all(queries: DataFrame, corpus: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, doc_id, score)`` of every pair that shares a term; scores add up in the task that holds a shard of the documents."""
    qt = written(query_terms(queries))
    index = LexicalIndex(written(build_index(corpus, qt.select("term").distinct()).rows))
    stats = index.stats.first()
    terms = written(index.terms)
    w = qt.join(terms, "term").select("query_id", "term", (F.col("qtf") * _idf(stats)).alias("w"))
    g = index.postings.select("doc_id", "term", _saturation(stats, k1, b).alias("g"))
    n_rows = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return every_pair(w, g, stats.n_docs, n_rows).withColumn("score", F.round("score", 6))


def weighted_embeddings(corpus: DataFrame, dim: int = 64) -> DataFrame:
    """``(doc_id, embedding)``: terms hashed into ``dim`` buckets, weighted by rarity, unit length.

    Made from postings in the JVM: a term's bucket and weight are found once for the whole corpus. Documents without
    tokens have the zero vector; rows of one id are one document.
    """
    index = LexicalIndex(written(build_index(corpus).rows))
    stats = index.stats.first()
    bucket = (F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("int") % dim).alias("bucket")
    terms = written(index.terms.select("term", "df", bucket, _idf(stats).alias("idf")))
    hot = hot_keys(terms.select("term", F.col("df").alias("n")), "term")
    sums = salted_join(index.postings, terms.drop("df"), "term", hot, spread="doc_id").groupBy("doc_id", "bucket").agg(
        F.sum(F.col("tf") * F.col("idf")).alias("x"))
    held = sums.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.try_element_at("m", b) / F.col("norm"), F.lit(0.0)))
    return corpus.select("doc_id").distinct().join(held, "doc_id", "left").select("doc_id", vector.alias("embedding"))


def domain_terms(corpus: DataFrame, group: str, n: int) -> DataFrame:
    """Top ``n`` TF-IDF terms of every group: ``(group, term, tf, df, weight, rank)``."""
    owner = corpus.select("doc_id", group)
    index = LexicalIndex(written(build_index(corpus.select("doc_id", "text")).rows))
    tf = index.postings.join(owner, "doc_id").groupBy(group, "term").agg(F.sum("tf").alias("tf"))
    scored = tf.join(index.terms, "term").select(
        group, "term", "tf", "df", F.round(F.col("tf") * _idf(index.stats.first()), 6).alias("weight"))
    w = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)

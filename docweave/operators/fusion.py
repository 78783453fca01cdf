"""Fusion of dense and lexical rankings, reranking, and the search entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import scores
from docweave.functions import text as tx
from docweave.operators.lexical import LexicalIndex, bm25_topk
from docweave.operators.tables import written
from docweave.operators.vector import vector_topk

RRF_K = 60
WEIGHTS = (0.7, 0.3)
THRESHOLD = 0.25
FETCH_K = 20


def merged(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Both rankings side by side. Lexical hits score by rank; dense hits keep a normalized score."""
    d = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"),
                     scores.normalize_score(F.col("score")).alias("dense_score"))
    x = lexical.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"),
                       scores.rank_score(F.col("rank")).alias("bm25_score"))
    return d.join(x, ["query_id", "doc_id"], "full_outer").fillna(0.0, ["dense_score", "bm25_score"])


def fuse(dense: DataFrame, lexical: DataFrame, k: int, method: str = "rrf",
         weights: tuple[float, float] = WEIGHTS, rrf_k: int = RRF_K) -> DataFrame:
    """Top ``k`` per query of the merged rankings: ``(query_id, doc_id, rank, score, rrf)``.

    ``score`` is the weighted raw score; ``rrf`` orders the result for method "rrf".
    """
    wd, wx = (w / sum(weights) for w in weights)
    part = lambda w, r: F.coalesce(F.lit(w) / (F.col(r) + rrf_k), F.lit(0.0))
    both = merged(dense, lexical).select(
        "query_id", "doc_id",
        F.round(wd * F.col("dense_score") + wx * F.col("bm25_score"), 7).alias("score"),
        F.round(part(wd, "dense_rank") + part(wx, "bm25_rank"), 9).alias("rrf"),
    )
    order = [F.desc("rrf"), F.desc("score"), "doc_id"] if method == "rrf" else [F.desc("score"), "doc_id"]
    w = Window.partitionBy("query_id").orderBy(*order)
    return both.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def search(queries: DataFrame, corpus: DataFrame, k: int = 4, fetch_k: int = FETCH_K,
           threshold: float = THRESHOLD, method: str = "rrf", index: LexicalIndex | None = None) -> DataFrame:
    """Hybrid retrieval of ``queries(query_id, text, embedding)`` over ``corpus(doc_id, text, embedding)``.

    The threshold applies after the cut to k, so a query may get fewer than k documents.
    """
    vectors = written(corpus.select("doc_id", "embedding"))  # counted and scanned: embed once
    dense = vector_topk(written(queries.select("query_id", "embedding")), vectors, fetch_k)
    lexical = bm25_topk(queries.select("query_id", "text"), corpus.select("doc_id", "text"), fetch_k, index)
    return fuse(dense, lexical, k, method).filter(F.col("score") >= threshold)


def coverage(query: Column, text: Column) -> Column:
    """Default pair score: share of distinct query terms that occur in the text."""
    q = F.array_distinct(tx.tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(
        F.size(F.array_intersect(q, F.array_distinct(tx.tokens(text)))) / F.size(q))


def rerank(candidates: DataFrame, top_n: int,
           pair_score: Callable[[Column, Column], Column] = coverage) -> DataFrame:
    """Reorder ``candidates(query_id, doc_id, query, text, score)`` by a pair score.

    ``pair_score`` is a column function or a pandas UDF over (query, text). The order
    is by pair score alone; the reported score blends in the former one.
    """
    pair = F.round(scores.minmax_per_query(F.col("raw"), "query_id"), 6)
    w = Window.partitionBy("query_id").orderBy(F.desc("pair_score"), "doc_id")
    return (
        candidates.withColumn("raw", pair_score(F.col("query"), F.col("text")).cast("double"))
        .withColumn("pair_score", pair)
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
        .filter(F.col("rank") <= top_n)
        .select("query_id", "doc_id", "rank", "pair_score",
                F.round(0.7 * F.col("pair_score") + 0.3 * F.col("score"), 7).alias("score"))
    )


def with_texts(hits: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Texts come back only for the hits, after the top-k.

    The hits are written first: their size is then known, and where they are few the
    corpus is filtered by a broadcast instead of being shuffled.
    """
    return written(hits).join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(
        corpus.select("doc_id", "text"), "doc_id")


def retrieve_rerank(queries: DataFrame, corpus: DataFrame, k: int = 4, fetch_k: int = FETCH_K,
                    pair_score: Callable[[Column, Column], Column] = coverage) -> DataFrame:
    """Lexical retrieval of ``fetch_k`` documents, reranked to ``k``."""
    hits = bm25_topk(queries, corpus, fetch_k).select("query_id", "doc_id", F.col("rel_score").alias("score"))
    return rerank(with_texts(hits, queries, corpus), k, pair_score)

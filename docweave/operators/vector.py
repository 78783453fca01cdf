"""Exact nearest-neighbour search over array columns.

All pairs must be compared, but never leave the task that compares them: a task
multiplies one block of vectors with another and passes on only its best k per
query. The smaller side is broadcast when its counted size is under a bound; when
both sides are larger, hash-defined blocks of both meet in a grid of groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
BLOCK_CELLS = 4_000_000
GRID_ROWS = 20_000
#: Bytes of a block of the grid, and entries of which only the greatest is looked at first.
GRID_BYTES = 16 << 20
WIDTH = 64
SLACK = 1e-5  # similarities are compared at six digits
SCHEMA = "query_id bigint, doc_id bigint, score double"


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _keep_best(rows, ids, sims, k):
    """Best ``k`` entries of every row by similarity, then id."""
    order = np.lexsort((ids, -sims, rows))
    rows, ids, sims = rows[order], ids[order], sims[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.array([], int)
    first = np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], sims[keep]


class Block(NamedTuple):
    ids: np.ndarray
    unit: np.ndarray
    group: np.ndarray | None


def _floor(sims: np.ndarray, k: int) -> np.ndarray:
    """A value for each row that at least ``k`` of its entries reach: the k-th of the maxima of groups of entries."""
    n = sims.shape[1]
    if n <= k:
        return np.full(len(sims), -np.inf)
    width = max(1, min(WIDTH, n // (4 * k)))
    most = sims[:, :n // width * width].reshape(len(sims), width, -1).max(axis=1)
    if np.isnan(most).any():
        most = sims
    return np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] if k > 1 else most.max(axis=1)


def _compare(q: Block, d: Block, k: int):
    """Best ``k`` of ``d`` for every row of ``q``, in slices of bounded size.

    Where blocks carry groups, only vectors of the same group are compared.
    """
    if q.group is not None:
        parts = []
        for value in np.intersect1d(q.group, d.group):
            own, other = np.flatnonzero(q.group == value), np.flatnonzero(d.group == value)
            rows, ids, sims = _compare(Block(q.ids[own], q.unit[own], None), Block(d.ids[other], d.unit[other], None), k)
            parts.append((own[rows], ids, sims))
        parts.append((np.empty(0, np.int64), d.ids[:0], np.empty(0)))
        return tuple(np.concatenate(p) for p in zip(*parts))
    parts = []
    n = len(d.ids)
    step = max(1, BLOCK_CELLS // max(1, n))
    for at in range(0, len(q.ids), step):
        sims = q.unit[at:at + step] @ d.unit.T
        floor = _floor(sims, k)
        r, c = np.nonzero(sims >= floor[:, None] - SLACK)
        parts.append(_keep_best(r + at, d.ids[c], np.round(sims[r, c], 6) + 0.0, k))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _arrow_block(batch: pa.RecordBatch, dim: int) -> Block:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    group = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
    return Block(ids, _unit(flat.astype(np.float64).reshape(len(ids), dim)), group)


def _pandas_block(pdf: pd.DataFrame, grouped: bool) -> Block:
    m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    return Block(pdf.iloc[:, 0].to_numpy(), _unit(m), pdf["_group"].to_numpy() if grouped else None)


def _out(qids, dids, sims) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qids, pa.int64()), pa.array(dids, pa.int64()), pa.array(sims, pa.float64())],
        names=["query_id", "doc_id", "score"],
    )


def _shared_block(df: DataFrame, dim: int):
    """Broadcast a side whose counted size is under the bound."""
    block = _arrow_block(df.toArrow().combine_chunks().to_batches()[0], dim)
    return df.sparkSession.sparkContext.broadcast(block)


def _scan_corpus(queries: DataFrame, corpus: DataFrame, k: int, dim: int) -> DataFrame:
    """Queries broadcast; each corpus task keeps a running best k per query."""
    shared = _shared_block(queries, dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = shared.value, None
        for batch in batches:
            if batch.num_rows:
                new = _compare(q, _arrow_block(batch, dim), k)
                best = new if best is None else _keep_best(
                    *(np.concatenate(p) for p in zip(best, new)), k)
        if best is not None:
            yield _out(q.ids[best[0]], best[1], best[2])

    return corpus.mapInArrow(scan, SCHEMA)


def _scan_queries(queries: DataFrame, corpus: DataFrame, k: int, dim: int) -> DataFrame:
    """Corpus broadcast; each query row is answered where it lies."""
    shared = _shared_block(corpus, dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _arrow_block(batch, dim)
                r, i, s = _compare(q, shared.value, k)
                yield _out(q.ids[r], i, s)

    return queries.mapInArrow(scan, SCHEMA)


def grid_blocks(n_q: int, n_d: int, rows: int, dim: int, cores: int) -> tuple[int, int]:
    """Blocks of both sides of a grid, of about ``rows`` rows at least.

    Each side is copied once a block of the other, so blocks grow with the tables up to ``GRID_BYTES``, as long as there are groups
    enough for all cores.
    """
    side, largest = math.ceil((4 * cores) ** 0.5), max(rows, GRID_BYTES // (8 * max(1, dim)))
    return tuple(min(-(-n // rows), max(side, -(-n // largest))) for n in (n_q, n_d))


def _grid(queries: DataFrame, corpus: DataFrame, k: int, n_q: int, n_d: int, rows: int, dim: int) -> DataFrame:
    """Both sides in hash blocks; one group per pair of blocks."""
    bq, bd = grid_blocks(n_q, n_d, rows, dim, corpus.sparkSession.sparkContext.defaultParallelism)
    grouped = "_group" in corpus.columns

    def blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        )

    left = blocks(queries, "bq", bq, "bd", bd).groupBy("bq", "bd")
    right = blocks(corpus, "bd", bd, "bq", bq).groupBy("bq", "bd")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        q = _pandas_block(a, grouped)
        r, i, s = _compare(q, _pandas_block(b, grouped), k)
        return pd.DataFrame({"query_id": q.ids[r], "doc_id": i, "score": s})

    return left.cogroup(right).applyInPandas(meet, SCHEMA)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, within: str | None = None,
                broadcast_bytes: int = BROADCAST_BYTES, grid_rows: int = GRID_ROWS) -> DataFrame:
    """Exact cosine top-k: ``queries(query_id, embedding)`` over ``corpus(doc_id, embedding)``.

    Similarities are compared at six digits, ties go to the lower id. With ``within``,
    a query only meets documents of the same value in that column.
    """
    group = [F.xxhash64(within).alias("_group")] if within else []
    queries = queries.filter("embedding is not null").select("query_id", "embedding", *group)
    corpus = corpus.filter("embedding is not null").select("doc_id", "embedding", *group)
    n_d, dim = corpus.agg(F.count("*"), F.max(F.size("embedding"))).first()
    n_q = queries.count()
    if not n_d or not n_q:
        return corpus.sparkSession.createDataFrame([], SCHEMA + ", rank bigint")
    small = min(n_q, n_d) * dim * 8 <= broadcast_bytes
    if small and n_q <= n_d:
        found = _scan_corpus(queries, corpus, k, dim)
    elif small:
        found = _scan_queries(queries, corpus, k, dim)
    else:
        found = _grid(queries, corpus, k, n_q, n_d, grid_rows, dim)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def centroids(prototypes: DataFrame, category: str = "category") -> DataFrame:
    """Mean vector per category; summed map-side, so a large category is no hot spot."""
    return (
        prototypes.select(category, F.posexplode("embedding").alias("pos", "x"))
        .groupBy(category, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(category)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("embedding"))
    )

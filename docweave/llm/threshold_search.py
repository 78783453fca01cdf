"""Exact top-k inner products by Fagin's threshold algorithm over sorted lists per dimension.

Vectors are brought to whole numbers and packed, where they lie, into shards of bounded size. A shard
carries, for each dimension, the list of its rows by falling value. A query walks
the lists of its dimensions side by side, from the top where its own entry is positive and from the
bottom where it is negative. Rows met for the first time are scored in full. The entries
at the depth reached bound the score of every row not met yet; the walk ends as soon as this
bound is below the k-th best score so far.

Queries lie in blocks. Each block meets each cell of a few shards in one group, which passes on its
best k per query; the groups are even by construction, whatever vectors occur how often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docweave.llm.whitening import matrix, whole
from docweave.operators.tables import written

#: Rows of a shard, fewer for very wide vectors; shards of a cell; queries of a block.
ROWS = 4096
BYTES = 16 << 20
CELL = 4
BLOCK = 1024
#: Entries of each list that are read first; the depth then doubles.
FIRST = 8
LONG = (1 << 63) - 1


def _packed(rows: DataFrame, key: str, most: int, lists: bool) -> DataFrame:
    """``(part, n, dim, largest, ids, block[, lists])`` of ``rows(key, x)``: up to ``most`` rows in one."""
    kind = rows.schema[key].dataType
    ids = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            widest = int(np.diff(batch.column(1).offsets.to_numpy()).max(initial=1))
            step = max(1, min(most, BYTES // (8 * max(1, widest))))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                x = matrix(piece.column(1), 1)
                largest = max(int(x.max()), -int(x.min() + 1)) if x.size else 0
                columns = [pa.array([part], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([x.shape[1]], pa.int32()),
                           pa.array([largest], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), piece.column(0).cast(ids)),
                           pa.array([x.tobytes()], pa.binary())]
                if lists:
                    columns.append(pa.array([np.argsort(-x.T, axis=1, kind="stable").astype(np.int32).tobytes()], pa.binary()))
                part += 1
                yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "dim", "largest", "ids", "block", "lists"][:len(columns)])

    return rows.mapInArrow(run, f"part bigint, n bigint, dim int, largest bigint, ids array<{kind.simpleString()}>, block binary"
                           + (", lists binary" if lists else ""))


class Shard:
    """Rows with their sorted lists, in a number type in which all scores are exact."""

    def __init__(self, ids: pa.Array, n: int, dim: int, block: bytes, lists: bytes, kind: type):
        self.ids, self.n, self.dim = ids, n, dim
        self.rows = np.frombuffer(block, np.int64).reshape(n, dim).astype(kind)
        self.lists = np.frombuffer(lists, np.int32).reshape(dim, n)

    def best(self, query: np.ndarray, own: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that may be among the best ``k`` and their scores, and the depth of the walk.

        ``own`` marks rows that take no part; a row below ``floor`` needs not be found.
        """
        q = query[:self.dim]
        used = np.flatnonzero(q) if q.any() else np.arange(1)
        down, up = used[q[used] >= 0], used[q[used] < 0]
        seen = own.copy()
        found, scores, high = [], [], np.zeros(0, self.rows.dtype)
        depth, step = 0, FIRST
        while depth < self.n and not seen.all():
            end = min(self.n, depth + step)
            new = np.zeros(self.n, bool)
            new[self.lists[down, depth:end]] = True
            new[self.lists[up, self.n - end:self.n - depth]] = True
            new &= ~seen
            seen |= new
            new = np.flatnonzero(new)
            score = self.rows[new] @ q
            found.append(new)
            scores.append(score)
            high = np.concatenate([high, score])
            if len(high) > k:
                high = np.sort(high)[len(high) - k:]
            bound = self.rows[self.lists[down, end - 1], down] @ q[down] + self.rows[self.lists[up, self.n - end], up] @ q[up]
            depth, step = end, end
            if (len(high) == k and bound < high.min()) or (floor is not None and bound < floor):
                break
        return np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0, self.rows.dtype), *scores]), depth


def _number(largest_query: int, largest_row: int, dim: int) -> type:
    bound = (largest_query + 1) * (largest_row + 1) * max(1, dim)
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k``: by falling score, then by id, without an id last."""
    if len(scores) > k:
        floor = np.sort(scores)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return np.array(sorted(at, key=lambda i: (-scores[i], ids[i] is None, ids[i]))[:k], np.int64)


def _meet(queries: pa.Table, shards: pa.Table, k: int, kind: type) -> tuple[list, list, list]:
    cell = [Shard(*r, kind) for r in zip(shards.column("ids").combine_chunks(), *(
        shards.column(c).to_pylist() for c in ("n", "dim", "block", "lists")))]
    names = [np.array(s.ids.as_py() + [None], object)[:-1] for s in cell]
    out: tuple[list, list, list] = ([], [], [])
    for own_ids, n, dim, block in zip(*(queries.column(c).to_pylist() for c in ("ids", "n", "dim", "block"))):
        wide = max(dim, *(s.dim for s in cell))
        vectors = np.pad(np.frombuffer(block, np.int64).reshape(n, dim), ((0, 0), (0, wide - dim))).astype(kind)
        for name, q in zip(own_ids, vectors):
            ids, scores = np.zeros(0, object), np.zeros(0, kind)
            for shard, known in zip(cell, names):
                got, score, _ = shard.best(q, known == name, k, scores[-1] if len(scores) == k else None)
                ids, scores = np.concatenate([ids, known[got]]), np.concatenate([scores, score])
                at = _first(ids, scores, k)
                ids, scores = ids[at], scores[at]
            out[0].extend([name] * len(ids))
            out[1].extend(ids.tolist())
            out[2].extend(max(-LONG - 1, min(LONG, int(s))) for s in scores)
    return out


def threshold_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id",
                   column: str = "embedding") -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` rows of ``vectors`` with the highest inner product for each query.

    Entries count as ``floor(scale * entry)``. Rows of either side whose vector is null, or holds null or
    non-finite entries, take no part. Shorter vectors end in zeros. A row is no candidate for a
    query of the same key. Ties go to the smaller key, a null key comes last. Repeated candidate rows count
    each, equal query rows once; several vectors of one query key share its k ranks. A query without a key
    is left out. Scores beyond a long end at its limits. An empty side gives no rows. Other columns are not read.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, {key} {kind}, score bigint"
    index = written(_packed(whole(vectors, key, column, scale), key, ROWS, True))
    blocks = written(_packed(whole(queries, key, column, scale).filter(F.col(key).isNotNull()).distinct(), key, BLOCK, False))
    size = [df.agg(F.count("*"), F.max("dim"), F.max("largest")).first() for df in (index, blocks)]
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last(key))
    if not size[0][0] or not size[1][0]:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(1).alias("rank"), key, "score")
    number = _number(size[1][2], size[0][2], max(size[0][1], size[1][1]))
    cells, groups = -(-size[0][0] // CELL), size[1][0]

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("part"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = dealt(blocks, "group", groups, "cell", cells).groupBy("cell", "group")
    right = dealt(index, "cell", cells, "group", groups).groupBy("cell", "group")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        got = _meet(a, b, k, number) if a.num_rows and b.num_rows else ([], [], [])
        ids = b.schema.field("ids").type.value_type
        return pa.table({"query_id": pa.array(got[0], ids), key: pa.array(got[1], ids), "score": pa.array(got[2], pa.int64())})

    found = left.cogroup(right).applyInArrow(meet, schema)
    return found.withColumn("rank", F.row_number().over(window).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", key, "score")

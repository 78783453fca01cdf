"""Exact nearest-neighbour search over stored cells of vectors, most of which a search need not read.

Cells are learned by k-means on unit vectors and stored one folder each; a cell's rows lie in rings by
their distance from its centre. By the triangle inequality a row of a ring with distances from ``low`` to ``high`` is at least
``max(low - d, d - high)`` away from a query at distance ``d`` from the centre, which bounds its similarity. A query first
searches the rings that promise most until they hold k rows. What these give is a floor, and
only rings whose bound reaches it are searched after. The result is that of comparing all with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docweave.operators.tables import written
from docweave.operators.vector import GRID_BYTES, Block, _compare, _keep_best, _unit

#: Rows that centres are fitted on; every row is stored in a cell.
SAMPLE = 20_000
MOST_CELLS = 1024
RINGS = 16
WIDTH = 2.0 / RINGS
#: Rows and queries that meet in one group, at least; of short vectors as many as ``GRID_BYTES`` hold.
ROWS = 4096
SLACK = 1e-5  # similarities are compared at six digits
#: Distances that a task holds at once, and rows of a batch that it passes on.
ENTRIES = 1 << 20
BATCH = 8192


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _distance(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (unit * unit).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * unit @ centres.T
    return np.sqrt(np.maximum(square, 0))


def _bounds(unit: np.ndarray, centres: np.ndarray, rings: dict[str, np.ndarray]) -> np.ndarray:
    """The most that the similarity of each vector to a row of each ring can be."""
    far = _distance(unit, centres)[:, rings["cell"]]
    apart = np.maximum(np.maximum(rings["low"] - far, far - rings["high"]), 0)
    # rows without direction have similarity 0
    return np.maximum(1 - apart * apart / 2, 0)


class Cells:
    """Vectors stored at ``path`` by cell; any number of batches may be added."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
        self.centres = np.array([r.centre for r in rows], np.float64)

    @staticmethod
    def learn(corpus: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> "Cells":
        """Fit centres on about ``SAMPLE`` rows of ``corpus(doc_id, embedding)``, drawn by a hash, and store all rows."""
        spark = corpus.sparkSession
        there = corpus.filter("embedding is not null").select("doc_id", "embedding")
        n, dim = there.agg(F.count("*"), F.max(F.size("embedding"))).first()
        cells = min(MOST_CELLS, cells or max(1, round(n ** 0.5)))
        drawn = there.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30)))
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        units = written(drawn.withColumn("norm", norm).filter("norm > 0").select(
            array_to_vector(F.transform("embedding", lambda x: x / F.col("norm"))).alias("features")))
        if units.isEmpty():
            centres = [[0.0] * (dim or 1)]
        else:
            centres = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=10).fit(units).clusterCenters()]
        spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        store = Cells(spark, path)
        store.add(there)
        return store

    def add(self, corpus: DataFrame) -> None:
        """Store the rows of ``corpus(doc_id, embedding)``; null vectors are left out."""
        centres, kind = self.centres, corpus.schema["doc_id"].dataType
        vector = corpus.schema["embedding"].dataType.simpleString()
        step = max(1, ENTRIES // len(centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    piece = batch.slice(at, step)
                    far = _distance(_vectors(piece.column(1)), centres)
                    cell = far.argmin(axis=1)
                    far = far[np.arange(len(cell)), cell]
                    ring = np.minimum(far / WIDTH, RINGS - 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*piece.columns, pa.array(cell, pa.int32()), pa.array(ring), pa.array(far)], names=["doc_id", "embedding", "cell", "ring", "far"])

        placed = written(corpus.filter("embedding is not null").select("doc_id", "embedding").mapInArrow(
            run, f"doc_id {kind.simpleString()}, embedding {vector}, cell int, ring int, far double"))
        sizes = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
        placed.drop("far").repartitionByRange("cell", "ring", "doc_id").sortWithinPartitions("cell", "ring").write.mode("append").partitionBy(
            "cell").parquet(f"{self.path}/rows")
        sizes.coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")

    def rings(self) -> dict[str, np.ndarray]:
        """Cell, ring, rows, and least and greatest distance of all rings: at most ``MOST_CELLS * RINGS`` lines."""
        lines = self.spark.read.parquet(f"{self.path}/sizes").groupBy("cell", "ring").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell", "ring").collect()
        return {c: np.array([r[c] for r in lines]) for c in ("cell", "ring", "n", "low", "high")}

    def topk(self, queries: DataFrame, k: int, prune: bool = True) -> DataFrame:
        """Exact cosine top-k of ``queries(query_id, embedding)``: ``(query_id, doc_id, score, rank)``.

        Similarities are compared at six digits, ties go to the lower id. Without ``prune`` every ring is searched.
        """
        top, _ = self.search(queries, k, prune)
        return top

    def search(self, queries: DataFrame, k: int, prune: bool = True) -> tuple[DataFrame, DataFrame]:
        """The top-k, and ``(query_id, rings, searched)``: how many rings there are and were searched for each query."""
        queries = queries.filter("embedding is not null").select("query_id", "embedding")
        rings, rows = self.rings(), max(ROWS, GRID_BYTES // (8 * self.centres.shape[1]))
        parts = -(-max(1, queries.count()) // rows)
        if not len(rings["n"]):
            none = queries.select("query_id", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).limit(0)
            return none, queries.select("query_id", F.lit(0).alias("rings"), F.lit(0).alias("searched"))

        def promising(bound: np.ndarray) -> list[np.ndarray]:
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(rings["n"][order], axis=1) - rings["n"][order]
            return [o[b < k] for o, b in zip(order, before)]

        chosen = written(self._chosen(queries, rings, parts, promising))
        first = self._compared(chosen, rings, k)
        window = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        best = first.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
        floor = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        known = queries.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)) if prune else F.lit(-2.0))
        asked = written(self._reaching(known, rings, rows, parts))
        top = self._met(asked, rings, rows, parts, k).withColumn("rank", F.row_number().over(window).cast("bigint")).filter(F.col("rank") <= k)
        return top, asked.groupBy("query_id").agg(F.lit(len(rings["n"])).alias("rings"), F.sum("reached").cast("int").alias("searched"))

    @staticmethod
    def _groups(rings: dict[str, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The group of each ring, of about ``rows`` rows of neighbouring rings, and the blocks that a ring with more rows lies in."""
        return (np.cumsum(rings["n"]) - rings["n"]) // rows, -(-rings["n"] // rows)

    def _reaching(self, queries: DataFrame, rings: dict[str, np.ndarray], rows: int, parts: int) -> DataFrame:
        """``(query_id, embedding, floor, reached, part, at, block)``: a row for each group of rings in which one reaches the floor."""
        group, blocks = self._groups(rings, rows)
        places = sorted({(g, i) for g, n in zip(group.tolist(), blocks.tolist()) for i in range(n)})
        # rings in order of their first place; those in several blocks are in the places behind too
        member = np.array([(group == g) & (blocks > i) for g, i in places])
        step, centres = max(1, ENTRIES // len(group)), self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, step):
                    piece = batch.slice(low, step)
                    near = _bounds(_vectors(piece.column(1)), centres, rings) >= piece.column(2).to_numpy()[:, None] - SLACK
                    for (g, i), rings_there in zip(places, member):
                        n = near[:, rings_there].sum(axis=1)
                        own = pa.array(np.flatnonzero(n))
                        if len(own):
                            # a ring counts once, in its first block
                            count = near[:, rings_there].sum(axis=1) if i == 0 else 0 * n
                            yield pa.RecordBatch.from_arrays([
                                *(piece.column(c).take(own) for c in range(3)), pa.array(count[n > 0], pa.int64()),
                                pa.array(np.full(len(own), g), pa.int32()), pa.array(np.full(len(own), i), pa.int32())],
                                names=["query_id", "embedding", "floor", "reached", "at", "block"])

        kind, vector = (queries.schema[c].dataType.simpleString() for c in ("query_id", "embedding"))
        out = queries.select("query_id", "embedding", "floor").mapInArrow(
            run, f"query_id {kind}, embedding {vector}, floor double, reached bigint, at int, block int")
        return out.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))

    def _met(self, asked: DataFrame, rings: dict[str, np.ndarray], rows: int, parts: int, k: int) -> DataFrame:
        """Best ``k`` of each group of queries and rings: ``(query_id, doc_id, score)``. A query meets the cells of which a ring reaches its floor.

        A query is sent once a group and a row once a part of the queries, whatever the rings.
        """
        group, blocks = self._groups(rings, rows)
        lines = list(zip(rings["cell"].tolist(), rings["ring"].tolist(), group.tolist(), blocks.tolist()))
        where = F.broadcast(self.spark.createDataFrame(lines, "cell int, ring int, _at int, blocks int"))
        at = [r[0] for r in asked.select("at").distinct().collect()]  # at most as many as rings
        stored = self.spark.read.parquet(f"{self.path}/rows").filter(F.col("cell").isin(sorted({c for c, _, g, _ in lines if g in set(at)})))
        placed = stored.join(where, ["cell", "ring"]).withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        met = asked.select(F.col("at").alias("_at"), F.col("block").alias("_block"), F.col("part").alias("_part")).distinct()
        held = placed.join(F.broadcast(met), ["_at", "_block"]).select("_at", "_block", "_part", "cell", "doc_id", "embedding")
        asker, doc = asked.schema["query_id"].dataType, stored.schema["doc_id"].dataType
        ids, names, centres = to_arrow_type(asker), to_arrow_type(doc), self.centres

        def meet(q: pa.Table, d: pa.Table) -> pa.Table:
            found = []
            if q.num_rows and d.num_rows:
                own, other = (Block(t.column(c).combine_chunks().to_numpy(zero_copy_only=False), _vectors(t.column("embedding").combine_chunks()), None)
                              for t, c in ((q, "query_id"), (d, "doc_id")))
                cell, floor, n = d.column("cell").to_numpy(), q.column("floor").to_numpy() - SLACK, 0
                for value in np.unique(cell):
                    here = {c: x[rings["cell"] == value] for c, x in rings.items()}
                    step = max(1, ENTRIES // len(here["n"]))
                    most = np.concatenate([_bounds(own.unit[low:low + step], centres, here).max(axis=1) for low in range(0, len(own.ids), step)])
                    asks, of = np.flatnonzero(most >= floor), np.flatnonzero(cell == value)
                    if len(asks):
                        r, i, s = _compare(Block(own.ids[asks], own.unit[asks], None), Block(other.ids[of], other.unit[of], None), k)
                        found.append((asks[r], i, s))
                        n += len(r)
                    if n > 4 * k * len(own.ids):
                        found = [_keep_best(*(np.concatenate(x) for x in zip(*found)), k)]
                        n = len(found[0][0])
            if not found:
                return pa.table({"query_id": pa.array([], ids), "doc_id": pa.array([], names), "score": pa.array([], pa.float64())})
            r, i, s = _keep_best(*(np.concatenate(x) for x in zip(*found)), k)
            return pa.table({"query_id": pa.array(own.ids[r], ids), "doc_id": pa.array(i, names), "score": pa.array(s, pa.float64())})

        queries = asked.select("at", "block", "part", "query_id", "embedding", "floor").groupBy("at", "block", "part")
        return queries.cogroup(held.groupBy("_at", "_block", "_part")).applyInArrow(
            meet, f"query_id {asker.simpleString()}, doc_id {doc.simpleString()}, score double")

    def _chosen(self, queries: DataFrame, rings: dict[str, np.ndarray], parts: int,
                choose: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
        """``(query_id, embedding, part, cell, ring, block)``: where each query is to be compared."""
        centres, kind = self.centres, queries.schema["query_id"].dataType
        blocks = -(-rings["n"] // ROWS)
        step = max(1, ENTRIES // int(blocks.sum()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    piece = batch.slice(at, step)
                    found = choose(_bounds(_vectors(piece.column(1)), centres, rings))
                    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                    ring = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
                    times = blocks[ring]
                    row, ring = np.repeat(row, times), np.repeat(ring, times)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    for low in range(0, len(row), BATCH):
                        own, of = pa.array(row[low:low + BATCH]), slice(low, low + BATCH)
                        yield pa.RecordBatch.from_arrays([
                            piece.column(0).take(own), piece.column(1).take(own), pa.array(rings["cell"][ring[of]], pa.int32()),
                            pa.array(rings["ring"][ring[of]], pa.int32()), pa.array(block[of], pa.int32()), pa.array(blocks[ring[of]], pa.int32())],
                            names=["query_id", "embedding", "cell", "ring", "block", "blocks"])

        vector = queries.schema["embedding"].dataType.simpleString()
        out = queries.select("query_id", "embedding").mapInArrow(
            run, f"query_id {kind.simpleString()}, embedding {vector}, cell int, ring int, block int, blocks int")
        return out.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))

    def _compared(self, chosen: DataFrame, rings: dict[str, np.ndarray], k: int) -> DataFrame:
        """Best ``k`` of each group of queries and rows: ``(query_id, doc_id, score)``. Only cells that a query needs are read."""
        cells = [r[0] for r in chosen.select("cell").distinct().collect()]  # at most MOST_CELLS
        rows = self.spark.read.parquet(f"{self.path}/rows").filter(F.col("cell").isin(cells))
        met = chosen.select("cell", "ring", "blocks", "part").distinct()
        met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sizes = chosen.select("cell", "ring", "blocks").distinct()
        placed = rows.join(sizes, ["cell", "ring"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).drop("blocks")
        held = placed.join(met.drop("blocks"), ["cell", "ring", "block"]).select(
            *(F.col(c).alias(f"_{c}") for c in ("cell", "ring", "block", "part")), "doc_id", "embedding")
        asker, doc = chosen.schema["query_id"].dataType, rows.schema["doc_id"].dataType
        ids, names = to_arrow_type(asker), to_arrow_type(doc)

        def meet(q: pa.Table, d: pa.Table) -> pa.Table:
            if not q.num_rows or not d.num_rows:
                return pa.table({"query_id": pa.array([], ids), "doc_id": pa.array([], names), "score": pa.array([], pa.float64())})
            own, other = (Block(t.column(c).combine_chunks().to_numpy(zero_copy_only=False), _vectors(t.column("embedding").combine_chunks()), None)
                          for t, c in ((q, "query_id"), (d, "doc_id")))
            r, i, s = _compare(own, other, k)
            return pa.table({"query_id": pa.array(own.ids[r], ids), "doc_id": pa.array(i, names), "score": pa.array(s, pa.float64())})

        keys = ("cell", "ring", "block", "part")
        return chosen.select(*keys, "query_id", "embedding").groupBy(*keys).cogroup(held.groupBy(*(f"_{c}" for c in keys))).applyInArrow(
            meet, f"query_id {asker.simpleString()}, doc_id {doc.simpleString()}, score double")

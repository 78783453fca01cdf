"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries are brought to whole numbers, every distinct vector is a row of X once, and rows are centred
on their exact mean. Right vectors, one number per dimension, live on the driver; left vectors, one number
per row, are never stored: each lies in the range of X, so a task has its part as the product of its
rows with a coefficient column. One step is one pass over the rows: it forms Xv less the left vector
before, its products with all left vectors (full reorthogonalisation) and its product with X', which are
summed over the cluster. Right vectors are reorthogonalised twice against all before. The singular values of the small
bidiagonal matrix give deviations, its right vectors the components.

Steps end when the wanted triplets have settled to double precision or the space is used up. A second
run orthogonal to what was found then looks for larger values, so equal eigenvalues
are found as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.tables import written

BLOCK_BYTES = 4 << 20
SETTLED = 1e-15
#: For the run that only looks whether a larger value is left: values err by the square of it.
LOOKED = 1e-7
#: Singular values up to this share of the Frobenius norm count as zero.
ZERO = 1e-12
LONG = (1 << 63) - 1


def whole(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """``(key, x)``: entries as ``floor(scale * entry)``; rows with a null vector, or null or non-finite entries, go."""
    def finite(e: Column) -> Column:
        return e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))

    entries = F.col(column).cast("array<double>")
    return vectors.filter(F.col(column).isNotNull() & F.forall(entries, finite)).select(
        F.col(key), F.transform(entries, lambda e: F.floor(e * F.lit(float(scale)))).alias("x"))


def matrix(column: pa.Array, dim: int = 0) -> np.ndarray:
    """Rows of an Arrow list column of longs; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    wide = max(dim, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _blocks(distinct: DataFrame) -> DataFrame:
    """``(n, dim, block)``: vectors packed into blocks of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            step = max(1, BLOCK_BYTES // max(8, 8 * x.shape[1]))
            parts = [x[i:i + step] for i in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(p) for p in parts], pa.int64()), pa.array([x.shape[1]] * len(parts), pa.int32()),
                 pa.array([p.tobytes() for p in parts], pa.binary())], names=["n", "dim", "block"])

    return distinct.mapInArrow(run, "n bigint, dim int, block binary")


class Centre:
    """The exact mean of the fit list as its size and whole sums."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums, self.dim = n, sums, len(sums)
        bound = n * largest + max(map(abs, sums), default=0)
        self.exact = bound < 1 << 62
        self.squares = bound * bound * max(1, self.dim) < 1 << 63

    def rows(self, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return x.astype(np.float64) - np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of ``(n*x - S)**2``; null beyond the range of a long."""
        if self.squares:
            return pa.array(((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1), pa.int64())
        got = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return pa.array([int(v) if v <= LONG else None for v in got], pa.int64())


def _unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    for n, wide, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
        x = np.frombuffer(block, np.int64).reshape(n, wide)
        yield x if wide == dim else np.pad(x, ((0, 0), (0, dim - wide)))


def _centre(blocks: DataFrame) -> Centre | None:
    """Size, sums per dimension and largest entry, summed over the cluster in halves that cannot overflow."""
    n, dim = blocks.agg(F.sum("n"), F.max("dim")).first()
    if not n or not dim:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, most = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            for x in _unpacked(batch, dim):
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                most = max(most, int(x.max()), -int(x.min() + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim), pa.int32()), pa.array(high), pa.array(low), pa.array([most] * dim, pa.int64())],
            names=["pos", "high", "low", "most"])

    halves = blocks.mapInArrow(run, "pos int, high bigint, low bigint, most bigint")
    wide = T.DecimalType(38, 0)
    rows = halves.groupBy("pos").agg(
        F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"), F.max("most").alias("most")).orderBy("pos").collect()
    return Centre(n, [(int(r.high) << 32) + int(r.low) for r in rows], rows[0].most + 1)


def _summed(blocks: DataFrame, centre: Centre, width: int, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``compute`` of the centred rows of every block, ``width`` numbers each, summed over the cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x in _unpacked(batch, centre.dim):
                total += compute(centre.rows(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["pos", "value"])

    out = np.zeros(width)
    for pos, value in blocks.mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value")).collect():
        out[pos] = value
    return out


def _step(left: np.ndarray, q: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Of rows X: the products of w = Xq with the left vectors X·left, with itself, and with X'."""
    both = np.column_stack([left, q])

    def compute(rows: np.ndarray) -> np.ndarray:
        product = rows @ both
        w = product[:, -1]
        return np.concatenate([product.T @ w, rows.T @ w])

    return compute


def _orthogonal(x: np.ndarray, *against: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for basis in against:
            x = x - basis @ (basis.T @ x)
    return x


def bidiagonal(product: Callable[[np.ndarray, np.ndarray], np.ndarray], dim: int, norm: float, found: np.ndarray,
               want: int, settled: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right vectors of X on what is orthogonal to ``found``.

    ``product(left, q)`` gives the sums of ``_step``. ``want`` triplets have residuals of ``settled``, the others are as they come.
    """
    zero, room = ZERO * norm, dim - found.shape[1]
    right, left, back = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    diagonal, above = [], []
    v = _orthogonal(np.random.default_rng(seed).standard_normal(dim), found)
    v, beta, before = v / np.linalg.norm(v), 0.0, np.zeros(dim)
    while True:
        k = len(diagonal)
        q = v - beta * before
        got = product(left, q)
        c, square, image = got[:k], got[k], got[k + 1:]
        alpha = float(np.sqrt(max(0.0, square - c @ c)))
        known = alpha > zero
        before = (q - left @ c) / alpha if known else np.zeros(dim)
        image = (image - back @ c) / alpha if known else np.zeros(dim)
        alpha = alpha if known else 0.0
        right, left, back = (np.column_stack([m, x]) for m, x in ((right, v), (left, before), (back, image)))
        diagonal.append(alpha)
        r = _orthogonal(image - alpha * v, right, found)
        beta = float(np.linalg.norm(r))
        ended = beta <= zero or k + 1 >= room
        u, sigma, vt = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
        if ended or (k + 1 > want and (beta * np.abs(u[-1, :want]) <= settled * sigma[0]).all()):
            return sigma, right @ vt.T
        above.append(beta)
        v = r / beta


def _triplets(blocks: DataFrame, centre: Centre, norm: float, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest singular values of the centred rows and their right vectors, as many as are not zero."""
    def product(left: np.ndarray, q: np.ndarray) -> np.ndarray:
        return _summed(blocks, centre, left.shape[1] + 1 + centre.dim, _step(left, q))

    def leading(take: int, settled: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        sigma, basis = bidiagonal(product, centre.dim, norm, vectors, take, settled, seed)
        there = sigma[:take] > ZERO * norm
        return sigma[:take][there], basis[:, :take][:, there]

    vectors, seed = np.zeros((centre.dim, 0)), 1
    values, vectors = leading(want, SETTLED, seed)
    while vectors.shape[1] < centre.dim:
        seed += 1
        more, _ = leading(1, LOOKED, seed)
        if not len(more) or (len(values) >= want and more[0] <= values[want - 1] * (1 + 1e-9)):
            break
        more, axes = leading(1, SETTLED, seed)
        order = np.argsort(-np.concatenate([values, more]), kind="stable")
        values, vectors = np.concatenate([values, more])[order], np.column_stack([vectors, axes])[:, order]
    return values[:want], vectors[:, :want]


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` of every row and component.

    Rows whose vector is null, or holds null or non-finite entries, are dropped; a null key stays. Equal
    vectors are fitted once and all get rows, as do rows repeated altogether. Shorter vectors end in zeros. Components
    without deviation are left out, so a table without two different vectors, or an empty one, has
    no rows. Equal eigenvalues: any orthonormal axes of their space, in any order. ``deviation`` is null where
    it exceeds a long. Other columns are not read.
    """
    rows = whole(vectors, key, column, scale)
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType)] + T._parse_datatype_string(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields)
    blocks = written(_blocks(rows.select("x").distinct()))
    centre = _centre(blocks)
    none = vectors.sparkSession.createDataFrame([], schema)
    if centre is None:
        return none
    square = _summed(blocks, centre, 1, lambda a: np.array([(a * a).sum()]))[0]
    if not square:
        return none
    sigma, axes = _triplets(blocks, centre, float(np.sqrt(square)), components)
    e, k = sigma ** 2 / centre.n, len(sigma)
    white = axes / np.sqrt(e)
    mean = _summed(blocks, centre, k, lambda a: (a @ white).sum(axis=0)) / centre.n

    def spread(a: np.ndarray) -> np.ndarray:
        z = a @ white - mean
        return (z.T @ z).ravel()

    error = float(np.abs(_summed(blocks, centre, k * k, spread).reshape(k, k) / centre.n - np.eye(k)).max())
    explained = e * centre.n / square

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, BLOCK_BYTES // max(8, 8 * centre.dim))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = matrix(part.column(1), centre.dim)
                z, own = centre.rows(x) @ white, pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(own), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(x) * k, centre.n), pa.int64()), centre.deviations(x).take(own),
                    pa.array(z.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))], names=schema.names)

    return rows.mapInArrow(run, schema)

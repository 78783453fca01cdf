"""Whitening against a dense eigendecomposition, equal eigenvalues and odd input."""

import math

import numpy as np
import pytest
from oracle import DATA

from docweave.llm import whitening
from docweave.llm.queries import QUERIES


def plain(rows, scale=256, k=4):
    """``{id: [(whitened, deviation)]}`` up to sign, with n and the shares explained."""
    kept = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    x = np.array([[math.floor(scale * c) for c in v] + [0] * (dim - len(v)) for _, v in kept], np.int64).reshape(len(kept), dim)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(k, int((e > 1e-12 * e.sum()).sum()))
    return kept, n, e[:k] / e.sum(), (x - s / n) @ axes[:, :k] / np.sqrt(e[:k]), ((n * x - s) ** 2).sum(axis=1)


def compare(df, rows, k=4):
    kept, n, explained, white, deviation = plain(rows, k=k)
    got = df.toPandas()
    assert len(got) == len(kept) * len(explained) and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in kept]].to_numpy()
    assert np.abs(wide * np.sign((wide * white).sum(axis=0)) - white).max() < 1e-9
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(explained, rel=1e-12)
    assert got[got.component == 1].set_index("vec_id").deviation.loc[[i for i, _ in kept]].tolist() == deviation.tolist()


def test_given_table(spark):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    compare(QUERIES["op11_whitening"](spark, f"{DATA}/sf0.001"), rows)


def test_odd_input(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 5)) * [4, 3, 2, 1, 0.5]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [1.0, None, 0.0, 0.0, 0.0]), (104, [float("nan")] * 5),
             (105, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (106, []), (107, [1.5]), (108, [-0.001] * 5)]
    df = spark.createDataFrame([(i, v, 0, "kept") for i, v in rows], "vec_id bigint, embedding array<double>, n int, component string")
    compare(whitening.whiten(df), rows)
    repeated = whitening.whiten(df.unionByName(df)).toPandas()
    assert len(repeated) == 2 * whitening.whiten(df).count() and len(set(repeated[repeated.vec_id == 3].whitened)) == len(set(repeated.component))
    keyless = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(str(r.vec_id) for r in whitening.whiten(keyless).collect()) == ["1"] * 4 + ["None"] * 2
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id in (0, 100, 101)")).count() == 0
    assert whitening.whiten(df.filter("vec_id = 106")).count() == 0


def test_large_entries(spark):
    rows = [(i, [1e16 * (i % 3), 3e15 * (i % 2), float(i)]) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert got.deviation.isna().all() and got[got.component < 3].whitened.abs().max() < 4 and got.n.eq(12).all()


def test_equal_eigenvalues(spark):
    """Each of five axes has the same deviation; four orthogonal components come out, and the smaller ones stay away."""
    rows = [(10 * i + s, [float(s * 2 - 1) * (2.0 if j == i and i < 5 else 0.5 if j == i else 0.0) for j in range(7)])
            for i in range(7) for s in (0, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert got.component.nunique() == 4 and got.identity_error.max() < 1e-9
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx([4 / (5 * 4 + 2 * 0.25)] * 4, rel=1e-12)


def test_bidiagonal_of_a_dense_matrix():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 30)) @ np.diag(np.linspace(5, 0.1, 30))
    x[:, 29] = x[:, 0]  # of lower rank
    passes = []

    def product(left, q):
        passes.append(1)
        return whitening._step(left, q)(x)

    sigma, axes = whitening.bidiagonal(product, 30, np.linalg.norm(x), np.zeros((30, 0)), 4, whitening.SETTLED, 1)
    u, s, vt = np.linalg.svd(x)
    assert sigma[:4] == pytest.approx(s[:4], rel=1e-13) and np.abs(np.abs((vt[:4] * axes[:, :4].T).sum(axis=1)) - 1).max() < 1e-12
    assert len(passes) <= 30

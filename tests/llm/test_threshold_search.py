"""The threshold algorithm against full scoring, its stop, ties and odd input."""

import math

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import threshold_search as ts


def whole(rows, scale=1024):
    return [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def plain(queries, rows, k=10):
    out = {}
    asked = {(i, tuple(v)) for i, v in whole(queries) if i is not None}
    for i, q in asked:
        out.setdefault(i, []).extend((sum(a * b for a, b in zip(q, v)), j) for j, v in whole(rows) if j != i)
    return sorted((i, r + 1, j, s) for i, found in out.items()
                  for r, (s, j) in enumerate(sorted(found, key=lambda e: (-e[0], e[1] is None, e[1]))[:k]))


def run(spark, queries, rows, k=10):
    ddl = "vec_id bigint, embedding array<double>, score string, rank int"
    q, v = (spark.createDataFrame([(i, e, "x", 0) for i, e in part], ddl) for part in (queries, rows))
    return sorted((tuple(r) for r in ts.threshold_topk(q, v, k).collect()), key=lambda r: r[:2])


def test_against_full_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ts, "ROWS", 37)
    monkeypatch.setattr(ts, "BLOCK", 3)
    rows = [(i, rng.standard_normal(6).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # many equal vectors: ties by key
    queries = [r for r in rows if r[0] % 50 == 0]
    assert run(spark, queries, rows) == plain(queries, rows)
    assert run(spark, queries, rows, 1) == plain(queries, rows, 1)


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, -0.5, 0.0]), (2, [1.0, -0.5, 0.0]), (2, [1.0, -0.5, 0.0]), (3, None), (4, [1.0, None, 0.0]), (5, [nan, 0.0, 0.0]),
            (6, [inf, 0.0, 0.0]), (7, []), (8, [2.0]), (None, [3.0, 0.0, 0.0]), (9, [0.0, 0.0, 0.0]), (9, [-1.0, 0.3, 0.0001]), (10, [0.1, 0.1, 0.1, -7.0])]
    assert run(spark, rows, rows) == plain(rows, rows)
    assert run(spark, rows, rows, 2) == plain(rows, rows, 2)
    assert run(spark, [], rows) == [] and run(spark, rows, []) == [] and run(spark, rows[:1], rows[:1]) == []


def test_large_entries(spark):
    rows = [(i, [2.0 ** (8 + i), 1.0 - 2.0 ** i]) for i in range(12)]
    assert run(spark, rows, rows, 3) == plain(rows, rows, 3)
    huge = [(i, [1e16 * (i - 3), 1.0]) for i in range(6)]
    got = run(spark, huge, huge, 2)
    assert [r[2] for r in got if r[0] == 5] == [4, 3] and max(r[3] for r in got) == 2 ** 63 - 1


@pytest.mark.parametrize("k", [1, 10])
def test_walk_ends_early(k):
    """Where few rows stand out, the lists are read to a small depth only."""
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (4000, 4))
    x[:20] = rng.integers(3000, 4000, (20, 4))
    lists = np.argsort(-x.T, axis=1, kind="stable").astype(np.int32)
    shard = ts.Shard(pa.scalar(list(range(4000))), 4000, 4, x.tobytes(), lists.tobytes(), np.float64)
    for q in (np.array([5.0, 1, 0, 2]), np.array([-1.0, 3, 3, 3])):
        got, scores, depth = shard.best(q, np.zeros(4000, bool), k, None)
        full = x @ q
        assert depth <= 64 and sorted(scores)[-k:] == sorted(full)[-k:] and len(got) < 300
        assert shard.best(q, np.zeros(4000, bool), k, int(full.max()) + 1)[2] <= depth

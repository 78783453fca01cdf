"""Score arithmetic shared by retrieval, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def normalize_score(s: Column) -> Column:
    """Bring a raw distance or similarity into [0, 1]."""
    return (
        F.when(s > 1, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), s / 10)))
        .when(s < 0, F.greatest(F.lit(0.0), (s + 1) / 2))
        .otherwise(s)
    )


def rank_score(rank: Column) -> Column:
    """Score of a 1-based rank when the retriever exposes none."""
    return F.greatest(F.lit(0.2), 1 - F.lit(0.1) * (rank - 1))


def positional_score(rank: Column, batch: int = 8) -> Column:
    """Fallback pair score by position inside each scoring batch."""
    return 1 - F.lit(0.1) * F.pmod(rank - 1, F.lit(batch))


def squash_above_one(s: Column) -> Column:
    """Logistic squash, only where the score is above one."""
    return F.when(s > 1, 1 / (1 + F.exp(-s))).otherwise(s)


def minmax_per_query(s: Column, query: str) -> Column:
    """Min-max within a query if any of its scores leaves [0, 1]; all equal gives 0.5.

    Partitions are one query's candidate list, bounded by the fetch size.
    """
    w = Window.partitionBy(query)
    lo, hi = F.min(s).over(w), F.max(s).over(w)
    return F.when((lo >= 0) & (hi <= 1), s).when(lo == hi, F.lit(0.5)).otherwise(
        (s - lo) / (hi - lo)
    )


def exact_mean(x: Column, where: Column | None = None) -> Column:
    """Mean over a decimal sum: the same whatever the order of rows, NULL if there are none."""
    value = x.cast("decimal(20,8)")
    value = value if where is None else F.when(where, value)
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))

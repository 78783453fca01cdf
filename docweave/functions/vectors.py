"""Vector columns."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns, 0 where either has no length."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(_dot(a, b) / norms)


def _bucket(term: str, dim: int) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % dim


#: Terms whose buckets a task remembers at most.
SEEN = 1 << 16


def hashed_embedding(dim: int = 64):
    """Default embedder: term counts hashed into ``dim`` buckets, unit length.

    Row-local and deterministic; any pandas or Arrow UDF from text to an array of floats can
    take its place. One text at a time leaves the Arrow batch, and terms remembered are bounded.
    """
    token = re.compile(r"\w+")

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pa.Array) -> pa.Array:
        seen: dict[str, int] = {}
        out = np.zeros((len(texts), dim))
        for v, text in zip(out, texts):
            ids = []
            for t in token.findall((text.as_py() or "").lower()):
                if t not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[t] = _bucket(t, dim)
                ids.append(seen[t])
            v += np.bincount(np.array(ids, dtype=np.int64), minlength=dim)
            n = np.sqrt(v @ v)
            if n:
                v /= n
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dim, out.ravel())

    return embed

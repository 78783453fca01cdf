"""Documents to chunks. Every chunker is row-local: no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as tx


def _exploded(df: DataFrame, pieces: Column) -> DataFrame:
    keep = [c for c in df.columns if c != "text"]
    return (
        df.withColumn("_p", pieces)
        .select(*keep, F.size("_p").cast("bigint").alias("total_chunks"), F.posexplode("_p").alias("chunk_index", "text"))
        .withColumn("chunk_index", F.col("chunk_index").cast("bigint"))
    )


def fixed_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters that cover the whole text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("bigint"), last)
    windows = F.transform(starts, lambda i: F.substring(text, (i * step + 1).cast("int"), F.lit(size)))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<string>"))


def chunk_fixed(df: DataFrame, size: int = 1000, overlap: int = 0) -> DataFrame:
    return _exploded(df, fixed_windows(F.col("text"), size, overlap))


# Fixed value: words of a closed chunk that open the next one.
CARRY_WORDS = 20


def chunk_paragraphs(df: DataFrame, size: int = 1000, separator: str = r"\n\s*\n", glue: str = "\n\n") -> DataFrame:
    """Pack paragraphs up to ``size`` characters; a long closed chunk lends its last 20 words."""
    empty = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, para: Column) -> Column:
        cur = acc["cur"]
        full = (F.length(cur) + F.length(para) > size) & (cur != "")
        w = tx.words(cur)
        carried = F.when(
            F.size(w) > CARRY_WORDS, F.concat(F.array_join(F.slice(w, -CARRY_WORDS, CARRY_WORDS), " "), F.lit(glue))
        ).otherwise("")
        base = F.when(full, carried).otherwise(cur)
        return F.struct(
            F.when(base != "", F.concat(base, F.lit(glue), para)).otherwise(para).alias("cur"),
            F.when(full, F.array_append(acc["done"], cur)).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])

    return _exploded(df, F.aggregate(F.split("text", separator), empty, step, finish))


def _starts(points: np.ndarray, separator: str) -> np.ndarray:
    """Where ``separator`` occurs in a text of code points, from the left and without overlap."""
    mark = np.frombuffer(separator.encode("utf-32-le"), np.uint32)
    n = len(points) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    here = np.ones(n, bool)
    for i, c in enumerate(mark):
        here &= points[i:i + n] == c
    at = np.flatnonzero(here)
    if len(mark) == 1 or not (np.diff(at) < len(mark)).any():
        return at
    taken, end = [], 0
    for i in at:
        if i >= end:
            taken.append(i)
            end = i + len(mark)
    return np.array(taken)


def _bounds(points: np.ndarray, size: int, separators: tuple[str, ...]) -> np.ndarray:
    """Offsets at which a text may be cut: pieces over ``size`` are opened by ever finer separators, which begin the next piece."""
    bounds = np.unique([0, len(points)])
    for separator in separators:
        long = np.flatnonzero(np.diff(bounds) > size)
        if not len(long):
            break
        at = _starts(points, separator) if separator else np.arange(len(points))
        piece = np.searchsorted(bounds, at, "right") - 1
        bounds = np.union1d(bounds, at[np.isin(piece, long)])
    return bounds


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Split at the coarsest separator that occurs, go finer inside long pieces, then pack.

    A chunk takes all pieces that fit from its start. The next starts at the first cut that
    repeats at most ``overlap`` characters and leaves room for one more piece.
    """
    bounds = _bounds(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), size, separators)
    chunks, start = [], 0
    while start < len(text):
        last = max(int(np.searchsorted(bounds, start + size, "right")) - 1, int(np.searchsorted(bounds, start, "right")))
        end = int(bounds[last])
        chunks.append(text[start:end])
        if end == len(text):
            break
        start = int(bounds[np.searchsorted(bounds, max(end - overlap, int(bounds[last + 1]) - size))])
    return [c for c in (c.strip() for c in chunks) if c]


# Separators tried in order, coarsest first, and the two size/overlap settings.
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")
SENTENCE_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
PLAIN = {"size": 1000, "overlap": 200, "separators": PLAIN_SEPARATORS}
SENTENCE = {"size": 1000, "overlap": 100, "separators": SENTENCE_SEPARATORS}


def chunk_recursive(df: DataFrame, size: int = 1000, overlap: int = 200,
                    separators: tuple[str, ...] = PLAIN_SEPARATORS) -> DataFrame:
    """Recursive character chunker, Arrow-batched. ``df`` keeps its other columns."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be non-negative and smaller than the chunk size")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "text"]
    schema = ", ".join([*fields, "total_chunks bigint", "chunk_index bigint", "text string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(text=[list(enumerate(split_recursive(t or "", size, overlap, separators))) for t in pdf["text"]])
            pdf["total_chunks"] = pdf["text"].map(len)
            pdf = pdf[pdf["total_chunks"] > 0].explode("text", ignore_index=True)
            pdf["chunk_index"] = [e[0] for e in pdf["text"]]
            pdf["text"] = [e[1] for e in pdf["text"]]
            yield pdf[[f.split()[0] for f in schema.split(", ")]]

    return df.mapInPandas(run, schema)


def size_parts(text: Column, size: int) -> Column:
    """Cut by size, at the last blank line of a window if that lies past its half. Lossless."""
    n = F.length(text)
    rounds = F.sequence(F.lit(0), F.ceil(n / (size / 2)).cast("int"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, _: Column) -> Column:
        window = F.substring(text, acc["at"] + 1, F.lit(size))
        back = F.instr(F.reverse(window), "\n\n")
        gap = F.when(back > 0, F.length(window) - back - 1).otherwise(-1)
        take = F.when((acc["at"] + size < n) & (gap > size * 0.5), gap).otherwise(F.lit(size))
        return F.when(acc["at"] >= n, acc).otherwise(F.struct(
            (acc["at"] + take).alias("at"),
            F.array_append(acc["done"], F.substring(window, F.lit(1), take)).alias("done"),
        ))

    return F.aggregate(rounds, empty, step, lambda acc: acc["done"])


HEADING = r"(?dm)(?=^#{1,2}[ \t]+[^\s])"


def split_headings(df: DataFrame, max_size: int = 30000) -> DataFrame:
    """Documents over ``max_size`` characters in sections by level 1-2 headings, else by size.

    Text before the first heading stays, as a section of its own without a slug.
    """
    text = F.col("text")
    parts = (
        F.when(F.length(text) <= max_size, F.array(text))
        .when(text.rlike(HEADING), F.filter(F.split(text, HEADING), lambda p: p != ""))
        .otherwise(size_parts(text, max_size))
    )
    first_line = F.regexp_extract("text", r"\A#{1,2}[ \t]+([^\n]+)", 1)
    return _exploded(df, parts).withColumn(
        "slug", F.when(F.col("total_chunks") > 1, tx.slug(first_line)).otherwise(""))

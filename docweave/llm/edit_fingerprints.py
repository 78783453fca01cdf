"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

All texts take the same random walk: at step t the walk is at some character, notes it, and a coin
that hangs on t and the character tells whether it goes on to the next character. Two walks over texts that differ by few
edits fall back into step after an edit, so the notes differ in few places. A fingerprint keeps the notes of
every ``2 ** level``-th step, so that there are at most ``SAMPLES``; levels are nested, and fingerprints of different
levels are compared at the coarser one. The likeness of two fingerprints is the share of equal samples; a step
that only one of them has counts as different.

Near copies are found by bands of sampled notes and verified on whole fingerprints (``near_links``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.words import slices

SAMPLES = 256
#: Coins repeat after so many steps; characters fall into 256 classes.
PERIOD = 4096
SLICE = 6 << 20
BANDS = 24
BAND_SAMPLES = 4
NEAR = 0.8


def _waits() -> np.ndarray:
    """Steps that a walk which reaches a character of class c at step t spends on it, at ``t * 256 + c``."""
    coins = np.random.default_rng(20).random((PERIOD, 256)) < 0.5
    coins[-1] = True  # so that no walk stays for ever
    wait = np.zeros((PERIOD, 256), np.int32)
    step = np.ones(256, np.int32)
    for t in range(2 * PERIOD - 1, -1, -1):
        step = np.where(coins[t % PERIOD], 1, step + 1)
        if t < PERIOD:
            wait[t] = step
    return wait.ravel()


WAITS = _waits()


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8) ^ (points & np.uint32(255)).astype(np.uint8)


def _walk(classes: np.ndarray, begin: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character is reached, and the step after each text's last; texts side by side."""
    length = np.diff(begin)
    order = np.argsort(-length, kind="stable")
    sizes = length[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    row = np.append(0, np.cumsum(active)).astype(np.int64)
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length))
    place = np.arange(len(classes)) - np.repeat(begin[:-1], length)
    place = row[place] + np.repeat(rank, length)
    across = np.empty(len(classes), np.int32)
    across[place] = classes
    reached = np.empty(len(classes), np.int32)
    now = start[order].astype(np.int32)
    edges = row.tolist()
    for a, s, e in zip(active.tolist(), edges, edges[1:]):
        here = now[:a]
        reached[s:e] = here
        here += WAITS[((here & (PERIOD - 1)) << 8) | across[s:e]]
    end = np.empty(len(length), np.int32)
    end[order] = now
    return reached[place], end


def _sampled(classes: np.ndarray, reached: np.ndarray, end: int) -> tuple[int, bytes]:
    """Level and notes of a walk."""
    level = 0
    while (end + (1 << level) - 1) >> level > SAMPLES:
        level += 1
    if not len(reached):
        return 0, b""
    steps = np.arange(0, end, 1 << level)
    return level, classes[np.searchsorted(reached, steps, "right") - 1].tobytes()


def likeness(a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
    """Share of equal samples of two fingerprints, from 0 to 1."""
    level = max(a[0], b[0])
    x = np.frombuffer(a[1], np.uint8)[::1 << (level - a[0])]
    y = np.frombuffer(b[1], np.uint8)[::1 << (level - b[0])]
    most, least = max(len(x), len(y)), min(len(x), len(y))
    return float((x[:least] == y[:least]).sum()) / most if most else 1.0


def spelled(fingerprint: tuple[int, bytes]) -> str:
    return f"{fingerprint[0]:02x}{fingerprint[1].hex()}"


def read(fingerprint: str) -> tuple[int, bytes]:
    return int(fingerprint[:2], 16), bytes.fromhex(fingerprint[2:])


def fingerprints_of(texts: list[str]) -> tuple[list[tuple[int, bytes]], list[np.ndarray], list[np.ndarray]]:
    """Fingerprints of texts, and their characters' classes and steps."""
    classes = _classes("".join(texts))
    begin = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    reached, end = _walk(classes, begin, np.zeros(len(texts)))
    parts = [slice(a, b) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
    own, steps = [classes[p] for p in parts], [reached[p] for p in parts]
    return [_sampled(c, s, e) for c, s, e in zip(own, steps, end.tolist())], own, steps


def _edited(own: list[np.ndarray], steps: list[np.ndarray], ends: list[int], tails: list[str], thirds: list[int]) -> list[tuple[int, bytes]]:
    """Fingerprints after the last ``thirds`` characters of texts have given way to ``tails``."""
    classes = _classes("".join(tails))
    begin = np.append(0, np.cumsum([len(t) for t in tails])).astype(np.int64)
    kept = [len(c) - k for c, k in zip(own, thirds)]
    start = np.array([s[k] if k < len(s) else e for s, k, e in zip(steps, kept, ends)], np.int64)
    reached, end = _walk(classes, begin, start)
    out = []
    for i, k in enumerate(kept):
        tail = slice(begin[i], begin[i + 1])
        out.append(_sampled(np.concatenate([own[i][:k], classes[tail]]), np.concatenate([steps[i][:k], reached[tail]]), int(end[i])))
    return out


RESULT = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _chained(documents: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """``(part, ghost, id, text)``: ranges of ids in ascending order, each led by the last row of the range below.

    The first range is led by the last row of all. Range bounds come from ids alone.
    """
    rows = documents.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = sorted(set(rows.agg(F.percentile_approx("id", shares, 100 * parts)).first()[0] or []))
    part = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    placed = rows.withColumn("part", part)
    last = dict(placed.filter("id is not null").select("part", "id").groupBy("part").agg(F.max("id")).collect())
    if not last:
        return placed.withColumn("ghost", F.lit(False)).select("part", "ghost", "id", "text")
    used = sorted(last)
    up = {p: used[(k + 1) % len(used)] for k, p in enumerate(used)}
    if used[0] != 0 and not rows.filter("id is null").isEmpty():
        up[used[-1]] = 0  # rows without an id come first of all
    where = F.element_at(F.array(*(F.lit(last.get(p)).cast(documents.schema[key].dataType) for p in range(len(bounds) + 1))), F.col("part") + 1)
    leads = F.element_at(F.array(*(F.lit(up.get(p)) for p in range(len(bounds) + 1))), F.col("part") + 1)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    ghost = F.struct(leads.alias("part"), F.lit(True).alias("ghost"))
    twice = F.when(F.col("id") == where, F.array(own, ghost)).otherwise(F.array(own))
    return placed.select(F.explode(twice).alias("p"), "id", "text").select("p.part", "p.ghost", "id", "text")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The edited text has its last third (rounded down, in code points) replaced by as many first characters
    of the next document, descending by key; after the last comes the first. ``near_edited`` and ``near_next`` are
    the likeness of the fingerprint to the edited text's and to the next document's.

    Null texts are empty; an empty fingerprint is like another empty one only. Rows with one key follow each
    other by text; rows without a key come after all others. A single document is its own next. An empty table gives no
    rows. Extra columns are not returned.
    """
    kind = documents.schema[key].dataType.simpleString()
    parts = parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _chained(documents, key, text, parts).repartition(parts, "part").sortWithinPartitions("part", F.desc("ghost"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                names = part.schema.names
                number, ghost, texts = (part.column(names.index(c)).to_pylist() for c in ("part", "ghost", "text"))
                prints, own, steps = fingerprints_of(texts)
                ends = [int(s[-1]) + int(WAITS[((int(s[-1]) & (PERIOD - 1)) << 8) | int(c[-1])]) if len(s) else 0 for s, c in zip(steps, own)]
                follow = []
                for i in range(len(texts)):
                    if before is None or before[0] != number[i]:
                        before = (number[i], texts[i], prints[i])
                    follow.append(before[1:])
                    before = (number[i], texts[i], prints[i])
                real = [i for i, g in enumerate(ghost) if not g]
                thirds = [len(texts[i]) // 3 for i in real]
                tails = [follow[i][0][:k] for i, k in zip(real, thirds)]
                after = _edited([own[i] for i in real], [steps[i] for i in real], [ends[i] for i in real], tails, thirds)
                columns = {
                    "n_chars": [len(texts[i]) for i in real],
                    "edited_sha256": [hashlib.sha256((texts[i][:len(texts[i]) - k] + t).encode()).hexdigest() for i, k, t in zip(real, thirds, tails)],
                    "fingerprint": [spelled(prints[i]) for i in real], "edited_fingerprint": [spelled(p) for p in after],
                    "near_edited": [likeness(prints[i], p) for i, p in zip(real, after)],
                    "near_next": [likeness(prints[i], follow[i][1]) for i in real]}
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(names.index("id")).take(pa.array(real, pa.int64())), *(pa.array(v, k) for v, k in zip(columns.values(), kinds))],
                    names=["id", *columns])

    return rows.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", key)


def near_links(prints: DataFrame, key: str = "doc_id", near: float = NEAR) -> DataFrame:
    """``(key, near_id, likeness)`` from ``prints(key, fingerprint)``: each document's likest lower one found by bands.

    A band is a hash of some samples at the fingerprint's own level or the next coarser one. Of each band a document is
    compared with the smallest key in it, so large bands cost one pair per member; pairs are verified on whole
    fingerprints. Empty fingerprints and rows without a key have no links.
    """
    kind = prints.schema[key].dataType.simpleString()
    places = np.random.default_rng(30).integers(0, SAMPLES // 2, (BANDS, BAND_SAMPLES))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                level, notes = read(text)
                for k in range(level, level + 2):
                    notes = notes if k == level else notes[::2]
                    if notes:
                        for b, at in enumerate(places):
                            sample = bytes(notes[p % len(notes)] for p in at.tolist())
                            rows.append(i)
                            names.append(f"{k}:{b}:{sample.hex()}")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string())], names=["id", "band"])

    rows = prints.select(F.col(key).alias("id"), "fingerprint").filter("id is not null")
    placed = rows.mapInArrow(bands, f"id {kind}, band string")
    lead = placed.groupBy("band").agg(F.min("id").alias("near_id"), F.count("*").alias("n")).filter("n > 1")
    pairs = placed.join(lead, "band").filter("id <> near_id").select("id", "near_id").distinct()
    both = pairs.join(rows.distinct(), "id").join(rows.distinct().toDF("near_id", "other"), "near_id").select("id", "near_id", "fingerprint", "other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [likeness(read(a), read(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["id", "near_id", "likeness"])

    sure = both.mapInArrow(verify, f"id {kind}, near_id {kind}, likeness double").filter(F.col("likeness") >= near)
    return sure.groupBy(F.col("id").alias(key)).agg(
        F.max_by("near_id", F.struct("likeness", -F.col("near_id"))).alias("near_id"), F.max("likeness").alias("likeness"))

"""Exact removal of long repeated byte strings, by induced sorting of the suffixes that can repeat.

1. Every place where a string of ``LENGTH`` bytes starts has an anchor: the place, among the next
   ``REACHES`` ones, whose 16 bytes have the smallest hash. The anchor depends on the string alone, so equal
   strings have anchors at equal distances. Runs of starts with one anchor make a record; its
   core, the bytes that all its strings share, names the record.
2. Records whose core is found once have no string that repeats. Equal records become one with a count;
   all strings of one that came more than once are repeated. Where a core has a record that came
   once, its distinct records carry their bytes, a few more than ``LENGTH``, to the shard of the core.
3. A shard sorts the suffixes of its records (``induced_sort``). A string is repeated if the suffix that
   starts there has ``LENGTH`` bytes in common with that of another record.
4. A core whose distinct records have more than ``CORE_BYTES`` is no shard's: each of its strings is named by a
   digest, and the digests are counted over the whole cluster.
5. Runs of removed bytes go back to the documents.

Rows of one core meet in one shard, and only distinct records do: a group of copies costs one
record there. A shard is cut at cores, so it has at most ``SHARD_BYTES + CORE_BYTES`` and a record, and is sorted in
memory; the sort's queues would go to disk only beyond that size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.induced_sort import suffix_order
from docweave.llm.words import mix, slices, text_buffer
from docweave.operators.skew import hot_keys, salted_join
from docweave.operators.tables import written

LENGTH = 400
#: Places among which an anchor is chosen, in two steps of half as many for the records.
REACHES = 256
STEP = 128
GRAM = 16
SHARD_BYTES = 2 << 20
#: Cores with more bytes of distinct records are not sorted in one shard.
CORE_BYTES = 2 << 20
SLICE = 2 << 20
_PLACE = np.uint64((1 << 28) - 1)


_LETTER = mix(np.arange(256))


def _records(flat: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: document, first and last start, and where the core begins (all in the slice)."""
    n = len(flat)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    h = _LETTER[flat]
    k = 1
    with np.errstate(over="ignore"):
        while k < GRAM:
            more = h[k:] * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            h[:-k] *= np.uint64(0x9E3779B97F4A7C15)
            h[:-k] += more
            k *= 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
    # rightmost of the smallest: a smaller complement is further right
    best = (h & ~_PLACE) | (_PLACE - np.arange(n, dtype=np.uint64))
    k, other = 1, h
    while k < REACHES:
        np.minimum(best[:-k], best[k:], out=other[:-k])
        other[-k:] = best[-k:]
        best, other = other, best
        k *= 2
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(best[1:], best[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < n]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    doc = np.searchsorted(offsets, first, "right") - 1
    anchor = (_PLACE - (best[first] & _PLACE)).astype(np.int64)
    # only starts whose string ends inside the document
    last = np.minimum(last, offsets[doc + 1] - length)
    # strings of a record start STEP * step to STEP * step + STEP - 1 bytes before the anchor
    parts = [(doc, np.maximum(first, anchor - STEP * step - STEP + 1), np.minimum(last, anchor - STEP * step), anchor - STEP * step)
             for step in range(REACHES // STEP)]
    doc, first, last, core = (np.concatenate(x) for x in zip(*parts))
    some = first <= last
    doc, first, last, core = doc[some], first[some], last[some], core[some]
    order = np.argsort(first, kind="stable")
    return doc[order], first[order], last[order], core[order]


def _cores(documents: DataFrame, kind: str, length: int) -> DataFrame:
    """``(id, mark, core, context, at, starts)`` of all records of ``documents(id, mark, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, offsets = text_buffer(part.column(2))
                doc, first, last, core = _records(flat, offsets, length)
                raw = flat.tobytes()
                size = length - STEP + 1
                names = np.fromiter((xxhash.xxh3_64_intdigest(raw[c:c + size]) for c in core.tolist()), np.uint64, len(core))
                whole = np.fromiter((xxhash.xxh3_64_intdigest(raw[f:e]) for f, e in zip(first.tolist(), (last + length).tolist())), np.uint64, len(core))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(at), part.column(1).take(at), pa.array(names.view(np.int64)),
                    pa.array(whole.view(np.int64)), pa.array((first - offsets[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int16))],
                    names=["id", "mark", "core", "context", "at", "starts"])

    return documents.mapInArrow(run, f"id {kind}, mark bigint, core bigint, context bigint, at int, starts smallint")


def _repeated_starts(contexts: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each record of a shard, which of its strings occur elsewhere too."""
    sizes = np.array([len(c) for c in contexts])
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    begin = np.append(0, np.cumsum(sizes + 1))
    text = joined.astype(np.int64) + 2
    ends = begin[1:] - 1
    text[ends] = 1
    text[ends[-1]] = 0
    order, common = suffix_order(text)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    # a string must end inside its record
    whole = order + length <= begin[owner[order]] + sizes[owner[order]]
    again = np.zeros(len(text), bool)
    long = common >= length
    # neighbours in a run of common prefixes of this length start with the same string
    long &= whole & np.append(False, whole[:-1])
    both = np.flatnonzero(long)
    again[order[both]] = True
    again[order[both - 1]] = True
    out = []
    for i, (b, n) in enumerate(zip(begin.tolist(), sizes.tolist())):
        out.append(np.ones(n - length + 1, bool) if counts[i] > 1 else again[b:b + n - length + 1])
    return out


def _runs(flags: np.ndarray) -> list[int]:
    """Begin and end, in turn, of the runs of true."""
    return np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).tolist()


def _shards(records: DataFrame, length: int) -> DataFrame:
    """``(core, context, repeated)`` of single records among distinct ``records(core, context, bytes, n)``, sorted by core."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def sort() -> pa.RecordBatch:
            flags = _repeated_starts([r[2] for r in held], np.array([r[3] for r in held]), length)
            found = [(r[0], r[1], _runs(f)) for r, f in zip(held, flags) if r[3] == 1 and f.any()]
            return pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.list_(pa.int32()))], names=["core", "context", "repeated"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and row[0] != last:
                    yield sort()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[2]), row[0]
        if held:
            yield sort()

    return records.select("core", "context", "bytes", "n").mapInArrow(
        run, "core bigint, context bigint, repeated array<int>")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """``(core, context, repeated)`` of single records, by counts of all strings of ``contexts(core, context, n, bytes)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a record has at most STEP strings of 16 bytes each
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                rows, places, names = [], [], []
                for i, raw in enumerate(part.column(3).to_pylist()):
                    starts = range(len(raw) - length + 1)
                    rows += [i] * len(starts)
                    places += starts
                    names += [xxhash.xxh3_128_digest(raw[s:s + length]) for s in starts]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in range(3)), pa.array(places, pa.int32()), pa.array(names, pa.binary())],
                    names=["core", "context", "n", "place", "string"])

    strings = written(contexts.mapInArrow(run, "core bigint, context bigint, n bigint, place int, string binary"))
    single = strings.filter("n = 1")
    again = written(strings.groupBy("string").agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") == 1, 1)).alias("n")).filter(
        "total > 1 and n > 0").select("string", "n"))
    found = salted_join(single.select("core", "context", "place", "string"), again.select("string"), "string", hot_keys(again, "string"), "context")
    return found.groupBy("core", "context").agg(
        F.flatten(F.collect_list(F.array(F.col("place"), F.col("place") + 1))).alias("repeated"))


def _contexts(chosen: DataFrame, length: int) -> DataFrame:
    """``(core, context, n, bytes)`` of the records ``chosen`` of each row ``(text, chosen)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, chosen in zip(batch.column(0), batch.column(1)):
                raw, rows = text.as_py().encode(), chosen.as_py()
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([r[c] for r in rows], pa.int64()) for c in ("core", "context", "n")),
                    pa.array([raw[r["at"]:r["at"] + r["starts"] + length - 1] for r in rows], pa.binary())],
                    names=["core", "context", "n", "bytes"])

    return chosen.select("text", "chosen").mapInArrow(run, "core bigint, context bigint, n bigint, bytes binary")


def _settled(rows: DataFrame, kind: str) -> DataFrame:
    """``rows(id, mark, text, found)``; texts without found records are replaced by their size and digest."""
    inner = rows.schema["found"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.asarray(batch.column(3).is_null())
            texts, sizes, digests = [], [], []
            for text, done in zip(batch.column(2).to_pylist(), clean.tolist()):
                raw = (text or "").encode() if done else b""
                texts.append(None if done else text)
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest() if done else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.string())], names=["id", "mark", "text", "found", "n_bytes", "kept_sha256"])

    return rows.mapInArrow(run, f"id {kind}, mark bigint, text string, found {inner}, n_bytes bigint, kept_sha256 string")


def _cut(rows: DataFrame, length: int, kind: str) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, removed, kept_sha256)`` of ``rows(id, text, repeated)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                spans: list[int] = []
                if found:
                    ranges = np.array(found, np.int64).reshape(-1, 2)
                    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
                    ranges[:, 1] += length - 1
                    top = np.maximum.accumulate(ranges[:, 1])
                    fresh = np.append(True, ranges[1:, 0] > top[:-1])
                    heads = np.flatnonzero(fresh)
                    spans = np.stack([ranges[heads, 0], top[np.append(heads[1:], len(ranges)) - 1]], 1).ravel().tolist()
                kept, at = hashlib.sha256(), 0
                for s, e in zip(spans[::2], spans[1::2]):
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                out.append((len(raw), sum(spans[1::2]) - sum(spans[::2]), len(spans) // 2, spans, kept.hexdigest()))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"])

    return rows.select("id", "text", "repeated").mapInArrow(
        run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<bigint>, kept_sha256 string")


def repeated_bytes(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, removed, kept_sha256)`` for every row of ``documents``.

    Removed is each UTF-8 byte inside a string of ``length`` bytes that also starts anywhere else,
    in the same document or another; strings never cross documents, and all are judged on the input.
    ``removed`` lists the runs of removed bytes, begin and end in turn; ``kept_sha256`` is of the rest.

    Null texts are empty; texts of fewer than ``length`` bytes have nothing removed. Repeated rows are copies
    of each other, also with equal or null keys. An empty table gives no rows. Extra columns are not returned.
    """
    if length < REACHES + GRAM:
        raise ValueError(f"strings must have {REACHES + GRAM} bytes at least")
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    cores = _cores(rows, kind, length)
    often = written(cores.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"))
    found = salted_join(cores, often.select("core"), "core", hot_keys(often, "core"), "id").groupBy("id", "mark").agg(
        F.collect_set(F.struct("at", "starts", "core", "context")).alias("found")).withColumnsRenamed({"id": "_id", "mark": "_mark"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    held = written(_settled(rows.join(found, same, "left").select("id", "mark", "text", "found"), kind))
    holders = held.filter("found is not null").select("id", "mark", "text", "found")
    named = holders.select("id", "mark", F.explode("found").alias("r")).select("id", "mark", "r.*")
    records = written(named.groupBy("core", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "mark", "at")).alias("first"), F.first("starts").alias("starts")))
    # a core whose records all came more than once has nothing left to sort
    mixed = written(records.groupBy("core").agg(
        F.min("n").alias("least"), F.count("*").alias("kinds"), F.sum(F.col("starts") + F.lit(length - 1)).alias("size")).filter(
        "least = 1 and kinds > 1").select("core", (F.col("size") > CORE_BYTES).alias("large")))
    # rows with one key and text are equal: their records are taken from one of them
    once = holders.select("id", "mark", "text").dropDuplicates(["id", "mark"])

    def contexts(cores: DataFrame) -> DataFrame:
        chosen = records.join(cores.select("core"), "core").groupBy("first.id", "first.mark").agg(
            F.collect_list(F.struct("core", "context", "n", "first.at", "starts")).alias("chosen")).withColumnsRenamed({"id": "_id", "mark": "_mark"})
        return _contexts(once.join(chosen, same), length)

    sorted_out = _shards(contexts(mixed.filter("not large")).repartition("core").sortWithinPartitions("core"), length)
    large = mixed.filter("large")
    if not large.isEmpty():
        sorted_out = sorted_out.unionByName(_counted(contexts(large), length))
    status = records.filter("n > 1").select("core", "context", F.array(F.lit(0), F.col("starts").cast("int")).alias("repeated")).unionByName(sorted_out)
    spans = named.select("id", "mark", "at", "core", "context").join(status, ["core", "context"]).select(
        "id", "mark", F.transform("repeated", lambda x: x + F.col("at")).alias("repeated")).groupBy("id", "mark").agg(
        F.flatten(F.collect_set("repeated")).alias("repeated")).withColumnsRenamed({"id": "_id", "mark": "_mark"})
    touched = holders.select("id", "mark", "text").join(spans, same, "left")
    clean = held.filter("found is null").select(
        "id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.array().cast("array<bigint>").alias("removed"), "kept_sha256")
    out = _cut(touched.select("id", "text", "repeated"), length, kind).unionByName(clean)
    return out.withColumnRenamed("id", key)

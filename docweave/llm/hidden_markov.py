"""Hidden Markov language model of word sequences, trained by Baum-Welch over the whole corpus.

A text is its lower-cased words and one end token. Every token has a symbol: frequent words
(at least one in ``2 ** COMMON_BITS`` training tokens, so there is a bounded number of them) have
one of ``2 ** COMMON_BITS`` symbols by hash, rare words one of ``2 ** ENDING_BITS`` by their last
letters, unseen words their own. A state emits a symbol, the symbol a word:

    p(word | state) = p(symbol | state) * unigram(word) / unigram(symbol)

with the add-one unigram of the training words. All parameters are therefore a table of bounded
size, whatever the vocabulary, while every probability follows from counts of all training text.

How it runs: texts are packed into chunks of bounded size: word numbers, and the chunk's own
vocabulary as sorted 64-bit hashes. Only vocabularies meet, by ranges of hashes, to add up word
counts and to send them back as arrays. A pass of Baum-Welch runs over the chunks; each task sums its expected counts, which are added up by
symbol. The scaled forward recursion then gives the exact likelihood of every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.words import slices, split_words
from docweave.operators.tables import written

STATES = 8
COMMON_BITS = 16
ENDING_BITS = 12
#: Tokens that even odds are worth in the start and transitions, and the unigram in a state's emissions.
PRIOR = 4.0
EMIT_PRIOR = 1000.0
#: Passes over all training text; before them, ``WARM_PASSES`` over at most ``WARM_TOKENS``
#: tokens set the states apart. The expected counts of these are not kept.
PASSES = 2
WARM_TOKENS = 200_000
WARM_PASSES = 12
CHUNK_BYTES = 8 << 20
#: Words of all chunks that meet in one range of hashes, about.
RANGE_WORDS = 500_000
END = b"\n"
UNSEEN = (1 << COMMON_BITS) + (1 << ENDING_BITS)
SYMBOLS = UNSEEN + 1

def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _pack(documents: DataFrame) -> DataFrame:
    """``documents(id, text, train)`` as chunks; words are in the order of their first occurrence, hashes sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                words, begin = split_words(part.column(1))
                coded = words.dictionary_encode()
                vocabulary = [*coded.dictionary.to_pylist(), END]
                plain = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                # every text gets its end token
                own = np.diff(begin)
                tokens = np.full(len(plain) + len(own), len(vocabulary) - 1, np.int32)
                tokens[np.arange(len(plain)) + np.repeat(np.arange(len(own)), own)] = plain
                train = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                used = np.repeat(train, own + 1)
                seen = np.bincount(tokens[used], minlength=len(vocabulary)).astype(np.int32)
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
                endings = np.fromiter((xxhash.xxh32_intdigest(w[-3:], 7) & ((1 << ENDING_BITS) - 1) for w in vocabulary), np.uint16, len(vocabulary))
                order = np.argsort(hashes).astype(np.int32)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("id", part.schema.field(0).type)])) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([part.column(0)], names=["id"]))
                values = {
                    "chunk": chunk, "ids": sink.getvalue().to_pybytes(), "train": train.tobytes(),
                    "begin": _zip(begin + np.arange(len(begin))), "tokens": _zip(tokens), "place": _zip(order),
                    "hashes": hashes[order].tobytes(), "seen": _zip(seen[order]), "endings": _zip(endings[order]),
                    "n_words": len(vocabulary), "n_train": int(used.sum())}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values.values()], names=list(values))
                chunk += 1

    return documents.select("id", "text", "train").mapInArrow(
        run, "chunk bigint, ids binary, train binary, begin binary, tokens binary, place binary, hashes binary, seen binary, "
             "endings binary, n_words bigint, n_train bigint")


def _symbols(hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
    common = counts >= max(1, total >> COMMON_BITS)
    rare = (1 << COMMON_BITS) + endings.astype(np.int32)
    return np.where(counts == 0, UNSEEN, np.where(common, (hashes & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int32), rare)).astype(np.int32)


def _ranges(chunks: DataFrame, bits: int) -> DataFrame:
    """``(part, chunk, hashes, seen, endings)``: the vocabulary of each chunk by ranges of hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        for batch in batches:
            for row in _rows(batch):
                hashes = np.frombuffer(row["hashes"], np.uint64)
                cut = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
                seen, endings = _unzip(row["seen"], np.int32), _unzip(row["endings"], np.uint16)
                parts = [(k, s, e) for k, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if e > s]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _, _ in parts], pa.int32()), pa.array([row["chunk"]] * len(parts), pa.int64()),
                    *(pa.array([x[s:e].tobytes() for _, s, e in parts], pa.binary()) for x in (hashes, seen, endings))],
                    names=["part", "chunk", "hashes", "seen", "endings"])

    return chunks.select("chunk", "hashes", "seen", "endings").mapInArrow(
        run, "part int, chunk bigint, hashes binary, seen binary, endings binary")


def _counted(ranges: DataFrame, total: int) -> DataFrame:
    """Training counts and symbols of the words of each chunk and range; a row without a chunk sums up the range."""
    def count(table: pa.Table) -> pa.Table:
        raw = {c: table.column(c).to_pylist() for c in ("part", "chunk", "hashes", "seen", "endings")}
        hashes = np.frombuffer(b"".join(raw["hashes"]), np.uint64)
        seen = np.frombuffer(b"".join(raw["seen"]), np.int32)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        sums = np.bincount(inverse, seen).astype(np.int64)
        endings = np.frombuffer(b"".join(raw["endings"]), np.uint16)
        names = _symbols(hashes[first], endings[first], sums, total)
        known = sums > 0
        mass = np.bincount(names[known], sums[known] + 1.0, SYMBOLS)
        at = np.flatnonzero(mass)
        edge = np.append(0, np.cumsum([len(h) // 8 for h in raw["hashes"]])).tolist()
        sums, names = sums[inverse], names[inverse]
        part = raw["part"][0]
        return pa.table({
            "part": pa.array([part] * (len(edge)), pa.int32()), "chunk": pa.array([*raw["chunk"], None], pa.int64()),
            "counts": pa.array([*(_zip(sums[s:e]) for s, e in zip(edge, edge[1:])), at.astype(np.int64).tobytes()], pa.binary()),
            "symbols": pa.array([*(_zip(names[s:e]) for s, e in zip(edge, edge[1:])), mass[at].tobytes()], pa.binary()),
            "words": pa.array([None] * (len(edge) - 1) + [int(known.sum())], pa.int64())})

    return ranges.groupBy("part").applyInArrow(count, "part int, chunk bigint, counts binary, symbols binary, words bigint")


def _mass(counted: DataFrame) -> np.ndarray:
    """Unigram weight of each symbol; the result is bounded by the number of symbols."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(SYMBOLS)
        for batch in batches:
            for row in _rows(batch):
                mass[np.frombuffer(row["counts"], np.int64)] += np.frombuffer(row["symbols"], np.float64)
        at = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mass[at])], names=["symbol", "mass"])

    sums = counted.filter("chunk is null").select("counts", "symbols").mapInArrow(run, "symbol bigint, mass double")
    got = sums.groupBy("symbol").agg(F.sum("mass").alias("mass")).toArrow()
    mass = np.zeros(SYMBOLS)
    mass[got.column("symbol").to_numpy()] = got.column("mass").to_numpy()
    mass[UNSEEN] = 1.0
    return mass


def _joined(chunks: DataFrame, counted: DataFrame) -> DataFrame:
    """Chunks with the symbol and training count of each of their words."""
    back = counted.filter("chunk is not null").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("part", "counts", "symbols"))).alias("all")).select("chunk", "all.counts", "all.symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                place = _unzip(row["place"], np.int32)
                counts, names = np.empty(len(place), np.int64), np.empty(len(place), np.int32)
                counts[place] = np.concatenate([_unzip(x, np.int64) for x in row["counts"]])
                names[place] = np.concatenate([_unzip(x, np.int32) for x in row["symbols"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.binary()) for v in (row["ids"], row["train"], row["begin"], row["tokens"], _zip(names), _zip(counts))],
                    names=["ids", "train", "begin", "tokens", "symbols", "counts"])

    return chunks.select("chunk", "ids", "train", "begin", "tokens", "place").join(back, "chunk").mapInArrow(
        run, "ids binary, train binary, begin binary, tokens binary, symbols binary, counts binary")


@dataclass
class Model:
    """Parameters: start and transition odds, and for each state and symbol p(symbol | state)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _lockstep(begin: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts longest first, and for each step the number of texts that reach it."""
    length = begin[chosen + 1] - begin[chosen]
    order = chosen[np.argsort(-length, kind="stable")]
    length = np.sort(length)[::-1]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    return order, length, active


def _forward(model: Model, symbols: np.ndarray, begin: np.ndarray, chosen: np.ndarray, keep: bool):
    """Scaled forward recursion of many texts side by side: log10 likelihoods and, if kept, all steps."""
    order, length, active = _lockstep(begin, chosen)
    table = np.ascontiguousarray(model.emit.T)
    first = begin[order]
    log = np.zeros(len(order))
    state, steps, scales = np.tile(model.start, (len(order), 1)), [], []
    for t, n in enumerate(active):
        if t:
            state = state[:n] @ model.move
        state = state[:n] * table[symbols[first[:n] + t]]
        scale = state.sum(axis=1)
        state /= scale[:, None]
        log[:n] += np.log10(scale)
        if keep:
            steps.append(state.astype(np.float32))
            scales.append(scale)
    return order, log, active, first, steps, scales


class Counts:
    """Expected counts of a Baum-Welch pass."""

    def __init__(self, states: int):
        self.start = np.zeros(states)
        self.move = np.zeros((states, states))
        self.emit = np.zeros((states, SYMBOLS))
        self.log = 0.0

    def add(self, model: Model, symbols: np.ndarray, begin: np.ndarray, chosen: np.ndarray) -> None:
        # groups of texts of like length keep the steps of the recursion within some tens of megabytes
        chosen = chosen[np.argsort(begin[chosen] - begin[chosen + 1], kind="stable")]
        size = np.cumsum(begin[chosen + 1] - begin[chosen])
        for group in np.split(chosen, np.flatnonzero(np.diff(size // 400_000)) + 1):
            if len(group):
                self._add(model, symbols, begin, group)

    def _add(self, model: Model, symbols: np.ndarray, begin: np.ndarray, chosen: np.ndarray) -> None:
        order, log, active, first, steps, scales = _forward(model, symbols, begin, chosen, True)
        self.log += log.sum()
        table = np.ascontiguousarray(model.emit.T)
        back = np.ones((0, len(model.start)))
        seen, weight = [], []
        for t in range(len(active) - 1, -1, -1):
            n, m = active[t], len(back)
            here = np.ones((n, len(model.start)))
            if m:
                out = table[symbols[first[:m] + t + 1]] * back / scales[t + 1][:m, None]
                here[:m] = out @ model.move.T
                self.move += model.move * (steps[t][:m].T @ out)
            share = steps[t] * here
            seen.append(symbols[first[:n] + t])
            weight.append(share.astype(np.float32))
            back = here
        self.start += share.sum(axis=0)
        seen, weight = np.concatenate(seen), np.concatenate(weight)
        for s in range(len(model.start)):
            self.emit[s] += np.bincount(seen, weight[:, s], minlength=SYMBOLS)


def _maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray, base: np.ndarray) -> Model:
    smooth = lambda x, prior: (x + prior) / (x + prior).sum(axis=-1, keepdims=True)
    # training text has no unseen words: their chance stays that of the unigram in every state
    emit = smooth(emit, EMIT_PRIOR * base)
    emit[:, :UNSEEN] *= ((1 - base[UNSEEN]) / np.maximum(emit[:, :UNSEEN].sum(axis=1), 1e-300))[:, None]
    emit[:, UNSEEN] = base[UNSEEN]
    return Model(smooth(start, PRIOR / len(start)), smooth(move, PRIOR / len(start)), emit)


def _warm(symbols: np.ndarray, begin: np.ndarray, base: np.ndarray, states: int) -> Model:
    """States set apart on a bounded number of tokens, from hashed odds."""
    noise = np.random.default_rng(17)
    emit = base * np.exp(noise.normal(0, 0.5, (states, SYMBOLS)))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    model = Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    for _ in range(WARM_PASSES):
        counts = Counts(states)
        counts.add(model, symbols, begin, np.arange(len(begin) - 1))
        model = _maximise(counts.start, counts.move, counts.emit, base)
    return model


def score_texts(documents: DataFrame, train, key: str = "doc_id", text: str = "text", states: int = STATES,
                passes: int = PASSES) -> DataFrame:
    """``(key, train, n_tokens, n_known, train_tokens, vocabulary, base_score, score)`` for every row.

    ``train`` is a boolean column: the rows whose text the model learns from (null: not). Scores are
    log10 probabilities, under the add-one unigram of the training words and under the hidden
    Markov model. Null and empty texts are one end token. Repeated rows count each for itself.
    Without any training text the unigram has only the unseen word; an empty table gives no rows.
    Extra columns are not returned.
    """
    kind = documents.schema[key].dataType.simpleString()
    chunks = written(_pack(documents.select(
        F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))))
    words, total = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    bits = max(7, math.ceil(math.log2(max(1, words / RANGE_WORDS))))
    counted = written(_counted(_ranges(chunks, bits), total))
    distinct = counted.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    mass = _mass(counted)
    base = mass / float(total + distinct + 1)
    named = written(_joined(chunks, counted))
    model = _warm(*_warm_texts(named), base, states)
    for _ in range(passes):
        model = _pass(named, model, base, states)
    return _scores(named, model, mass, total, distinct, kind).withColumnRenamed("id", key)


def _warm_texts(named: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of at most ``WARM_TOKENS`` training tokens, and where each text begins."""
    rows = named.select("train", "begin", "tokens", "symbols").limit(1).collect()
    taken, left = [], WARM_TOKENS
    for r in rows:
        begin, names = _unzip(r.begin, np.int64), _unzip(r.symbols, np.int32)[_unzip(r.tokens, np.int32)]
        for i in np.flatnonzero(np.frombuffer(r.train, bool)).tolist():
            if left > 0:
                taken.append(names[begin[i]:min(begin[i + 1], begin[i] + min(left, WARM_TOKENS // 20))])
                left -= len(taken[-1])
    return (np.concatenate(taken) if taken else np.zeros(0, np.int32)), np.append(0, np.cumsum([len(x) for x in taken])).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def _pass(named: DataFrame, model: Model, base: np.ndarray, states: int) -> Model:
    """One round of Baum-Welch over all training text."""
    shared = named.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(states)
        for batch in batches:
            for row in _rows(batch):
                begin = _unzip(row["begin"], np.int64)
                symbols = _unzip(row["symbols"], np.int32)[_unzip(row["tokens"], np.int32)]
                counts.add(shared.value, symbols, begin, np.flatnonzero(np.frombuffer(row["train"], bool)))
        at = np.flatnonzero(counts.emit.sum(axis=0))
        kind = np.concatenate([at, SYMBOLS + np.arange(states + 1)])
        value = np.concatenate([counts.emit.T[at], counts.move, counts.start[None]])
        yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.ascontiguousarray(value[:, s])) for s in range(states))],
                                         names=["kind", *(f"s{s}" for s in range(states))])

    ddl = "kind bigint, " + ", ".join(f"s{s} double" for s in range(states))
    rows = named.select("train", "begin", "tokens", "symbols").mapInArrow(expect, ddl).groupBy("kind").agg(
        *(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).toArrow().to_pydict()
    value = np.zeros((SYMBOLS + states + 1, states))
    value[rows["kind"]] = np.stack([rows[f"s{s}"] for s in range(states)], axis=1)
    shared.destroy()
    return _maximise(value[-1], value[SYMBOLS:-1], value[:SYMBOLS].T, base)


def _scores(named: DataFrame, model: Model, mass: np.ndarray, total: int, distinct: int, kind: str) -> DataFrame:
    shared = named.sparkSession.sparkContext.broadcast((model, mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass = shared.value
        for batch in batches:
            for row in _rows(batch):
                begin = _unzip(row["begin"], np.int64)
                local = _unzip(row["tokens"], np.int32)
                counts, names = _unzip(row["counts"], np.int64), _unzip(row["symbols"], np.int32)
                n = len(begin) - 1
                unigram = np.log10((counts + 1) / (total + distinct + 1))
                within = np.log10((counts + 1) / mass[names])
                order, log, *_ = _forward(model, names[local], begin, np.arange(n), False)
                score = np.zeros(n)
                score[order] = log
                add = lambda x: np.add.reduceat(x[local], begin[:-1])
                ids = pa.ipc.open_stream(row["ids"]).read_all().column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.frombuffer(row["train"], bool)), pa.array(np.diff(begin)), pa.array(add((counts > 0).astype(np.int64))),
                    pa.array(np.full(n, total)), pa.array(np.full(n, distinct)), pa.array(add(unigram)), pa.array(score + add(within))],
                    names=["id", "train", "n_tokens", "n_known", "train_tokens", "vocabulary", "base_score", "score"])

    return named.select("ids", "train", "begin", "tokens", "symbols", "counts").mapInArrow(
        run, f"id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, vocabulary bigint, base_score double, score double")

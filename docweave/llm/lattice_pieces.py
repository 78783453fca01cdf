"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

A text gets one blank in front and is cut into units that no piece crosses: a run of blanks with
the word after it, or one character that the model has no piece for (it becomes byte pieces).
The lattice of each distinct unit of a slice is built once. Forward filtering sums the weight of
all segmentations of each beginning; backward sampling then draws the last piece, the one before
it, and so on, which gives whole segmentations in proportion to their weight. Draws follow from a
seed, the row's key and the place in the text, so they do not depend on partitions or order.

Pieces of a byte-pair model have merge ranks instead of probabilities: the weight of a piece is
``(10 + rank) ** -alpha``. A large ``alpha`` comes close to the fewest and commonest pieces, a small one to
even odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.batches import add_columns
from docweave.llm.words import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
SLICE = 1 << 20
BLANK = "▁"


@dataclass
class Pieces:
    """Pieces of a model as tables: by prefix hash for encoding, as bytes for decoding."""

    prefixes: list[np.ndarray]  # sorted hashes of all piece beginnings of 1, 2, ... characters
    ids: list[np.ndarray]  # the piece that such a beginning is, or -1
    weight: np.ndarray  # log weight by piece id
    single: np.ndarray  # by code point: is it a piece?
    first_byte: int
    content: pa.LargeBinaryArray  # bytes of each piece


def _step(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    return mix(h ^ (points.astype(np.uint64) + np.uint64(0x1F123BB5)))


def load_pieces(path: str = MODEL, alpha: float = ALPHA) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    byte = [i for i in range(size) if model.is_byte(i)]
    if len(byte) != 256 or byte != list(range(byte[0], byte[0] + 256)):
        raise ValueError("the model has no byte pieces in order; encoding could lose characters")
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)} | set(byte)
    plain = {i: names[i].replace(BLANK, " ") for i in range(size) if i not in special and names[i]}
    if any(" " in p.lstrip(" ") for p in plain.values()):
        raise ValueError("the model has pieces that cross from a word to a blank")
    single = np.zeros(0x110000, bool)
    for p in plain.values():
        if len(p) == 1:
            single[ord(p)] = True
    usable = {i: p for i, p in plain.items() if all(single[ord(c)] for c in p)}
    longest = max(map(len, usable.values()))
    points = np.zeros((len(usable), longest), np.uint32)
    length = np.array([len(p) for p in usable.values()])
    for row, p in enumerate(usable.values()):
        points[row, :len(p)] = [ord(c) for c in p]
    number = np.array(list(usable))
    prefixes, ids, h = [], [], np.zeros(len(usable), np.uint64)
    for k in range(longest):
        long = length > k
        h[long] = _step(h[long], points[long, k])
        found = np.unique(h[long])
        own = np.full(len(found), -1)
        ends = length == k + 1
        own[np.searchsorted(found, h[ends])] = number[ends]
        prefixes.append(found)
        ids.append(own)
    score = np.array([model.get_score(i) for i in range(size)])
    order = np.argsort(np.argsort(-score[number], kind="stable"))
    weight = np.zeros(size)
    weight[number] = -alpha * np.log(10.0 + order)
    content = [bytes([i - byte[0]]) if i in set(byte) else plain.get(i, "").encode() for i in range(size)]
    return Pieces(prefixes, ids, weight, single, byte[0], pa.array(content, pa.large_binary()))


def _lattice(pieces: Pieces, points: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges of the lattices of units, sorted by the node they end in.

    Unit u has the nodes ``begin[u] + u`` to ``begin[u + 1] + u``. Returns start node, piece and running
    odds of each edge, and for each node its first edge.
    """
    units = len(begin) - 1
    unit = np.repeat(np.arange(units), np.diff(begin))
    stop = begin[1:][unit]
    at, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
    starts, ends, names = [], [], []
    for k, (table, ids) in enumerate(zip(pieces.prefixes, pieces.ids)):
        inside = at + k < stop[at]
        at, h = at[inside], h[inside]
        if not len(at):
            break
        h = _step(h, points[at + k])
        place = np.minimum(np.searchsorted(table, h), len(table) - 1)
        known = table[place] == h
        at, h, piece = at[known], h[known], ids[place[known]]
        is_piece = piece >= 0
        s = at[is_piece]
        starts.append(s + unit[s])
        ends.append(s + unit[s] + k + 1)
        names.append(piece[is_piece])
    start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(names)
    order = np.argsort(end, kind="stable")
    start, end, piece = start[order], end[order], piece[order]
    nodes = len(points) + units
    first = np.searchsorted(end, np.arange(nodes + 1))
    # forward filtering, one position of all units at a time
    depth = np.arange(nodes) - (begin[:-1] + np.arange(units))[np.repeat(np.arange(units), np.diff(begin) + 1)]
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
    total = np.zeros(nodes)
    weight = pieces.weight[piece]
    for p in range(1, len(bounds) - 1):
        here = by_depth[bounds[p]:bounds[p + 1]]
        count = first[here + 1] - first[here]
        lead = np.cumsum(count) - count
        edges = np.arange(count.sum()) - np.repeat(lead, count) + np.repeat(first[here], count)
        total[here] = np.logaddexp.reduceat(total[start[edges]] + weight[edges], lead)
    odds = np.exp(total[start] + weight - total[end])
    return start, piece, np.cumsum(odds), first


def _draw(pieces: Pieces, points: np.ndarray, begin: np.ndarray, units: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A segmentation for each occurrence ``units`` of the distinct units: pieces in order, and their number."""
    start, piece, running, first = _lattice(pieces, points, begin)
    before = np.append(0.0, running)
    order = np.argsort(units, kind="stable")
    root = (begin[:-1] + np.arange(len(begin) - 1))[units[order]]
    node = (begin[1:] + np.arange(len(begin) - 1))[units[order]]
    alive, seed, step = np.arange(len(order)), seeds[order], 0
    number = np.zeros(len(order), np.int64)
    drawn = []
    while len(alive):
        u = (mix(seed[alive] + np.uint64(step)) >> np.uint64(11)).astype(float) / (1 << 53)
        low, high = before[first[node]], before[first[node + 1]]
        edge = np.searchsorted(running, low + u * (high - low), "right")
        edge = np.clip(edge, first[node], first[node + 1] - 1)
        drawn.append((alive, piece[edge].astype(np.int32)))
        number[alive] += 1
        node = start[edge]
        more = node != root[alive]
        alive, node, step = alive[more], node[more], step + 1
    count = np.empty_like(number)
    count[order] = number
    last = np.cumsum(count) - 1
    out = np.empty(int(count.sum()), np.int32)
    for step, (who, what) in enumerate(drawn):
        out[last[order[who]] - step] = what
    return out, count


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __call__(self, column: pa.Array, keys: pa.Array) -> dict[str, pa.Array]:
        texts = column.fill_null("").to_pylist()
        joined = "".join(" " + t if t else "" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        own = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        text_begin = np.append(0, np.cumsum(own))
        known = self.pieces.single[points]
        blank = points == 32
        opens = np.zeros(len(points) + 1, bool)
        opens[text_begin] = True
        opens[1:-1] |= (blank[1:] & ~blank[:-1]) | ~known[1:] | ~known[:-1]
        opens = opens[:len(points)]
        begin = np.append(np.flatnonzero(opens), len(points)) if len(points) else np.zeros(1, np.int64)
        plain = known[begin[:-1]]
        doc = np.searchsorted(text_begin, begin[:-1], "right") - 1
        first_unit = np.searchsorted(begin[:-1], text_begin)
        seed = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        seeds = mix(seed[doc] ^ mix((np.arange(len(doc)) - first_unit[doc]).astype(np.uint64)))
        width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        place = np.append(0, np.cumsum(width))
        names = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(doc), [None, pa.py_buffer(place[begin].astype(np.int64)), pa.py_buffer(joined.encode())])
        count = width[begin[:-1]].astype(np.int64)  # byte pieces of a character without a piece
        ids = np.zeros(0, np.int32)
        if plain.any():
            coded = names.filter(pa.array(plain)).dictionary_encode()
            vocabulary = coded.dictionary.cast(pa.large_string()).to_pylist()
            flat = np.frombuffer("".join(vocabulary).encode("utf-32-le"), np.uint32)
            edge = np.append(0, np.cumsum([len(v) for v in vocabulary]))
            ids, count[plain] = _draw(self.pieces, flat, edge, coded.indices.to_numpy(zero_copy_only=False), seeds[plain])
        total = np.append(0, np.cumsum(count))
        out = np.empty(int(total[-1]), np.int32)
        is_plain = np.repeat(plain, count)
        out[is_plain] = ids
        raw = np.frombuffer(joined.encode(), np.uint8)
        odd = np.flatnonzero(~plain)
        at = np.repeat(place[begin[odd]], count[odd]) + np.arange(count[odd].sum()) - np.repeat(np.cumsum(count[odd]) - count[odd], count[odd])
        out[~is_plain] = raw[at].astype(np.int32) + self.pieces.first_byte
        offsets = total[first_unit].astype(np.int32)
        result = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))
        if column.null_count:
            result = pa.array([None if not v else r for v, r in zip(column.is_valid().to_pylist(), result.to_pylist())], pa.list_(pa.int32()))
        return {"piece_ids": result}


def decode_ids(pieces: Pieces, column: pa.ListArray) -> pa.Array:
    """Texts of lists of piece ids; null lists stay null."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = pieces.content.take(column.values.slice(offsets[0], offsets[-1] - offsets[0]))
    place = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) and flat.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[place[0]:place[-1]]
    at = place[offsets - offsets[0]] - place[0]
    keep = np.ones(len(data), bool)
    starts = at[:-1][at[1:] > at[:-1]]
    keep[starts] = False  # the blank in front
    moved = np.append(0, np.cumsum(keep))[at]
    out = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(data[keep]))
    return pa.compute.if_else(column.is_valid(), out, pa.scalar(None, pa.large_string())) if column.null_count else out


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0, model: str = MODEL,
           alpha: float = ALPHA, check: bool = False) -> DataFrame:
    """``documents`` with ``piece_ids``, a sampled segmentation of each whole text.

    Equal keys with equal texts get equal segmentations for one ``seed``; a null key is one key.
    A null text has null pieces, an empty one none. With ``check``, the pieces are decoded again
    and ``lossless`` tells whether the text came back. Extra columns pass through; those with the
    name of an added one are replaced.
    """
    pieces = load_pieces(model, alpha)
    encoder = Encoder(pieces)

    def run(column: pa.Array, keys: pa.Array) -> dict[str, pa.Array]:
        got = encoder(column, keys)
        if check:
            back = decode_ids(pieces, got["piece_ids"])
            same = pa.compute.equal(back, column.cast(pa.large_string()))
            got["lossless"] = pa.compute.fill_null(same, True)
        return got

    keyed = documents.withColumn("_row_seed", F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    ddl = "piece_ids array<int>" + (", lossless boolean" if check else "")
    return add_columns(keyed, text, ddl, run, drop=("_row_seed",), limit=SLICE, also=("_row_seed",))


def decode(encoded: DataFrame, ids: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of the pieces in column ``ids``."""
    pieces = load_pieces(model)
    # the number of pieces bounds a slice as well as the bytes of a text would
    spelled = encoded.withColumn("_length", F.repeat(F.lit(" "), F.coalesce(F.size(ids), F.lit(0))))
    return add_columns(spelled, "_length", "decoded string",
                       lambda _, column: {"decoded": decode_ids(pieces, column)}, drop=("_length",), limit=SLICE, also=(ids,))

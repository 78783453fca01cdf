"""Word splitting of Arrow text columns on raw UTF-8 bytes, shared by the operators of this package.

Only the letters A-Z are lower-cased. Bytes of 128 and above always belong to a word, so a
character outside ASCII is never cut. Work is done per Arrow batch; a batch is cut into
slices of bounded size first, so that memory follows the slice and not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20

_BYTE = np.arange(256)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: Everything but blank and the control characters 9 to 13.
NOT_SPACE = ~np.isin(_BYTE, [32, 9, 10, 11, 12, 13])
#: Digits, letters and everything outside ASCII.
ALNUM = (_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (
    (_BYTE >= 65) & (_BYTE <= 90))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and the offset of each text (nulls are empty)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def split_words(column: pa.Array, kind: np.ndarray = NOT_SPACE) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All lower-cased words of a text column in order, and where each text's words begin.

    ``kind`` tells for each byte whether it belongs to a word.
    """
    flat, offsets = text_buffer(column)
    flat = LOWER[flat]
    inside = kind[flat]
    # a word starts at a word byte after another byte, or at the start of a text
    before = np.zeros(len(flat) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    packed = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(inside, out=packed[1:])
    word_offsets = np.append(packed[starts], packed[-1])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(word_offsets), pa.py_buffer(flat[inside])])
    return words, np.searchsorted(starts, offsets)


def hash64(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte string of an Arrow column (nulls not allowed)."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

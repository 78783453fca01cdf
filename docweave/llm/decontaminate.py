"""Removing documents that hold passages of a benchmark: suffix arrays of the training text.

Every slice of documents is a shard. Its words become numbers of the benchmark's vocabulary
(0: not in it), and only suffixes that begin with enough benchmark words to match at all enter
the shard's suffix array, so the array grows with the suspicious text and not with the corpus.
Each test suffix is looked up by two binary searches, which bound all its occurrences.

The benchmark is read in blocks of ``block_bytes`` of text; a block is what a task holds. Hits
of several blocks meet again in one row per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.batches import add_columns
from docweave.llm.words import ALNUM, split_words

WINDOW = 13
#: A document is contaminated if at least one word in so many is inside an occurrence.
ONE_IN = 20
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 4 << 20

RESULT = ("n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>, "
          "longest_match bigint, longest_item string, longest_at bigint, spans array<bigint>")


class Windows:
    """The windows of a block of benchmark items, as keys for binary search.

    ``keys`` holds each distinct window once: its word numbers, big-endian, padded with zeros.
    ``owner`` and ``start`` list the items and places of window w at ``first[w]:first[w + 1]``.
    """

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        words, begin = split_words(pa.array(texts, pa.string()), ALNUM)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.ids = ids
        rows, length, owner, start = [], [], [], []
        for i in range(len(ids)):
            own = numbers[begin[i]:begin[i + 1]]
            k = min(window, len(own))
            if not k:
                continue
            view = np.zeros((len(own) - k + 1, window), ">u4")
            view[:, :k] = np.lib.stride_tricks.sliding_window_view(own, k)
            rows.append(view)
            length.append(np.full(len(view), k))
            owner.append(np.full(len(view), i))
            start.append(np.arange(len(view)))
        self.window, self.width = window, 4 * window
        if not rows:
            self.keys, self.shortest = np.zeros(0, f"S{self.width}"), 0
            return
        flat = np.ascontiguousarray(np.concatenate(rows), ">u4").view(f"S{self.width}").ravel()
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.length = np.concatenate(length)[order][self.first[:-1]]
        self.owner, self.start = np.concatenate(owner)[order], np.concatenate(start)[order]
        self.shortest = int(self.length.min())
        upper = np.zeros((len(self.keys), self.width), np.uint8)
        upper[:] = np.frombuffer(self.keys.tobytes(), np.uint8).reshape(len(self.keys), self.width)
        upper[np.arange(self.width) >= 4 * self.length[:, None]] = 255
        self.upper = upper.view(f"S{self.width}").ravel()

    def search(self, column: pa.Array) -> dict[str, list]:
        words, begin = split_words(column, ALNUM)
        n_docs, n = len(column), len(words)
        out = {"n_words": np.diff(begin), "n_hit": np.zeros(n_docs, np.int64), "n_items": np.zeros(n_docs, np.int64),
               "item_ids": [[]] * n_docs, "longest_match": np.zeros(n_docs, np.int64), "longest_item": [None] * n_docs,
               "longest_at": [None] * n_docs, "spans": [[]] * n_docs}
        at, which = self._occurrences(words, begin, n)
        if len(at):
            self._report(out, at, which, begin, n)
        return {k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in out.items()}

    def _occurrences(self, words: pa.Array, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard where a window occurs, and the window."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not n or not len(self.keys):
            return none
        coded = words.dictionary_encode()
        known = pa.compute.index_in(coded.dictionary, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False) + 1
        numbers = known[coded.indices.to_numpy(zero_copy_only=False)].astype(">u4")
        # words from each place on that are in the vocabulary, up to the document's end
        ends = np.zeros(n, bool)
        stop = begin[1:][begin[1:] > begin[:-1]] - 1
        ends[stop] = True
        cut = np.flatnonzero(ends | (numbers == 0))
        limit = cut[np.searchsorted(cut, np.arange(n))]
        run = limit - np.arange(n) + (numbers[limit] != 0)
        suffix = np.flatnonzero(run >= self.shortest)
        if not len(suffix):
            return none
        padded = np.append(numbers, np.zeros(self.window, ">u4"))
        rows = padded[suffix[:, None] + np.arange(self.window)]
        rows[np.arange(self.window) >= run[suffix][:, None]] = 0
        rows = np.ascontiguousarray(rows, ">u4").view(f"S{self.width}").ravel()
        order = np.argsort(rows)
        array = rows[order]
        low = np.searchsorted(array, self.keys, "left")
        high = np.searchsorted(array, self.upper, "right")
        count = high - low
        which = np.repeat(np.arange(len(self.keys)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return suffix[order[place]], which

    def _report(self, out: dict, at: np.ndarray, which: np.ndarray, begin: np.ndarray, n: int) -> None:
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.length[which], -1)
        hit = np.cumsum(cover[:-1]) > 0
        total = np.append(0, np.cumsum(hit))
        out["n_hit"] = total[begin[1:]] - total[begin[:-1]]
        # a longest match is a run of windows of one item at one distance
        times = self.first[which + 1] - self.first[which]
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[which], times)
        place, item, start = np.repeat(at, times), self.owner[entry], self.start[entry]
        doc = np.searchsorted(begin, place, "right") - 1
        order = np.lexsort((place, place - start, item, doc))
        place, item, start, doc = place[order], item[order], start[order], doc[order]
        length = np.repeat(self.length[which], times)[order]
        new = np.ones(len(place), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(place - start) != 0) | (np.diff(place) != 1)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(place))) - 1 + length[head]
        best = np.lexsort((place[head], item[head], -size, doc[head]))
        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
        runs = np.stack([edge[::2], edge[1::2]], 1)
        # a run of hit words may touch the next document's first one
        for d in np.unique(doc).tolist():
            items = np.unique(item[np.searchsorted(doc, d):np.searchsorted(doc, d, "right")])
            ids = sorted({self.ids[i] for i in items if self.ids[i] is not None})
            out["item_ids"][d], out["n_items"][d] = ids, len(ids)
            own = runs[(runs[:, 1] > begin[d]) & (runs[:, 0] < begin[d + 1])]
            out["spans"][d] = (np.clip(own, begin[d], begin[d + 1]) - begin[d]).ravel().tolist()
        d, index = np.unique(doc[head[best]], return_index=True)
        for d, h in zip(d, best[index], strict=True):
            out["longest_match"][d] = size[h]
            out["longest_item"][d] = self.ids[item[head[h]]]
            out["longest_at"][d] = int(place[head[h]] - begin[d])


def _blocks(benchmark: DataFrame, key: str, text: str, limit: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        if ids and size + len(row.t or "") > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.k)
        texts.append(row.t)
        size += len(row.t or "")
    yield ids, texts


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, one_in: int = ONE_IN, drop: tuple[str, ...] = (),
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with what each shares with the benchmark.

    A window is ``window`` consecutive words of an item, or all of a shorter one. Added columns:
    ``n_words``; ``n_hit``, the words inside any occurrence of a window; ``n_items`` and
    ``item_ids``, the items with an occurring window; ``longest_match``, ``longest_item`` and
    ``longest_at``, the longest verbatim match in words, its item and its first word;
    ``spans``, the runs of hit words as begin and end in turn; ``contaminated``.

    Null and empty texts have no words and are clean. Items without words never match, items
    without an id count as hits but not in ``item_ids``, and equal ids count once. Repeated
    documents are judged each for themselves. An empty benchmark contaminates nothing. Extra
    columns pass through; one that has the name of an added column is replaced.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    out = add_columns(documents, text, RESULT, Windows(*next(blocks), window).search, limit=SHARD_BYTES)
    for ids, texts in blocks:
        out = _merged(out, text, Windows(ids, texts, window).search)
    return out.drop(*drop).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def _merged(out: DataFrame, text: str, search) -> DataFrame:
    """One more block: its hits join those that the row has."""
    names = ["n_hit", "n_items", "item_ids", "longest_match", "longest_item", "longest_at", "spans"]
    out = out.withColumnsRenamed({c: f"_had_{c}" for c in names})
    out = add_columns(out, text, RESULT, search, limit=SHARD_BYTES)
    longer = F.col("longest_match") > F.col("_had_longest_match")
    ids = F.array_sort(F.array_union("item_ids", "_had_item_ids"))
    both = F.concat("spans", "_had_spans")
    pairs = F.array_sort(F.transform(
        F.sequence(F.lit(0), (F.size(both) / 2).cast("int") - 1), lambda i: F.struct(both[i * 2].alias("b"), both[i * 2 + 1].alias("e"))))
    pairs = F.when(F.size(both) > 0, pairs)
    start = F.array().cast("array<bigint>")
    spans = F.coalesce(F.aggregate(pairs, start, lambda acc, p: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1) >= p["b"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), p["e"]))),
    ).otherwise(F.concat(acc, F.array(p["b"], p["e"])))), start)
    out = out.withColumns({
        "item_ids": ids, "n_items": F.size(ids).cast("bigint"), "spans": spans,
        "longest_item": F.when(longer, F.col("longest_item")).otherwise(F.col("_had_longest_item")),
        "longest_at": F.when(longer, F.col("longest_at")).otherwise(F.col("_had_longest_at")),
        "longest_match": F.greatest("longest_match", "_had_longest_match")})
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.withColumn("n_hit", hit).drop(*(f"_had_{c}" for c in names))


def clean_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever these are called."""
    clash = {c: f"_own_{c}" for c in documents.columns if re.search(rf"\b{re.escape(c)}\b", RESULT + " contaminated")}
    judged = contamination(documents.withColumnsRenamed(clash), benchmark, **options)
    return judged.filter(~F.col("contaminated")).select(*(F.col(clash.get(c, c)).alias(c) for c in documents.columns))

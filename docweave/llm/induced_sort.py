"""Suffix order and common prefixes of a shard by external induced sorting.

Suffixes that are larger than the one before a smaller neighbour (S*) are sorted first: their
substrings get names in order, and the string of names, several times shorter, is sorted by the
same procedure while there are few names, and by doubling the length of sorted beginnings where there
are many. All other suffixes follow by induction: a suffix that is popped from the queue, together with the letter before
it, pushes the suffix that starts one letter earlier. Queues are monotone: a tuple's priority is
its first letter, then its arrival, so each letter has a run of blocks that are appended at one end and
read from the other. Blocks beyond ``memory`` bytes lie on disk until their letter comes up.

A tuple holds the suffix and the length it has in common with the one before it in order. When a
pair of suffixes pushes a pair into one queue, that length is one more than the smallest common
prefix between the two in popping order.

Letters are popped a block at a time, so the work runs in array operations. A queue per letter pays
for alphabets of up to ``LETTERS``; each of many names would have a queue of few tuples.

Suffixes are told apart by their first ``REACH`` letters at least; order and common prefixes beyond
that are not defined.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 64 << 20
REACH = 512
LETTERS = 512


class BlockQueues:
    """One first-in-first-out queue of (suffix, common prefix) blocks for each letter."""

    def __init__(self, letters: int, memory: int):
        self.blocks: list[list] = [[] for _ in range(letters)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, letters: np.ndarray, edges: np.ndarray, suffix: np.ndarray, common: np.ndarray) -> None:
        """Append to the queue of ``letters[k]`` the tuples from ``edges[k]`` to ``edges[k + 1]``."""
        block = np.stack([suffix, common])
        kept = self.held + block.nbytes <= self.memory
        at = 0
        if not kept:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(block.T.tobytes())
        ends = edges.tolist()
        for letter, s, e in zip(letters.tolist(), ends, ends[1:]):
            if kept:
                self.blocks[letter].append(block[:, s:e].copy())
                self.held += 16 * (e - s)
            else:
                self.blocks[letter].append((at + 16 * s, e - s))

    def pop(self, letter: int):
        """What a letter's queue holds, in order, in large blocks; more may arrive meanwhile."""
        queue = self.blocks[letter]
        while queue:
            taken, size = [], 0
            while len(taken) < len(queue) and size < self.memory:
                block = queue[len(taken)]
                if isinstance(block, tuple):
                    self.file.seek(block[0])
                    block = np.frombuffer(self.file.read(16 * block[1]), np.int64).reshape(-1, 2).T
                else:
                    self.held -= block.nbytes
                taken.append(block)
                size += block.nbytes
            del queue[:len(taken)]
            both = taken[0] if len(taken) == 1 else np.concatenate(taken, axis=1)
            yield both[0], both[1]


def _runs(text: np.ndarray) -> np.ndarray:
    """For each place, how many equal letters start there."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(text)) + 1


def _push(queues: BlockQueues, text: np.ndarray, suffix: np.ndarray, common: np.ndarray, wanted: np.ndarray,
          since: np.ndarray | None) -> None:
    """Push what a popped block induces, by letter in popping order.

    ``since`` holds, per letter, the smallest common prefix popped after the last push to it; without it
    common prefixes are not followed.
    """
    at = np.flatnonzero(wanted)
    if len(at):
        before = suffix[at] - 1
        letter = text[before]
        order = np.argsort(letter.astype(np.uint16), kind="stable")  # letters are few
        at, before, letter = at[order], before[order], letter[order]
        first = np.ones(len(at), bool)
        first[1:] = letter[1:] != letter[:-1]
        heads = np.flatnonzero(first)
        edges = np.append(heads, len(at))
    smallest = None
    if since is not None:
        if len(at):
            start = np.where(first, 0, np.append(0, at[:-1]) + 1)
            padded = np.append(common, np.iinfo(np.int64).max)
            smallest = np.minimum.reduceat(padded, np.stack([start, at + 1], 1).ravel())[::2]
            smallest[heads] = np.minimum(smallest[heads], since[letter[heads]])
            after = np.minimum.accumulate(padded[::-1])[::-1][at[edges[1:] - 1] + 1]
        np.minimum(since, int(common.min()), out=since)
        if len(at):
            since[letter[heads]] = after
    if len(at):
        queues.push(letter[heads], edges, before, before if smallest is None else smallest + 1)


def _induce(text: np.ndarray, stars: np.ndarray, common: np.ndarray | None, letters: int, memory: int):
    """All suffixes in order, from the ordered S* suffixes; with their common prefixes if those of the S* are given."""
    follow = common is not None
    common = common if follow else np.zeros(len(stars), np.int64)
    runs = _runs(text)
    far = np.iinfo(np.int64).max
    star_edge = np.searchsorted(text[stars], np.arange(letters + 1))
    # larger-type suffixes, smallest letter first
    queues, since = BlockQueues(letters, memory), np.full(letters, far) if follow else None
    large: list[list] = [[] for _ in range(letters)]
    for c in range(letters):
        last = None
        for s, p in queues.pop(c):
            p = p.copy()
            if last is None:
                p[0] = 0
            large[c].append((s, p))
            last = s[-1]
            _push(queues, text, s, p, (s > 0) & (text[s - 1] >= c), since)
        s = stars[star_edge[c]:star_edge[c + 1]]
        if len(s):
            p = common[star_edge[c]:star_edge[c + 1]].copy()
            p[0] = 0 if last is None else min(runs[last], runs[s[0]])
            _push(queues, text, s, p, s > 0, since)
    # smaller-type suffixes, largest letter first; common prefixes now belong to the pair with the next larger
    queues, since = BlockQueues(letters, memory), np.full(letters, far) if follow else None
    parts = []
    for c in range(letters - 1, -1, -1):
        last = None
        for s, p in queues.pop(c):
            p = p.copy()
            if last is None:
                p[0] = 0
            parts.append((s, p))
            last = s[-1]
            _push(queues, text, s, p, (s > 0) & (text[s - 1] <= c), since)
        if large[c]:
            s = np.concatenate([x for x, _ in large[c]])[::-1]
            p = np.concatenate([x for _, x in large[c]])
            p = np.append(0 if last is None else min(runs[last], runs[s[0]]), p[1:][::-1])
            parts.append((s, p))
            _push(queues, text, s, p, (s > 0) & (text[s - 1] < c), since)
            large[c] = []
        elif c == 0 and last is None:
            parts.append((stars[:1], np.zeros(1, np.int64)))
    order = np.concatenate([s for s, _ in parts])[::-1]
    # from "with the next larger" to "with the one before"
    down = np.concatenate([p for _, p in parts])
    return order, np.append(0, down[1:][::-1])


def _hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all beginnings, and powers, for comparing substrings (modulo 2 ** 64, odd multiplier, scrambled letters)."""
    from docweave.llm.words import mix

    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(text)
    power = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        # inverse powers turn the recurrence into a sum
        inverse = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(mix(text.astype(np.uint64)) * inverse[1:], dtype=np.uint64))
    return sums, power


def _same(sums: np.ndarray, power: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (sums[a + length] - sums[a]) * power[a]
        y = (sums[b + length] - sums[b]) * power[b]
    return x == y


def _common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before, up to ``REACH``."""
    sums, power = _hashes(text)
    n = len(text)
    a, b = order[:-1], order[1:]
    limit = np.minimum(np.minimum(n - a, n - b), REACH)
    got = np.zeros(len(a), np.int64)
    step = REACH
    while step:
        longer = got + step
        fits = longer <= limit
        good = fits & _same(sums, power, a, b, np.where(fits, longer, 0))
        got[good] += step
        step //= 2
    return np.append(0, got)


def _types(text: np.ndarray) -> np.ndarray:
    """The S* suffixes by place."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    rising = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
    small = np.repeat(rising, np.diff(ends, prepend=-1))
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def suffix_order(text: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order, and what each has in common with the one before.

    ``text`` holds numbers from 0 up; its last one is 0 and the only 0.
    """
    order = _sorted_stars(text, memory)
    return _induce(text, order, _common_prefixes(text, order), int(text.max()) + 1, memory)


def _sorted_stars(text: np.ndarray, memory: int) -> np.ndarray:
    """The S* suffixes of ``text`` in order."""
    stars = _types(text)
    if len(stars) < 2:
        return stars if len(stars) else np.array([len(text) - 1])
    # order by substrings: induction from S* suffixes that are sorted by letter only
    start = stars[np.argsort(text[stars].astype(np.uint16), kind="stable")]
    everything, _ = _induce(text, start, None, int(text.max()) + 1, memory)
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    ordered = everything[is_star[everything]]
    length = np.zeros(len(text), np.int64)
    length[stars] = np.append(np.diff(stars) + 1, 1)
    sums, power = _hashes(text)
    a, b = ordered[:-1], ordered[1:]
    equal = length[a] == length[b]
    equal &= _same(sums, power, a, b, np.where(equal, length[a], 0))
    name = np.append(0, np.cumsum(~equal))
    if name[-1] + 1 == len(stars):
        return ordered
    named = np.zeros(len(text), np.int64)
    named[ordered] = name
    reduced = named[stars]  # the last is 0 and the only 0
    if name[-1] < LETTERS:
        inner = _sorted_stars(reduced, memory)
        return stars[_induce(reduced, inner, None, int(name[-1]) + 1, memory)[0]]
    return stars[_doubled(reduced)]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``REACH`` names."""
    rank, k = names, 1
    while True:
        if k >= REACH or rank.max() + 1 == len(rank):
            return np.argsort(rank)
        then = np.zeros(len(rank), np.int64)
        then[:-k] = rank[k:] + 1
        pair = rank * (len(rank) + 1) + then
        order = np.argsort(pair)
        pair = pair[order]
        new = np.append(0, np.cumsum(pair[1:] != pair[:-1]))
        rank = np.empty_like(new)
        rank[order] = new
        k *= 2

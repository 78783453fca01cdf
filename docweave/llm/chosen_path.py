"""Near-duplicate documents by a chosen-path similarity join on sets of word shingles.

Equal sets are one set from the start. Every distinct set is carried by a signature of minwise
tokens. In each of ``TREES`` independent trees a set walks down a path: the node it is in
picks, by its own hash, the minwise token that decides the child. Two sets of similarity s stay
together for ``STEP`` levels with chance s ** STEP; at 0.8 all trees lose a pair about three times in
100,000.

1. In the first few trees every member of a node is compared with one member drawn at random (a star). Links
   confirmed on the full sets join the members of a family, however large, with one row per member and tree.
2. In all trees, only nodes are looked at whose members are not one class yet, so a family costs nothing more in the trees that
   follow. Small nodes compare all members of different classes, exhaustively. A large node that is mostly one family
   would not get smaller by branching: there, those outside the family are compared with all in blocks
   of bounded size, once for all trees.
3. Other large nodes branch on. Each is continued ``BRANCHES`` times, by different tokens, so that a pair which
   met in a node meets again below in one of them: over all trees, a pair at 0.8 is lost less than once in 100,000 there. Members of
   nodes that are still large after the last look are compared in blocks.

Signatures only select; each link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.components import components
from docweave.llm.words import mix, slices, split_words
from docweave.operators.tables import written

TOKENS = 64
TREES = 32
#: Levels that are walked before nodes are looked at, and between two looks.
STEP = 4
LOOKS = 2
#: Trees of the first stars; continuations of a large node.
OPENING = 8
BRANCHES = 4
#: Nodes of up to so many sets are compared exhaustively.
SMALL = 24
#: Pairs need this share of equal minwise tokens to be confirmed on full sets: at similarity
#: 0.8 that is five standard deviations below what is expected.
AGREE = 0.55
BLOCK = 512
#: Bytes of text that are shingled at once: hashing takes some thirty times as much.
SLICE = 2 << 20
SEED = np.uint64(0x5851F42D4C957F2D)


def shingle_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, and where each text's begin.

    A text of fewer words has its whole sequence as its one shingle.
    """
    words, begin = split_words(column)
    coded = words.dictionary_encode()
    import xxhash

    names = np.fromiter((xxhash.xxh64_intdigest(v) for v in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = names[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    n = np.diff(begin)
    rolled = mix(h)
    for k in range(1, min(size, len(h))):
        rolled[:-k] = mix(rolled[:-k] ^ (h[k:] + np.uint64(k)))
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - begin[doc]
    keep = place <= n[doc] - size
    for d in np.flatnonzero((n > 0) & (n < size)):
        x = mix(h[begin[d]:begin[d] + 1])
        for k in range(1, n[d]):
            x = mix(x ^ (h[begin[d] + k] + np.uint64(k)))
        keep[begin[d]], rolled[begin[d]] = True, mix(x ^ np.uint64(n[d]))[0]
    rolled, doc = rolled[keep], doc[keep]
    order = np.lexsort((rolled, doc))
    rolled, doc = rolled[order], doc[order]
    first = np.ones(len(rolled), bool)
    first[1:] = (rolled[1:] != rolled[:-1]) | (doc[1:] != doc[:-1])
    rolled, doc = rolled[first], doc[first]
    return rolled, np.searchsorted(doc, np.arange(len(n) + 1))


def _signatures(items: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``TOKENS`` minwise tokens of each (non-empty) set."""
    out = np.zeros((len(begin) - 1, TOKENS), np.uint32)
    if len(items):
        for t in range(TOKENS):
            with np.errstate(over="ignore"):
                x = items * (mix(np.uint64(2 * t + 1)) | np.uint64(1))
                x ^= x >> np.uint64(32)
                x *= SEED
            out[:, t] = (np.minimum.reduceat(x, begin[:-1]) >> np.uint64(32)).astype(np.uint32)
    return out


def _digests(items: np.ndarray, begin: np.ndarray) -> list[bytes]:
    import xxhash

    raw, at = items.tobytes(), (begin * 8).tolist()
    return [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(at, at[1:])]


def _sets(documents: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``(id, n, set, signature)``: set size, digest of the set and its minwise tokens (null if empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                items, begin = shingle_hashes(part.column(1), size)
                n = np.diff(begin)
                full = np.flatnonzero(n > 0)
                sets, tokens = [None] * len(n), [None] * len(n)
                at = np.append(begin[full], len(items))
                for d, s, t in zip(full.tolist(), _digests(items, at), _signatures(items, at)):
                    sets[d], tokens[d] = s, t.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(tokens, pa.binary())],
                    names=["id", "n", "set", "signature"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n bigint, set binary, signature binary")


def _items(documents: DataFrame, kind: str, size: int) -> DataFrame:
    """``(id, items)`` from ``documents(id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                items, begin = shingle_hashes(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(
                    pa.array(begin, pa.int32()), pa.array(items.view(np.int64)))], names=["id", "items"])

    return documents.mapInArrow(run, f"id {kind}, items array<bigint>")


def _walk(tokens: np.ndarray, path: np.ndarray) -> np.ndarray:
    """``STEP`` levels down: the node's hash chooses a token, the token the child."""
    row = np.arange(len(tokens))
    for _ in range(STEP):
        chosen = (mix(path ^ SEED) % np.uint64(TOKENS)).astype(np.int64)
        path = mix(path ^ (tokens[row, chosen].astype(np.uint64) + (chosen.astype(np.uint64) << np.uint64(33))))
    return path


def _descend(sets: DataFrame, kind: str, start: bool) -> DataFrame:
    """``(id, path, opening)``: the nodes of ``sets(id, signature[, path])`` ``STEP`` levels further down.

    From the roots of all trees, or from each path ``BRANCHES`` times.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
            above = None if start else batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, salt in enumerate(mix(np.arange(1, (TREES if start else BRANCHES) + 1, dtype=np.uint64))):
                path = _walk(flat, np.full(len(flat), salt) if start else mix(above ^ salt))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(path.view(np.int64)), pa.array(np.full(len(path), start and k < OPENING))],
                    names=["id", "path", "opening"])

    return sets.mapInArrow(run, f"id {kind}, path bigint, opening boolean")


def _nodes(members: DataFrame) -> DataFrame:
    """``(id, path, opening, size, pivot)`` of the nodes with company; the pivot is drawn by a hash of node and id."""
    drawn = written(members.groupBy("path").agg(
        F.count("*").alias("size"), F.min(F.struct(F.xxhash64("path", "id").alias("h"), "id"))["id"].alias("pivot")).filter("size > 1"))
    return written(members.join(drawn, "path"))


def _placed(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``(id, path, class, size, most, family)`` of the nodes that hold more than one class.

    ``family`` is the class with the ``most`` members of a node, ids without a link are their own class.
    """
    placed = nodes.select("id", "path", "size").join(classes, "id", "left").select(
        "id", "path", "size", F.coalesce("component", "id").alias("class"))
    held = written(placed.groupBy("path", "class").agg(F.count("*").alias("n")).groupBy("path").agg(
        F.max_by("class", F.struct("n", "class")).alias("family"), F.max("n").alias("most"), F.count("*").alias("classes")).filter(
        "classes > 1").drop("classes"))
    return written(placed.join(held, "path"))


def _agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """``(a, b, agree)``: distinct pairs and the share of their equal minwise tokens, if high enough."""
    ids = signatures.select("id", "signature")
    both = (pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            .join(ids.toDF("a", "sig_a"), "a").join(ids.toDF("b", "sig_b"), "b"))
    fields = both.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(fields.fieldNames().index(c)).to_pylist()), np.uint32).reshape(-1, TOKENS)
                    for c in ("sig_a", "sig_b"))
            share = (x == y).mean(axis=1)
            keep = pa.array(share >= AGREE)
            at = [batch.column(fields.fieldNames().index(c)).filter(keep) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*at, pa.array(share).filter(keep)], names=["a", "b", "agree"])

    kind = fields["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}, agree double")


def _confirmed(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    common = F.size(F.array_intersect("items_a", "items_b"))
    return (
        pairs.join(items.toDF("a", "items_a"), "a").join(items.toDF("b", "items_b"), "b")
        .withColumn("common", common)
        .filter(100 * F.col("common") >= percent * (F.size("items_a") + F.size("items_b") - F.col("common")))
        .select("a", "b")
    )


def _spanning(items: list[np.ndarray], inner: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links between rows of a block that join all rows which links join at all.

    Only pairs with an ``inner`` row on one side are looked at.
    """
    size = np.array([len(x) for x in items])
    flat = np.concatenate(items)
    _, code = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(items)), size)
    common = np.zeros((int(inner.sum()), len(items)), np.float32)
    own = np.flatnonzero(inner)
    for low in range(0, int(code.max()) + 1, 4096):
        inside = (code >= low) & (code < low + 4096)
        table = np.zeros((len(items), 4096), np.float32)
        table[row[inside], code[inside] - low] = 1
        common += table[own] @ table.T
    link = 100 * common >= percent * (size[own][:, None] + size[None, :] - common)
    parent = list(range(len(items)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, j in zip(*np.nonzero(link)):
        a, b = top(int(own[i])), top(int(j))
        if a != b:
            parent[a] = b
            found.append((int(own[i]), int(j)))
    return found


def _block_links(groups: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Links in ``groups(group, id, outside)``: every outside member against all members.

    Outside members and all members lie in blocks of about ``BLOCK``; a task sees one block of each.
    """
    sizes = groups.groupBy("group").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count(F.when(F.col("outside"), 1)) / BLOCK).cast("int").alias("outer_blocks"))
    placed = groups.join(sizes, "group").withColumn("own", F.xxhash64("id"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = placed.filter("outside").select(
        "group", "id", F.lit(True).alias("inner"), F.pmod("own", "outer_blocks").cast("int").alias("i"), every("blocks").alias("j"))
    members = placed.select(
        "group", "id", F.lit(False).alias("inner"), every("outer_blocks").alias("i"), F.pmod("own", "blocks").cast("int").alias("j"))
    rows = outer.unionByName(members).join(items, "id")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        sets = [np.asarray(x, np.int64) for x in table.column("items").to_pylist()]
        found = _spanning(sets, table.column("inner").to_numpy(), percent)
        return pa.table({"a": ids.take(pa.array([x for x, _ in found], pa.int64())), "b": ids.take(pa.array([y for _, y in found], pa.int64()))})

    kind = groups.schema["id"].dataType.simpleString()
    return rows.select("group", "i", "j", "id", "inner", "items").groupBy("group", "i", "j").applyInArrow(
        run, f"a {kind}, b {kind}").filter("a <> b")


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes(id, component)`` with further ``links(a, b)``: only the classes that these join are named anew."""
    new = written(links)
    if new.isEmpty():
        return classes
    ends = new.join(classes.toDF("a", "class_a"), "a", "left").join(classes.toDF("b", "class_b"), "b", "left")
    joined = written(components(ends.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).distinct()))
    named = classes.join(joined.toDF("component", "_to"), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return written(named.unionByName(joined.join(classes, "id", "left_anti")))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row of ``documents``.

    A document's set holds its distinct shingles of ``shingle`` words (A-Z lower-cased); of
    fewer words, the whole sequence. Documents are linked if ``100 * common >= percent * all``
    of their sets; ``component_id`` is the smallest key that links reach.

    Null, empty and blank texts have empty sets and are linked with nothing. Rows with one key
    and several texts count as one document with the links of each. Rows without a key get a
    null component. An empty table gives an empty result.
    """
    kind = documents.schema[key].dataType.simpleString()
    every = written(_sets(documents, key, text, shingle))
    full = every.filter("set is not null and id is not null")
    first = written(full.groupBy("set").agg(F.min("id").alias("id"), F.first("signature").alias("signature")))
    sets = first.select("id", "signature")

    nodes = _nodes(_descend(sets, kind, True))
    inside = nodes.select("id").distinct()
    items = written(_items(
        documents.select(F.col(key).alias("id"), F.col(text).alias("text")).join(inside, "id"), kind, shingle).distinct())

    def crossing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
        named = pairs.join(classes.toDF("a", "class_a"), "a", "left").join(classes.toDF("b", "class_b"), "b", "left")
        return named.filter(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")

    stars = nodes.filter("opening and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    near = written(_agreeing(stars, sets))
    best = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree")).groupBy("a").agg(
        F.max_by("b", F.struct("agree", F.xxhash64("a", "b"))).alias("b"))
    classes = written(components(written(_confirmed(
        best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), items, percent))))

    groups, open_pairs = None, crossing(near.select("a", "b"), classes)
    for look in range(LOOKS):
        there = _placed(nodes, classes)
        one = there.filter(F.col("size") <= SMALL)
        left, right = (one.select("path", F.col("id").alias(c), F.col("class").alias(f"class_{c}")) for c in "ab")
        pairs = left.join(right, "path").filter("class_a <> class_b and a < b").select("a", "b")
        found = _agreeing(pairs, sets).select("a", "b")
        if look == 0:
            found = found.unionByName(open_pairs).distinct()
        classes = _merged(classes, _confirmed(found, items, percent))
        # nodes of one family in all trees make one group
        large = there.filter(F.col("size") > SMALL).withColumn("dense", F.col("most") * 2 >= F.col("size"))
        group = F.when(F.col("dense"), F.xxhash64(F.lit("family"), "family"))
        if look + 1 == LOOKS:
            group = F.coalesce(group, "path")
        more = large.select(group.alias("group"), "id", (F.col("class") != F.col("family")).alias("outside")).filter("group is not null")
        groups = more if groups is None else groups.unionByName(more)
        if look + 1 < LOOKS:
            nodes = _nodes(_descend(sets.join(large.filter("not dense").select("id", "path"), "id"), kind, False))
            if nodes.isEmpty():
                break
    classes = _merged(classes, _block_links(written(groups.distinct()), items, percent))

    named = first.select("set", F.col("id").alias("first")).join(classes.withColumnRenamed("id", "first"), "first", "left").select(
        "set", F.coalesce("component", "first").alias("component_id"))
    rows = every.select("id", "n", "set").join(named, "set", "left")
    merged = rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(
        F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return merged


def distinct_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
                       percent: int = 80) -> DataFrame:
    """One row of ``documents`` for each class of near duplicates: that with the smallest key.

    Of several rows with that key one stays. Rows without a key all stay.
    """
    found = near_duplicates(documents.select(key, text), key, text, shingle, percent)
    kept = found.filter(F.col(key) == F.col("component_id")).select(key).distinct()
    named = documents.filter(F.col(key).isNotNull()).join(kept, key, "left_semi").dropDuplicates([key])
    return named.select(documents.columns).unionByName(documents.filter(F.col(key).isNull()))

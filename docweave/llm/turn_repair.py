"""Repair of conversations by cheapest edits, least among equals by prefix-doubling path ranking.

A conversation is in order if its role initials read ``(s?(ua)+)?``. Four states follow that pattern: empty, after
system, after user, after assistant. Edits lead from (turn, state) to (turn, state): Keep,
Rerole, Delete and Insert. The state says which role a rerole or an insert gives.

Conversations are cut into chunks of bounded size. Costs come from the end: a chunk is a four by four
matrix of least costs, and the matrices of a conversation's chunks are multiplied by doubling, over the cluster.
With the cost of all that follows, every node of a chunk knows its optimal arcs. Nodes are
ranked by the letters of 1, 2, 4, ... edits; a node's least arc has the least letter, then the least
rank behind it, and pointers doubled along least arcs mark the path. Between chunks, the
states on the path are found by doubling the chunks' own pointers.

Turns are numbered over range partitions, so a conversation with a large share of all rows is split like
any other. Only its digest is made by one task, as SHA-256 must be, from a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.tables import written

CHUNK = 1024
FAR = 1 << 50
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the user or assistant turn that a state allows; the role of that turn.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE = np.array(["user", "user", "assistant", "user"])
#: The state after a turn kept, by state and initial (s, u, a, other); -1: not allowed.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Edits in the order of their letters.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
COST = {"keep": 0, "rerole": 2, "delete": 3, "insert": 2, "truncated": 1}
SPACE = "\\x20\\x09-\\x0D"


# costs and paths inside chunks


class Chunks:
    """Whole chunks of a sorted batch: where each begins, and each row's initial and faults."""

    def __init__(self, table: pa.Table):
        number = lambda c: table.column(c).to_numpy()
        self.begin = np.append(_begins(table), table.num_rows)
        self.size = np.diff(self.begin)
        self.initial, self.must, self.cut = number("initial"), number("must"), number("truncated").astype(np.int64)
        #: A layer of nodes before each row, and one behind the last of each chunk.
        self.layer = self.begin[:-1] + np.arange(len(self.size))
        self.exit = self.layer + self.size
        self.row_layer = np.arange(table.num_rows) + np.repeat(np.arange(len(self.size)), self.size)

    def costs(self, ends: np.ndarray) -> np.ndarray:
        """Least cost of each (layer, state) for ``ends(chunk, state, target)``, the costs behind the chunk."""
        cost = np.full((len(self.row_layer) + len(self.size), 4, ends.shape[2]), FAR, np.int64)
        cost[self.exit] = ends
        order = np.argsort(-self.size, kind="stable")
        for back in range(1, int(self.size.max(initial=0)) + 1):
            here = order[:int((self.size >= back).sum())]
            rows, at = self.begin[here + 1] - back, self.exit[here] - back
            arcs = self._arcs(rows, cost[at + 1])
            cost[at] = _inserted(arcs.min(axis=0))
        return cost

    def _arcs(self, rows: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Costs by Delete, Keep and Rerole from each state before ``rows``."""
        free = np.where(self.must[rows], FAR, self.cut[rows])[:, None, None]
        to = KEPT[:, self.initial[rows]].T
        kept = np.where((to < 0)[:, :, None], FAR, np.take_along_axis(behind, np.maximum(to, 0)[:, :, None], axis=1))
        return np.minimum(FAR, np.stack([
            behind + COST["delete"], kept + free + COST["keep"], behind[:, NEXT] + free + COST["rerole"]]))

    def pointers(self, cost: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letter and target of the least optimal arc of each node; -1 and the node itself where the path ends."""
        cost = cost[:, :, 0]
        n = len(cost)
        node = np.arange(4 * n).reshape(n, 4)
        arc_cost = np.full((n, 4, 4), FAR, np.int64)
        target = np.repeat(node[:, :, None], 4, axis=2)
        arc_cost[self.row_layer, :, DELETE], arc_cost[self.row_layer, :, KEEP], arc_cost[self.row_layer, :, REROLE] = self._arcs(
            np.arange(len(self.row_layer)), cost[self.row_layer + 1][:, :, None])[:, :, :, 0]
        below = node[self.row_layer + 1]
        target[self.row_layer, :, DELETE] = below
        target[self.row_layer, :, KEEP] = np.take_along_axis(below, np.maximum(KEPT[:, self.initial].T, 0), axis=1)
        target[self.row_layer, :, REROLE] = below[:, NEXT]
        inner = np.ones(n, bool)
        inner[self.exit] = last
        arc_cost[inner, :, INSERT] = np.minimum(FAR, cost[inner][:, NEXT] + COST["insert"])
        target[inner, :, INSERT] = node[inner][:, NEXT]
        ends = np.zeros((n, 4), bool)
        ends[self.exit] = ~last[:, None] | np.isin(np.arange(4), [EMPTY, ASSISTANT])
        optimal = (arc_cost == cost[:, :, None]) & (cost < FAR)[:, :, None] & ~ends[:, :, None]
        return _least(optimal.reshape(-1, 4), target.reshape(-1, 4))


def _begins(table: pa.Table) -> np.ndarray:
    name = table.column("c").combine_chunks().dictionary_encode().indices.to_numpy()
    chunk = table.column("chunk").to_numpy()
    return np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (chunk[1:] != chunk[:-1])])


def _inserted(cost: np.ndarray) -> np.ndarray:
    """With up to two turns inserted; a third never pays."""
    for _ in range(2):
        cost = np.minimum(cost, np.minimum(FAR, cost[:, NEXT] + COST["insert"]))
    return cost


def _least(optimal: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arc of each node whose string of letters is least, by ranks of doubled lengths.

    A string that ends is less than any longer one. Arcs of a node bear different letters, so a node's
    least arc shows at length one already, and its pointers may be doubled from there.
    """
    node = np.arange(len(target))
    letter = np.where(optimal.any(axis=1), optimal.argmax(axis=1), -1)
    pointer = np.where(letter < 0, node, target[node, letter])
    rank, jump = letter + 1, pointer
    while True:
        both = rank.astype(np.int64) * (len(node) + 5) + rank[jump]
        doubled = np.unique(both, return_inverse=True)[1]
        if doubled.max(initial=0) == rank.max(initial=0) and (np.unique(rank, return_inverse=True)[1] == doubled).all():
            break
        rank, jump = doubled, jump[jump]
    behind = np.where(optimal, np.arange(4) * (len(node) + 1) + rank[target], np.iinfo(np.int64).max)
    chosen = behind.argmin(axis=1)
    return letter, np.where(letter < 0, node, target[node, chosen])


def _marked(pointer: np.ndarray, start: np.ndarray, longest: int) -> np.ndarray:
    """Nodes that ``start`` reaches in up to ``longest`` steps, by doubled pointers from the largest down."""
    jumps = [pointer]
    while 1 << len(jumps) <= longest:
        jumps.append(jumps[-1][jumps[-1]])
    on = np.zeros(len(pointer), bool)
    on[start] = True
    for jump in reversed(jumps):
        on[jump[np.flatnonzero(on)]] = True
    return on


#: Costs behind the last turn: the pattern may end empty or after the assistant, else turns are inserted.
FINAL = _inserted(np.array([[[0], [FAR], [FAR], [0]]]))[0]


def _chunk_matrix(chunks: Chunks) -> np.ndarray:
    ends = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(chunks.size), 1, 1))
    return chunks.costs(ends)[chunks.layer]


def _ends(table: pa.Table, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """Costs behind each chunk, and whether it is the last of its conversation (it has no such costs then)."""
    first = chunks.begin[:-1]
    column = table.column("behind").combine_chunks().take(pa.array(first))
    last = column.is_null().to_numpy(zero_copy_only=False)
    ends = np.tile(FINAL, (len(last), 1, 1))
    if not last.all():
        ends[~last, :, 0] = np.array(column.filter(pa.array(~last)).to_pylist(), np.int64)
    return ends, last


def _chunk_pointers(table: pa.Table, chunks: Chunks) -> np.ndarray:
    """The state behind each chunk for each state before it, on the least path."""
    ends, last = _ends(table, chunks)
    _, pointer = chunks.pointers(chunks.costs(ends), last)
    for _ in range(int(4 * (chunks.size.max(initial=0) + 1)).bit_length()):
        pointer = pointer[pointer]
    return pointer.reshape(-1, 4)[chunks.layer] % 4


def _chunk_edits(table: pa.Table, chunks: Chunks) -> pa.RecordBatch:
    """``(c, pos, own, inserted, edit, role, cost)``: each row's edit, and behind the last row one for turns inserted there."""
    ends, last = _ends(table, chunks)
    letter, pointer = chunks.pointers(chunks.costs(ends), last)
    entry = table.column("entry").to_numpy()[chunks.begin[:-1]]
    on = _marked(pointer, 4 * chunks.layer + entry, 4 * (int(chunks.size.max(initial=0)) + 1))
    nodes = np.flatnonzero(on & (letter >= 0))
    layer, state, what = nodes // 4, nodes % 4, letter[nodes]
    n = len(letter) // 4
    edit, before = np.full(n, -1), np.zeros(n, np.int64)
    plain = what != INSERT
    edit[layer[plain]], before[layer[plain]] = what[plain], state[plain]
    # turns inserted in one layer follow each other: user, assistant, as their states come
    put = np.zeros((n, 4), bool)
    put[layer[~plain], state[~plain]] = True
    count = put.sum(axis=1)
    row = np.full(n, -1)
    row[chunks.row_layer] = np.arange(len(chunks.row_layer))
    keep = (row >= 0) | (count > 0)
    at = np.flatnonzero(keep)
    behind = row[at] < 0
    own_row = np.where(behind, row[at - 1], row[at])
    pos = table.column("pos").to_numpy()[own_row] + behind
    inserted = [[] if not k else _roles(put[i]) for i, k in zip(at.tolist(), count[at].tolist())]
    cut = np.where(behind, 0, chunks.cut[np.maximum(row[at], 0)])
    kind = edit[at]
    cost = count[at] * COST["insert"] + np.select(
        [kind == DELETE, kind == REROLE, kind == KEEP], [COST["delete"], COST["rerole"] + cut, COST["keep"] + cut], 0)
    take = pa.array(own_row)
    own = pc.if_else(pa.array(behind), pa.scalar(None, pa.int64()), table.column("own").combine_chunks().take(take))
    return pa.RecordBatch.from_arrays([
        table.column("c").combine_chunks().take(take), pa.array(pos, pa.int64()), own, pa.array(inserted, pa.list_(pa.string())),
        pa.array([LETTERS[k] if k >= 0 else None for k in kind.tolist()], pa.string()),
        pa.array([ROLE[s] if k == REROLE else None for k, s in zip(kind.tolist(), before[at].tolist())], pa.string()),
        pa.array(cost, pa.int64())], names=["c", "pos", "own", "inserted", "edit", "role", "cost"])


def _roles(put: np.ndarray) -> list[str]:
    """Roles inserted in a layer, from the first state on the path: one that no other of them leads to."""
    states = set(np.flatnonzero(put).tolist())
    state = min(states - {int(NEXT[s]) for s in states}, default=min(states))
    out = []
    while state in states and len(out) < len(states):
        out.append(str(ROLE[state]))
        state = int(NEXT[state])
    return out


def _per_chunk(rows: DataFrame, ddl: str, compute: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """``compute`` of whole chunks, each in one call: rows are dealt by chunk and sorted, a batch's last chunk waits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            at = int(_begins(table)[-1])
            if at:
                yield compute(table.slice(0, at).combine_chunks())
            held = table.slice(at)
        if held is not None:
            yield compute(held.combine_chunks())

    return rows.repartition("c", "chunk").sortWithinPartitions("c", "chunk", "pos").mapInArrow(run, ddl)


# chunks of one conversation


def _behind(matrices: DataFrame) -> DataFrame:
    """``(c, chunk, behind)``: least cost of all later chunks for each state, from ``matrices(c, chunk, m)``.

    Products of 1, 2, 4, ... consecutive matrices, each round a join with the chunk as far behind.
    """
    longest = matrices.agg(F.max("chunk")).first()[0]
    now, far = matrices, 1
    while longest is not None and far <= longest:
        ahead = now.select("c", (F.col("chunk") - far).alias("chunk"), F.col("m").alias("other"))
        now, far = written(now.join(ahead, ["c", "chunk"], "left").select("c", "chunk", F.coalesce(_product("m", "other"), "m").alias("m"))), 2 * far
    final = F.array(*(F.lit(int(x)) for x in FINAL[:, 0]))
    start = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_min(F.zip_with(
        F.slice("m", i * 4 + 1, F.lit(4)), final, lambda a, b: a + b)))
    return now.filter("chunk > 0").select("c", (F.col("chunk") - 1).alias("chunk"), start.alias("behind"))


def _product(a: str, b: str) -> Column:
    """Least sums over the middle state of two matrices, rows one after another; null if one is."""
    def cell(k: Column) -> Column:
        i, j = F.floor(k / 4).cast("int"), (k % 4).cast("int")
        return F.least(F.lit(FAR), F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda x: F.get(a, i * 4 + x) + F.get(b, x * 4 + j))))

    return F.when(F.col(b).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(15)), cell))


def _entries(pointers: DataFrame) -> DataFrame:
    """``(c, chunk, entry)``: the state before each chunk, from ``pointers(c, chunk, f)``, by doubled pointers."""
    longest = pointers.agg(F.max("chunk")).first()[0]
    now, far = pointers, 1
    while longest is not None and far <= longest:
        before = now.select("c", (F.col("chunk") + far).alias("chunk"), F.col("f").alias("g"))
        now, far = written(now.join(before, ["c", "chunk"], "left").select(
            "c", "chunk", F.coalesce(F.transform("g", lambda s: F.get("f", s)), "f").alias("f"))), 2 * far
    return now.select("c", (F.col("chunk") + 1).alias("chunk"), F.get("f", F.lit(0)).alias("entry"))


# whole tables


def _numbered(light: DataFrame) -> DataFrame:
    """``pos`` of each row of ``light(c, turn, mark, own, ...)`` in its conversation, from 0.

    Range partitions are numbered each for itself; at most one conversation goes on from one partition into the next.
    """
    order = ["c", F.col("turn").asc_nulls_first(), "mark", "own"]
    sliced = written(light.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    earlier = Window.partitionBy("c").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    going_on = sliced.groupBy("c", "_slice").agg(F.count("*").alias("n")).select(
        "c", "_slice", F.sum("n").over(earlier).alias("_before")).filter("_before > 0")
    inside = Window.partitionBy("_slice", "c").orderBy(*order[1:])
    return sliced.withColumn("pos", F.row_number().over(inside).cast("bigint") - 1).join(going_on, ["c", "_slice"], "left").withColumn(
        "pos", F.col("pos") + F.coalesce("_before", F.lit(0))).drop("_slice", "_before")


def _judged(light: DataFrame, chunk: int) -> DataFrame:
    """Rows with their place, chunk and faults."""
    placed = written(_numbered(light))
    firsts = placed.groupBy("c", "mark").agg(F.min("pos").alias("pos")).select("c", "pos", F.lit(True).alias("_first"))
    before = placed.select("c", (F.col("pos") + 1).alias("pos"), F.col("initial").alias("_prev"))
    kinds = F.create_map(*(F.lit(x) for pair in (("s", 0), ("u", 1), ("a", 2)) for x in pair))
    duplicate = ~F.col("blank") & F.col("_first").isNull()
    return written(placed.join(firsts, ["c", "pos"], "left").join(before, ["c", "pos"], "left").select(
        "c", (F.col("pos") / chunk).cast("bigint").alias("chunk"), "pos", "own", "turn",
        F.coalesce(kinds[F.col("initial")], F.lit(3)).alias("initial"), "blank", duplicate.alias("duplicate"),
        (~F.col("blank") & F.col("_first").isNotNull() & F.col("open")).alias("truncated"),
        (F.col("blank") | duplicate).alias("must"),
        (F.col("_prev").isNotNull() & ~F.concat("_prev", "initial").isin("su", "ua", "au")).alias("illegal")))


def _edits(judged: DataFrame) -> DataFrame:
    columns = ["c", "chunk", "pos", "own", "initial", "must", "truncated"]
    long = judged.filter("chunk > 0").select("c").distinct()
    several = judged.select(columns).join(long, "c", "left_semi")

    def matrices(table: pa.Table) -> pa.RecordBatch:
        chunks = Chunks(table)
        at = pa.array(chunks.begin[:-1])
        m = _chunk_matrix(chunks).reshape(len(at), 16)
        return pa.RecordBatch.from_arrays([table.column("c").combine_chunks().take(at), table.column("chunk").combine_chunks().take(at),
                                           pa.array(m.tolist(), pa.list_(pa.int64()))], names=["c", "chunk", "m"])

    def pointers(table: pa.Table) -> pa.RecordBatch:
        chunks = Chunks(table)
        at = pa.array(chunks.begin[:-1])
        f = _chunk_pointers(table, chunks)
        return pa.RecordBatch.from_arrays([table.column("c").combine_chunks().take(at), table.column("chunk").combine_chunks().take(at),
                                           pa.array(f.tolist(), pa.list_(pa.int32()))], names=["c", "chunk", "f"])

    behind = written(_behind(written(_per_chunk(several, "c string, chunk bigint, m array<bigint>", matrices))))
    entries = written(_entries(written(_per_chunk(
        several.join(behind, ["c", "chunk"], "left"), "c string, chunk bigint, f array<int>", pointers))))
    every = judged.select(columns).join(behind, ["c", "chunk"], "left").join(entries, ["c", "chunk"], "left").withColumn(
        "entry", F.coalesce("entry", F.lit(EMPTY)))
    return _per_chunk(every, "c string, pos bigint, own bigint, inserted array<string>, edit string, role string, cost bigint",
                      lambda table: _chunk_edits(table, Chunks(table)))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Faults per conversation, and all turns with their edits.

    The first has ``(conv, gaps, blank, duplicate, truncated, illegal)``, the second ``(conv, pos, step, edit,
    cost, role, text)``, ordered by pos and step: edits are the letters of Keep, Rerole, Delete and Insert,
    role and text those after the edit (of a deleted turn, its own).

    Turns stand by number, nulls first, those of one number by the digest of role and text. A null role or text is
    one space, so such a text is blank. Rows without a conversation form one. Repeated rows are duplicates of
    the first. A turn whose role has another initial than s, u or a is reroled or deleted. Among
    cheapest edits the least string of letters is taken. An empty table gives two empty results. Extra columns go.
    """
    named = F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    own = turns.select(named.alias("c"), F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                       F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    rows = written(own.withColumn("own", F.monotonically_increasing_id()))
    last = F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    judged = _judged(rows.select(
        "c", "turn", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("mark"), "own",
        F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open")), chunk)
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    names = rows.groupBy("c").agg(F.first("conv").alias(conv))
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    faults = judged.groupBy("c").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *map(count, ("blank", "duplicate", "truncated", "illegal")))
    edits = written(_edits(judged)).alias("e")
    there = edits.join(rows.select("own", F.col("role").alias("_role"), F.col("text").alias("_text")), "own", "left")
    inserts = F.transform("inserted", lambda r: F.struct(
        F.lit("I").alias("edit"), F.lit(COST["insert"]).cast("bigint").alias("cost"), r.alias("role"), F.lit("").alias("text")))
    itself = F.struct("edit", (F.col("cost") - COST["insert"] * F.size("inserted")).alias("cost"), F.coalesce("role", "_role").alias("role"),
                      F.col("_text").alias("text"))
    steps = F.concat(inserts, F.when(F.col("edit").isNotNull(), F.array(itself)).otherwise(F.array().cast(
        "array<struct<edit:string,cost:bigint,role:string,text:string>>")))
    repaired = there.select("c", "pos", F.posexplode(steps).alias("step", "_s")).select("c", "pos", "step", "_s.*")
    return names.join(faults, "c").drop("c"), repaired.join(names, "c").select(conv, "pos", "step", "edit", "cost", "role", "text")


def digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``(conv, cost, audit, repaired_sha256)`` of turns with edits: letters in order, and the digest of what is left.

    A task reads the sorted turns of a conversation as a stream and keeps a letter a turn and the state of the hash. A
    digest needs all bytes in order, so the longest conversation sets the time of the longest task, not its memory.
    """
    schema = "c string, cost bigint, audit string, repaired_sha256 string"
    named = F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string"))).alias("c")
    kept = F.col("edit") != "D"
    stream = repaired.select(named, "pos", "step", "edit", "cost", F.when(kept, F.concat_ws(":", "role", "text")).alias("line"))
    sorted_rows = stream.repartition("c").sortWithinPartitions("c", "pos", "step").select("c", "edit", "cost", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, cost, audit, digest, begun = None, 0, [], None, False
        for batch in batches:
            done: list[tuple] = []
            for c, edit, price, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != name:
                    if name is not None:
                        done.append((name, cost, "".join(audit), digest.hexdigest()))
                    name, cost, audit, digest, begun = c, 0, [], hashlib.sha256(), False
                audit.append(edit)
                cost += price
                if line is not None:
                    digest.update((b"\n" if begun else b"") + line.encode())
                    begun = True
            audit = ["".join(audit)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["c", "cost", "audit", "repaired_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, cost, "".join(audit), digest.hexdigest())],
                                             names=["c", "cost", "audit", "repaired_sha256"])

    names = repaired.select(named, conv).groupBy("c").agg(F.first(conv).alias(conv))
    return names.join(sorted_rows.mapInArrow(run, schema), "c").drop("c")

"""Exact Jaccard self-join by prefix filtering.

Equal sets are collapsed first, so a group of copies costs one row, not all its
pairs. The result is factored the same way: pairs between distinct sets, and one
row per further member of a set.

Items meet by 64-bit hashes and in the order of counts by hash bucket, a table of bounded size that every task holds. So a task
finds the prefixes of its sets without sending items to counts and back; what is found is verified on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.groups import connected
from docweave.operators.skew import hot_keys, salted_join
from docweave.operators.tables import written

EPS = 1e-9
#: Buckets in which items are counted; a power of two.
BUCKETS = 1 << 21
#: Bits of the sketch of a set, and items of the sets that a task looks at at once.
SKETCH = 512
SLICE = 1_000_000


def set_groups(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``sets(id, items)``: one row per distinct set and the further members of each.

    Returns ``reps(id, items, n)`` with the lowest id, and ``same(id_a, id_b)``: the lowest id of a set with each further member.
    Sets are grouped by their keys alone; the items of a further member are left out where they lie.
    """
    # emptiness is tested on the written table: a filter here would compute every set twice
    keyed = written(sets.select("id", F.sort_array("items").alias("items")).select(
        "id", "items", F.size("items").alias("n"), F.unhex(F.sha2(F.array_join("items", "\x1f"), 256)).alias("key"),
        F.monotonically_increasing_id().alias("row"))).filter("n > 0")
    repeated = written(keyed.groupBy("key").agg(
        F.min("id").alias("id_a"), F.coalesce(F.min_by("row", "id"), F.min("row")).alias("first"), F.count("*").alias("copies")
    ).filter("copies > 1"))
    hot = hot_keys(repeated.select("key", F.col("copies").alias("n")), "key")
    further = written(salted_join(keyed.select("key", "row", F.col("id").alias("id_b")), repeated.drop("copies"), "key", hot, spread="row")
                      .filter("row <> first").select("row", "id_a", "id_b"))
    reps = written(keyed.join(further.select("row"), "row", "left_anti").select("id", "items", "n"))
    return reps, further.filter("id_a <> id_b").select("id_a", "id_b")


def _counts(reps: DataFrame, buckets: int) -> np.ndarray:
    """Number of items by hash bucket: at most ``buckets`` numbers, whatever the size of the table."""
    counts = reps.select(F.explode("items").alias("item")).groupBy(F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    table = np.zeros(buckets, np.int32)
    table[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return table


def _rarest(code: np.ndarray, n: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Places and hashes of the prefixes of sets of ``n`` hashes each, how many each set has, and words of the sets' sketches."""
    of = np.repeat(np.arange(len(n)), n)
    count = counts[code & (len(counts) - 1)]
    order = np.lexsort((code, count, of))
    pos = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    kept = (pos < (n - np.ceil(n * threshold - EPS) + 1)[of]) & (count[order] > 1)
    bits = np.bincount(of * SKETCH + ((code >> 32) & (SKETCH - 1)), minlength=len(n) * SKETCH) & 1
    words = np.packbits(bits.astype(bool), bitorder="little").view(np.int64)
    return pos[kept], code[order][kept], np.bincount(of[kept], minlength=len(n)), words


def _prefixes(reps: DataFrame, threshold: float, buckets: int = BUCKETS) -> DataFrame:
    """``(id, n, sketch, places)`` with ``places`` of ``(pos, item)``: the rarest items of each set, enough to share one with any set that is similar.

    Items are hashes, ordered by the count of their bucket first; two sets with a Jaccard of ``threshold`` must share one of their
    first ``n - ceil(t n) + 1`` items. Items that are alone in a bucket are left out: no other set has them. A sketch
    has for each of its bits whether an odd number of items hash to it, so an item that only one of two sets has turns one bit at most.
    """
    shared = reps.sparkSession.sparkContext.broadcast(_counts(reps, buckets))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(np.diff(whole.column("codes").offsets.to_numpy()))
            cuts = np.flatnonzero(np.diff(ends // SLICE)) + 1
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(ends)]):
                batch = whole.slice(low, high - low)
                lists = batch.column("codes")
                pos, code, kept, words = _rarest(
                    lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), shared.value, threshold)
                places = pa.ListArray.from_arrays(np.r_[0, np.cumsum(kept)].astype(np.int32), pa.StructArray.from_arrays(
                    [pa.array(pos, pa.int32()), pa.array(code, pa.int64())], ["pos", "item"]))
                sketch = pa.ListArray.from_arrays(np.arange(0, len(words) + 1, SKETCH // 64, np.int32), pa.array(words))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), sketch, places], ["id", "n", "sketch", "places"])

    codes = reps.select("id", "n", F.transform("items", lambda i: F.xxhash64(i)).alias("codes"))
    return written(codes.mapInArrow(
        rarest, f"id {reps.schema['id'].dataType.simpleString()}, n int, sketch array<bigint>, places array<struct<pos: int, item: bigint>>"))


def _placed(prefixes: DataFrame) -> DataFrame:
    """A row ``(id, n, pos, item)`` per item of the prefixes."""
    return prefixes.withColumn("e", F.explode("places")).select("*", F.col("e.pos").alias("pos"), F.col("e.item").alias("item")).drop("e", "places", "sketch")


def _possible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of prefix rows that their lengths and the places of the shared item allow: ``(id_a, id_b)``, a < b."""
    need = F.ceil((F.col("n") + F.col("n_b")) * (threshold / (1 + threshold)) - EPS)
    reach = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))
    return (
        pairs.filter(F.least("n", "n_b") >= F.greatest("n", "n_b") * threshold - EPS)
        .filter(reach >= need)
        .select(F.least("id", "id_b").alias("id_a"), F.greatest("id", "id_b").alias("id_b")).distinct()
    )


def _verified(candidates: DataFrame, prefixes: DataFrame, reps: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Candidates whose full sets are similar. Sketches that differ in more bits than similar sets have other items rule most others out."""
    sketched = lambda c: prefixes.select(F.col("id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    other = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH // 64)), F.lit(0))
    most = (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + EPS
    candidates = written(candidates.join(sketched("a"), "id_a").join(sketched("b"), "id_b").filter(other <= most).select("id_a", "id_b").distinct())
    named = written(candidates.select(F.col("id_a").alias("id")).unionByName(candidates.select(F.col("id_b").alias("id"))).distinct())
    full = reps.join(named, "id", "left_semi").select("id", "items")
    jac = F.size(F.array_intersect("items_a", "items_b")) / F.size(F.array_union("items_a", "items_b"))
    verified = (
        candidates
        .join(full.select(F.col("id").alias("id_a"), F.col("items").alias("items_a")), "id_a")
        .join(full.select(F.col("id").alias("id_b"), F.col("items").alias("items_b")), "id_b")
        .select("id_a", "id_b", jac.alias("jaccard"))
    )
    return verified.filter(F.col("jaccard") > threshold if strict else F.col("jaccard") >= threshold)


def _other(prefixes: DataFrame, *more: str) -> DataFrame:
    return prefixes.select("item", *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "pos", *more)))


def jaccard_pairs(reps: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Pairs of distinct sets with Jaccard above ``threshold``: ``(id_a, id_b, jaccard)``, a < b.

    Length and position bounds thin the candidates of the prefix join, the remaining pairs are verified on the full sets.
    """
    listed = _prefixes(reps, threshold)
    prefixes = _placed(listed)
    hot = hot_keys(prefixes.groupBy("item").agg(F.count("*").alias("n")), "item")
    pairs = salted_join(prefixes, _other(prefixes), "item", hot, spread="id").filter(F.col("id") < F.col("id_b"))
    return _verified(_possible(pairs, threshold), listed, reps, threshold, strict)


def jaccard_groups(reps: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """``(id, group)`` of the sets that links of this Jaccard reach: the lowest id of each connected group.

    No family is compared pair by pair. Of the sets that share a prefix item and are of about one length, all are compared with the
    lowest only; what these links join is one group. Then only items are looked at that still stand in
    several groups, and there the members outside an item's largest group meet those of other groups.
    """
    listed = _prefixes(reps, threshold)
    prefixes = _placed(listed).withColumn("step", F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)))
    lowest = prefixes.groupBy("item", "step").agg(F.min(F.struct("id", "n", "pos")).alias("first"), F.count("*").alias("of")).filter("of > 1")
    hot = hot_keys(lowest.groupBy("item").agg(F.sum("of").alias("n")), "item")
    firsts = lowest.select("item", F.col("step").alias("step_b"), *(F.col(f"first.{c}").alias(f"{c}_b") for c in ("id", "n", "pos")))
    stars = salted_join(prefixes, firsts, "item", hot, spread="id").filter("abs(step - step_b) <= 1 and id <> id_b")
    links = written(_verified(_possible(stars, threshold), listed, reps, threshold, strict).select("id_a", "id_b"))
    known = connected(links)
    placed = _placed(written(listed.join(known, "id", "left").withColumn("group", F.coalesce("group", "id"))))
    counts = placed.groupBy("item", "group").agg(F.count("*").alias("of"))
    several = written(counts.groupBy("item").agg(
        F.max_by("group", F.struct("of", "group")).alias("main"), F.count("*").alias("groups"), F.sum("of").alias("n")).filter("groups > 1"))
    open_rows = salted_join(placed, several.select("item", "main"), "item", hot_keys(several.select("item", "n"), "item"), spread="id")
    open_rows = written(open_rows)
    outside = open_rows.filter(F.col("group") != F.col("main"))
    hot = hot_keys(outside.groupBy("item").agg(F.count("*").alias("n")), "item")
    crossing = salted_join(outside, _other(open_rows, "group"), "item", hot, spread="id").filter(F.col("group") != F.col("group_b"))
    more = _verified(_possible(crossing, threshold), listed, reps, threshold, strict).select("id_a", "id_b")
    return connected(links.unionByName(written(more)))


def similar_sets(sets: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Factored self-join of ``sets(id, items)``: ``(id_a, id_b, jaccard)``."""
    assert 0 < threshold < 1 and not math.isnan(threshold)
    reps, same = set_groups(sets)
    return jaccard_pairs(reps, threshold, strict).unionByName(same.withColumn("jaccard", F.lit(1.0)))

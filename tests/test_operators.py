"""Operators against brute force and fixed expectations."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import formatting as fm
from docweave.functions import intent as it
from docweave.functions import quality as ql
from docweave.functions import text as tx
from docweave.functions import vectors
from docweave.operators import (
    cells, chunking, classifiers, context, examples, fusion, groups, hygiene, incremental, intents, lexical, postings, prototypes, ranks,
    sessions, setsim, vector,
)
from docweave.operators.tables import written


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# --- text ---

def test_portable_patterns(spark):
    # a boundary next to an accented letter is no boundary
    df = spark.createDataFrame([("hié there",), ("say hi now",), ("hi",)], "t string")
    got = [r[0] for r in df.select(F.col("t").rlike(tx.any_of([r"\b(hi)\b"]))).collect()]
    assert got == [False, True, True]
    assert tx.portable(r"[^\w\s]").startswith("[^\\p{L}")


def test_words_and_strip_follow_unicode(spark):
    t = "  a b \n\x1cc\u0085"
    df = spark.createDataFrame([(t,)], "t string")
    w, s = df.select(tx.words(F.col("t")), tx.strip(F.col("t"))).first()
    assert w == t.split() and s == t.strip()


def test_token_estimate(spark):
    def model(text):
        text = re.sub(r"\s+", " ", text).strip()
        return int(len(text.split()) + 0.5 * sum(c in ".,;:!?()[]{}-+*/='\"" for c in text)
                   + (len(text) - text.count(" ")) / 4 * 0.2) + 1

    texts = ["", "a", "Hello, world! (x) = [1]", "word " * 40, "é" * 33]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in rows(df.select("i", tx.token_estimate(F.col("t"))), "i")] == [model(t) for t in texts]


# --- chunking ---

def plain_chunks(text, size, overlap, separators):
    """Recursion over pieces, and packing with a list of held pieces."""
    def pieces(part, level):
        if len(part) <= size:
            return [part] if part else []
        while separators[level] and separators[level] not in part:
            level += 1
        if not separators[level]:
            return list(part)
        first, *rest = part.split(separators[level])
        return [a for p in [first, *(separators[level] + r for r in rest)] for a in pieces(p, level + 1)]

    chunks, held = [], []
    for a in pieces(text, 0):
        if held and len("".join(held)) + len(a) > size:
            chunks.append("".join(held))
            while held and (len("".join(held)) > overlap or len("".join(held)) + len(a) > size):
                held = held[1:]
        held = [*held, a]
    return [c.strip() for c in [*chunks, "".join(held)] if c.strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\U0001F600é", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_recursive_chunks_equal_plain_packing(text, size, overlap):
    for separators in (chunking.PLAIN_SEPARATORS, chunking.SENTENCE_SEPARATORS):
        assert chunking.split_recursive(text, size, overlap, separators) == plain_chunks(text, size, overlap, separators)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_recursive_chunks(text, size, overlap):
    chunks = chunking.split_recursive(text, size, overlap, chunking.SENTENCE_SEPARATORS)
    assert all(0 < len(c) <= size for c in chunks)
    # every character that is not blank is kept, in order
    at = 0
    for c in chunks:
        found = text.find(c, max(0, at - size))
        assert found >= 0
        at = found + len(c)
    assert set(re.findall(r"\S+", text)) or not chunks
    if overlap == 0:
        assert re.sub(r"\s", "", "".join(chunks)) == re.sub(r"\s", "", text)


def test_size_parts_are_lossless(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "b", "\n\n"]) for _ in range(n)) for n in (0, 1, 99, 100, 101, 500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, parts in rows(df.select("i", chunking.size_parts(F.col("t"), 100)), "i"):
        assert "".join(parts) == texts[i] and all(len(p) <= 100 for p in parts)


def test_headings_keep_preamble(spark):
    text = "intro\n# One (1)\nbody\n### deep\n## Two\nend"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = rows(chunking.split_headings(df, 10).select("chunk_index", "slug", "text"), "chunk_index")
    assert [g[1] for g in got] == ["", "one-1", "two"]
    assert "".join(g[2] for g in got) == text


def test_fixed_windows_overlap(spark):
    df = spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string")
    assert [r[0] for r in chunking.chunk_fixed(df, 4, 2).orderBy("chunk_index").select("text").collect()] == [
        "abcd", "cdef", "efgh", "ghij"]


# --- lexical ---

def brute_bm25(queries, docs, k):
    toks = {d: re.findall(r"\w+", t.lower()) for d, t in docs}
    toks = {d: t for d, t in toks.items() if t}
    n, avg = len(toks), sum(map(len, toks.values())) / max(1, len(toks))
    df = Counter(t for ts in toks.values() for t in set(ts))
    out = []
    for q, text in queries:
        qt = re.findall(r"\w+", text.lower())
        scores = {}
        for d, ts in toks.items():
            tf = Counter(ts)
            if not set(qt) & set(ts):
                continue
            scores[d] = round(sum(
                math.log((n - df[t] + .5) / (df[t] + .5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (.25 + .75 * len(ts) / avg))
                for t in qt if tf[t]), 6)
        best = sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:k]
        out += [(q, d, r + 1, s) for r, (d, s) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bm25_bounds_and_salts_equal_brute_force(spark, seed, tmp_path, monkeypatch):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]  # w0 is in nearly every text
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(0, 30)))) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(100)]  # a quarter of all texts are copies
    queries = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(0, 9)))) for i in range(25)]
    q = spark.createDataFrame(queries, "query_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_bm25(queries, docs, 4)
    monkeypatch.setattr(postings, "QUERIES", 7)
    path = str(tmp_path / "store")
    lexical.store_index(d.filter("doc_id % 3 = 0"), path, 20)
    lexical.store_index(d.filter("doc_id < 250"), path, 50)
    store = lexical.store_index(d, path)
    found = [lexical.bm25_topk(q, d, 4), lexical.bm25_topk(q, d, 4, shard_docs=9), lexical.search_store(q, store, 4)]
    for top in found:
        got = sorted(tuple(r) for r in top.select("query_id", "doc_id", "rank", "score").collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_blocks_are_not_copied_for_every_few_queries():
    """Ten times the queries and shards bring a hundred times the pairs, but few more copies of blocks and of queries."""
    for asking, shards, copies, groups in ((13_000, 13, 2, 13), (130_000, 125, 2, 25), (1_300_000, 1250, 20, 157)):
        parts, of = postings.layout(asking, shards, 24)
        assert parts <= copies and -(-shards // of) <= groups and parts * -(-shards // of) >= 24


def test_every_pair_adds_up_in_bounded_groups(spark):
    """Shards of few documents, sets of few queries, a document with a term twice, null ids and a query without a match."""
    rnd = random.Random(9)
    gains = [(rnd.choice([None, *range(40)]), f"t{rnd.randint(0, 12)}", rnd.random()) for _ in range(300)]
    weights = [(q, t, rnd.random()) for q in [None, *range(11)] for t in rnd.sample([f"t{i}" for i in range(12)], 3)] + [(99, "absent", 1.0)]
    want = Counter()
    for q, t, w in weights:
        for d, u, g in gains:
            if t == u:
                want[q, d] += w * g
    got = postings.every_pair(spark.createDataFrame(weights, "query_id long, term string, w double"),
                              spark.createDataFrame(gains, "doc_id long, term string, g double"), 40, 300, shard_docs=1, queries=4)
    found = {(r.query_id, r.doc_id): r.score for r in got.collect()}
    assert found == pytest.approx(dict(want)) and got.rdd.getNumPartitions() >= 3 * 40


def test_sweep_equals_one_meeting_at_a_time():
    """A large set of queries against several shards, in slices, with long and short lists."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    blocks = []
    for shard in range(3):
        for i, w in enumerate(words):
            docs = sorted(rnd.sample(range(shard, 1200, 3), max(1, 300 // (i + 1))))
            tfs, dls = ([rnd.randint(1, high) for _ in docs] for high in (5, 90))
            blocks.append({"term": w, "shard": shard, "max_tf": max(tfs), "min_dl": min(dls), "docs": docs, "tfs": tfs, "dls": dls})
    queries = []
    for i in range(2100):
        terms = rnd.sample([*words, "absent"], rnd.randint(1, 9))
        queries.append({"query_id": i, "terms": terms, "ws": [rnd.random() + 0.1 for _ in terms]})
    q, p = pa.Table.from_pylist(queries), pa.Table.from_pylist(blocks)
    want = {}
    for shard in range(3):
        for i, d, s in zip(*(list(x) for x in postings._matched(q, p.filter(pc.equal(p["shard"], shard)), 4, 45.0, 1.5, 0.75))):
            want.setdefault(i, []).append((-s, d.as_py()))
    got = {}
    for i, d, s in zip(*(x.tolist() for x in postings._swept(q, p, 4, 45.0, 1.5, 0.75))):
        got.setdefault(i, []).append((-s, d))
    assert got == {i: sorted(x)[:4] for i, x in want.items()}


@pytest.mark.parametrize("held", [1, 1_000_000])
def test_many_queries_scan_documents_in_place(spark, monkeypatch, held):
    """Several broadcast sets, shards of a few rows, one document with two lengths and a query without an id."""
    rnd = random.Random(12)
    text = lambda n: " ".join(f"w{min(rnd.randint(0, 40), rnd.randint(0, 40))}" for _ in range(n))
    docs, queries = [(i, text(rnd.randint(0, 25))) for i in range(200)], [(i, text(rnd.randint(0, 6))) for i in range(30)]
    for name, value in (("QUERIES", 7), ("SET_QUERIES", 12), ("SET_TERMS", 40), ("SHARD_POSTINGS", 90), ("HELD_NAMES", held)):
        monkeypatch.setattr(postings, name, value)
    q = spark.createDataFrame([*queries, (None, "w1 w2")], "query_id long, text string")
    lists = lexical.term_lists(spark.createDataFrame(docs, "doc_id long, text string"))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan
    found = lexical.bm25_topk(q, spark.createDataFrame(docs, "doc_id long, text string"), 4, shard_docs=9)
    got = sorted(tuple(r) for r in found.select("query_id", "doc_id", "rank", "score").collect())
    want = brute_bm25(queries, docs, 4)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    assert "cogroup" not in found._jdf.queryExecution().executedPlan().toString().lower()
    twice = lexical.term_lists(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a"), (2, "")], "doc_id long, text string")).collect()
    assert [sorted(zip(r.terms, r.tfs, r.dls)) for r in twice] == [[("", 1, 1), ("", 2, 2), ("a", 1, 1), ("a", 2, 2), ("b", 2, 2)]]


def test_index_written_and_read(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a c")], "query_id long, text string")
    index = lexical.build_index(d)
    index.write(str(tmp_path / "ix"), 2)
    again = lexical.LexicalIndex.read(spark, str(tmp_path / "ix"))
    assert rows(again.stats) == [(2, 5)]
    assert rows(lexical.bm25_topk(q, None, 4, index=again)) == rows(lexical.bm25_topk(q, d, 4))


def test_stored_index_sends_texts_not_postings(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (None, "c"), (2, "b c")], "doc_id long, text string")
    made, add = [], postings.Store.add
    monkeypatch.setattr(postings.Store, "add", lambda self, blocks, *more: (made.append(blocks), add(self, blocks, *more)))
    store = lexical.store_index(d, str(tmp_path / "s"), 2)
    assert made[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(store.lengths()) == [(None, 1), (1, 3), (2, 2)]
    held = store.postings(spark.createDataFrame([("b",), ("",)], "term string"))
    assert (held.n_docs, held.n_tokens) == (3, 6)
    assert sorted(zip(*(sum((r[c] for r in held.blocks.collect()), []) for c in ("docs", "tfs", "dls")))) == [(1, 1, 3), (2, 2, 2)]


def test_stored_index_is_pruned_and_grows(spark, tmp_path):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choices([f"w{j}" for j in range(400)], k=20)) + (f" rare{i // 10}" if i % 10 == 0 else "")) for i in range(500)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    path = str(tmp_path / "store")
    store = lexical.store_index(d.filter("doc_id < 400"), path, 25)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    store = lexical.store_index(d, path, 25)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    assert files.items() <= after.items() and len(after) > len(files)  # what was written stays as it is
    assert lexical.store_index(d, path, 25).next_shard() == store.next_shard() == 20
    q = spark.createDataFrame([(1, "rare7 w1"), (2, "rare3"), (3, "absent"), (4, "")], "query_id long, text string")
    terms = lexical.query_terms(q)
    held = store.postings(terms)
    assert (held.n_docs, held.n_tokens) == (500, 500 * 20 + 50)
    plan = held.blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan and "PartitionFilters: []" not in plan.split("bucket")[0]
    # one block answers the second query; of the shards for the first, those without its rare term are left out
    weights, bounds = postings.promised(terms, held, 1.5, 0.75)
    assert bounds.filter("query_id = 2").count() == 1 and bounds.filter("query_id = 1").count() > 10
    top = rows(lexical.search_store(q, store, 1).select("query_id", "doc_id"))
    assert top == [(1, 70), (2, 30)]
    floor = lexical.search_store(q, store, 1).filter("query_id = 1").first().score
    assert bounds.filter("query_id = 1").filter(F.col("bound") >= floor - postings.SLACK).count() == 1


# --- vectors ---

def plain_topk(queries, docs, k):
    unit = lambda v: v / max(np.linalg.norm(v), 1e-300)
    out = []
    for q, x in queries:
        sims = sorted((-round(float(unit(np.array(x)) @ unit(np.array(y))), 6) + 0.0, d) for d, y in docs)[:k]
        out += [(q, d, r + 1) for r, (_, d) in enumerate(sims)]
    return out


def test_cells_equal_brute_force_and_leave_rings_out(spark, tmp_path):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 8)) * 5
    docs = [(i, (centres[i % 12] + rng.standard_normal(8) * 0.3).tolist()) for i in range(600)]
    docs += [(700 + i, docs[3][1]) for i in range(200)] + [(990, [0.0] * 8)]  # a quarter is one vector; one has no direction
    queries = [(i, docs[i * 17][1]) for i in range(30)] + [(40, [0.0] * 8), (41, (-centres[0]).tolist())]
    d = spark.createDataFrame(docs + [(999, None)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame(queries + [(50, None)], "query_id long, embedding array<double>")
    store = cells.Cells.learn(d.filter("doc_id % 3 = 0"), str(tmp_path / "c"), 12)
    store.add(d.filter("doc_id % 3 <> 0"))
    assert spark.read.parquet(str(tmp_path / "c" / "rows")).count() == len(docs)
    top, searched = store.search(q, 5)
    want = plain_topk(queries, docs, 5)
    assert rows(top.select("query_id", "doc_id", "rank"), "query_id", "rank") == want
    assert rows(store.topk(q, 5, prune=False).select("query_id", "doc_id", "rank"), "query_id", "rank") == want
    share = searched.filter("query_id < 30").agg(F.sum("searched") / F.sum("rings")).first()[0]
    assert 0 < share < 0.6, share  # how good the cells are depends on where k-means ends


def test_cells_send_a_query_once_a_group(spark, tmp_path, monkeypatch):
    """Without clusters all rings are in reach; a query is sent to groups of rings, a ring with many rows lies in several blocks."""
    rng = np.random.default_rng(5)
    docs = [(i, rng.standard_normal(4).tolist()) for i in range(300)] + [(300 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(150)]
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>")
    q = d.filter("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(cells, "ROWS", 60)
    monkeypatch.setattr(cells, "GRID_BYTES", 0)
    sent, kept = [], cells.Cells._reaching
    monkeypatch.setattr(cells.Cells, "_reaching", lambda self, *more: sent.append(kept(self, *more)) or sent[-1])
    store = cells.Cells.learn(d, str(tmp_path / "c"), 16)
    top, searched = store.search(q, 5, prune=False)
    assert rows(top.select("query_id", "doc_id", "rank"), "query_id", "rank") == plain_topk([x for x in docs if x[0] % 5 == 0], docs, 5)
    r = searched.first()
    assert r.rings == r.searched == len(store.rings()["n"]) and r.rings > 20
    assert sent[0].count() < 90 * 12  # groups of rings, fewer than there are rings


def test_examples_are_added_once_and_sums_add_up(spark, tmp_path):
    rng = np.random.default_rng(3)
    every = [(i, int(rng.integers(0, 3)), rng.standard_normal(4).tolist()) for i in range(60)]
    store = examples.ExampleStore(spark, str(tmp_path / "e"))
    ddl = "example_id long, category int, embedding array<double>"
    for part in (every[:20], every[10:50], every + every[:5] + [(99, 1, None)], []):
        store.add(spark.createDataFrame(part, ddl))
    assert store.examples().count() == 60
    for r in store.centroids().collect():
        mine = np.array([v for _, c, v in every if c == r.category])
        assert r.n == len(mine) and r.embedding == pytest.approx(mine.mean(axis=0).tolist())
    assert spark.read.parquet(str(tmp_path / "e" / "sums")).groupBy("category").agg(F.max("n").alias("n")).count() == 3


def test_accepted_examples_bar_later_ones(spark):
    rng = np.random.default_rng(6)
    prototypes = [(0, 0, [1.0, 0.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0, 0.0])]
    candidates = [(i, f"three words {i}", i % 2, (np.round(rng.standard_normal(4), 1)).tolist()) for i in range(40)]
    candidates += [(50, "two words", 0, [0.0, 0.0, 0.0, 1.0]), (51, "three words 1", 1, [0.0, 0.0, 0.0, 1.0])]
    cos = lambda a, b: round(float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300)), 6)
    want, seen = {}, set()
    for i, text, c, v in sorted(candidates):
        kept = want.setdefault(c, [])
        if len(text.split()) < 3 or (c, text) in seen:
            continue
        seen.add((c, text))
        if all(cos(v, p) <= .5 for _, k, p in prototypes if k == c) and len(kept) < 4 and all(cos(v, p) <= .3 for _, p in kept):
            kept.append((i, v))
    got = intents.novel_examples(
        spark.createDataFrame(candidates, "query_id long, text string, category int, embedding array<double>"),
        spark.createDataFrame(prototypes, "doc_id long, category int, embedding array<double>"), 0.5, 4, 0.3)
    assert rows(got.select("category", "pos", "query_id")) == sorted((c, p + 1, i) for c, kept in want.items() for p, (i, _) in enumerate(kept))


def plain_kept(sets, threshold):
    kept = []
    for i in sorted(sets):
        if all(len(sets[i] & sets[k]) / len(sets[i] | sets[k]) <= threshold for k in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("in_task", [4_000_000, 150])
def test_keep_first_and_groups_equal_plain_ones(spark, in_task):
    rnd = random.Random(5)
    docs = [(i, " ".join(f"c{j}" for j in range(i * 2, i * 2 + 40))) for i in range(25)]  # a chain: each like its neighbours
    base = [f"b{j}" for j in range(40)]
    docs += [(100 + i, " ".join(base[:-1] + [f"x{rnd.randint(0, 3)}"] + ([f"y{i}"] if i % 4 == 0 else []))) for i in range(30)]  # a family
    docs += [(200 + i, " ".join(rnd.choices([f"r{j}" for j in range(60)], k=25))) for i in range(40)]
    docs += [(300, ""), (301, ""), (302, docs[3][1])]
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: set(t.split()) for i, t in docs if t}
    kept = hygiene.drop_duplicates(df, in_task=in_task)
    assert [r[0] for r in rows(kept.select("doc_id"))] == sorted(plain_kept(sets, .85) + [300])
    group = {i: i for i in sets}
    for _ in range(30):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > .85:
                    group[a] = group[b] = min(group[a], group[b])
    sizes = Counter(group.values())
    assert rows(hygiene.near_duplicate_groups(df).select("doc_id", "group_id")) == sorted((i, g) for i, g in group.items() if sizes[g] > 1)


@pytest.mark.parametrize("buckets", [1, 16, 1 << 21])
def test_prefixes_and_sketches_lose_no_similar_sets(spark, buckets):
    rnd = random.Random(8)
    sets = {i: {f"w{rnd.choice([9, 30, 99]) * rnd.random():.0f}" for _ in range(rnd.randint(1, 30))} for i in range(80)}
    sets |= {100 + i: (sets[i] - {min(sets[i])}) | {f"new{i % 3}"} for i in range(60)}
    reps = spark.createDataFrame([(i, sorted(s), len(s)) for i, s in sets.items()], "id long, items array<string>, n int")
    held = {r.id: r for r in setsim._prefixes(reps, 0.6, buckets).collect()}
    assert held.keys() == sets.keys()
    likenesses = 0
    for a, b in itertools.combinations(sets, 2):
        turned = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(held[a].sketch, held[b].sketch))
        assert turned <= len(sets[a] ^ sets[b])
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6:
            likenesses += 1
            assert {p.item for p in held[a].places} & {p.item for p in held[b].places}
    assert likenesses > 20


def test_equal_sets_are_grouped_by_their_keys(spark):
    rows_in = [(7, ["b", "a"]), (3, ["a", "b"]), (3, ["a", "b"]), (5, ["c"]), (6, []), (8, None), (9, ["a", "b"])]
    reps, same = setsim.set_groups(spark.createDataFrame(rows_in, "id long, items array<string>"))
    assert rows(reps.select("id", "items", "n")) == [(3, ["a", "b"], 2), (5, ["c"], 1)]
    assert rows(same) == [(3, 7), (3, 9)]


def test_connected_groups(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (95, 91), (7, 7)] + [(200, 300 + i) for i in range(50)]
    got = dict(rows(groups.connected(spark.createDataFrame(edges, "id_a long, id_b long"))))
    assert got == {**{i: 0 for i in range(61)}, **{i: 90 for i in (90, 91, 95, 100)}, 200: 200, **{300 + i: 200 for i in range(50)}}
    assert groups.connected(spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_hashed_embedding_takes_one_text_at_a_time_from_a_batch():
    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(1000)] + ["a", "", None]  # 300,000 terms
    batch = pa.array(texts)
    del texts
    tracemalloc.start()
    try:
        got = vectors.hashed_embedding(8).func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == 1003 and got[-1].as_py() == got[-2].as_py() == [0.0] * 8
    assert peak < 12 << 20, peak  # all texts as strings and all terms took 24 MB


def test_hashed_embedding_equals_counts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SEEN", 3)  # terms are forgotten and found again
    texts = ["B a_1 b Äb äB ٣", "", None, "a" * 5000, " ".join(f"t{i % 7}" for i in range(100)), "B a_1 b Äb äB ٣"]
    want = []
    for text in texts:
        n = Counter(int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 8 for t in re.findall(r"\w+", (text or "").lower()))
        norm = math.sqrt(sum(c * c for c in n.values()))
        want.append([n[b] / norm if norm else 0.0 for b in range(8)])
    udf = vectors.hashed_embedding(8)
    assert udf.func(pa.array(texts)).to_pylist() == want
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", udf("text").alias("v"))
    assert [list(r.v) for r in d.orderBy("doc_id").collect()] == want
    assert d.filter("doc_id < 0").count() == 0 and d.schema["v"].dataType.simpleString() == "array<double>"


def test_weighted_embedding_of_odd_texts(spark):
    d = spark.createDataFrame([(1, "a a b"), (2, "b"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in lexical.weighted_embeddings(d, 8).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3] == got[4] == [0.0] * 8
    assert all(sum(x * x for x in got[i]) == pytest.approx(1) for i in (1, 2))


def test_cells_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert cells.Cells.learn(none, str(tmp_path / "c")).topk(q, 3).count() == 0


@pytest.mark.parametrize("kw", [{}, {"broadcast_bytes": 0, "grid_rows": 17}])
def test_vector_topk_equals_brute_force(spark, kw):
    rng = np.random.default_rng(0)
    d = rng.normal(size=(90, 8)).round(2)
    d[40:70] = d[3]  # a third of all vectors are copies
    d[71] = 0
    q = rng.normal(size=(40, 8)).round(2)
    make = lambda m, name: spark.createDataFrame(
        [(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)], f"{name} long, embedding array<float>, g int")
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    f32 = lambda m: m.astype(np.float32).astype(np.float64)
    sims = np.round(unit(f32(q)) @ unit(f32(d)).T, 6)
    for within in (None, "g"):
        want = []
        for i in range(len(q)):
            ok = [j for j in range(len(d)) if within is None or j % 3 == i % 3]
            want += [(i, j) for j in sorted(ok, key=lambda j: (-sims[i, j], j))[:5]]
        got = vector.vector_topk(make(q, "query_id"), make(d, "doc_id"), 5, within=within, **kw)
        assert sorted(tuple(r) for r in got.select("query_id", "doc_id").collect()) == sorted(want)
        swapped = vector.vector_topk(make(d, "query_id"), make(q, "doc_id"), 1, within=within, **kw)
        assert swapped.count() == len(d)


def test_grid_copies_each_side_a_few_times():
    """Blocks grow with the tables, up to a bound of their bytes; small tables keep the rows asked for."""
    assert vector.grid_blocks(2_000, 2_000, 1000, 64, 8) == (2, 2)
    assert vector.grid_blocks(60_000, 60_000, 1000, 64, 12) == (7, 7)
    assert vector.grid_blocks(615_000, 615_000, 1000, 64, 12) == (19, 19)
    assert -(-615_000 // 19) * 64 * 8 <= vector.GRID_BYTES


def test_floor_is_reached_by_k_entries():
    rng = np.random.default_rng(3)
    for n, k in ((7, 5), (5, 5), (40, 1), (1000, 5), (1003, 20)):
        sims = rng.normal(size=(30, n)).round(1)
        floor = vector._floor(sims, k)
        assert ((sims >= floor[:, None]).sum(axis=1) >= min(n, k)).all()
    sims[:, 3] = np.nan
    assert (vector._floor(sims, 20) == np.partition(sims, 983, axis=1)[:, 983]).all()


def test_cells_in_small_pieces(spark, tmp_path, monkeypatch):
    """A task that may hold few distances at once finds the same."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    q = d.limit(40).withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(cells, "ENTRIES", 60)
    got = cells.Cells.learn(d, str(tmp_path / "c")).topk(q, 3)
    want = vector.vector_topk(q, d, 3)
    assert sorted(map(tuple, got.select("query_id", "doc_id", "score", "rank").collect())) == sorted(
        map(tuple, want.select("query_id", "doc_id", "score", "rank").collect()))


def test_whole_index_shuffles_texts_and_no_postings(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, None), (None, "c"), (1, "a d d")], "doc_id long, text string")
    rows = lexical.build_index(d).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan
    got = sorted((r.doc_id or 0, r.dl, r.term, r.tf) for r in rows.collect())
    assert got == [(0, 1, "", 1), (0, 1, "c", 1), (1, 3, "", 2), (1, 3, "a", 3), (1, 3, "b", 1), (1, 3, "d", 2)]


# --- set similarity ---

@pytest.mark.parametrize("threshold,strict", [(0.85, True), (0.8, False), (0.5, False)])
def test_similar_sets_equal_brute_force(spark, threshold, strict):
    rnd = random.Random(7)
    base = [set(rnd.sample(range(40), rnd.randint(1, 20))) for _ in range(40)]
    sets = [set(s) for s in base]
    for s in base:  # near copies
        t = set(s)
        t.add(rnd.randint(0, 60))
        sets.append(t)
    sets += [set(base[0])] * 40 + [set()]  # a third are copies of one set
    df = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in enumerate(sets)], "id long, items array<string>")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    want = set()
    for i, s in enumerate(sets):
        if not s:
            continue
        if first[frozenset(s)] != i:
            want.add((first[frozenset(s)], i))
            continue
        for j in range(i):
            if sets[j] and first[frozenset(sets[j])] == j:
                jac = len(s & sets[j]) / len(s | sets[j])
                if jac > threshold if strict else jac >= threshold:
                    want.add((j, i))
    for _ in (1,):
        got = setsim.similar_sets(df, threshold, strict).select("id_a", "id_b").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


# --- ranks and sessions ---

def test_running_and_sessions_over_slices(spark):
    rnd = random.Random(3)
    t, events = 0, []
    for i in range(600):
        t += rnd.choice([1, 299, 300, 301, 5000])
        events.append((rnd.choice([1, 1, 1, 2, 3]), t, i))
    df = spark.createDataFrame(events, "user_id long, s long, event_id long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    r = rows(ranks.running(df, ["ts", "event_id"], n=F.lit(1), total=F.col("event_id")), "n")
    assert [x[-2] for x in r] == list(range(1, 601)) and r[-1][-1] == sum(range(600))
    want, last, users = 0, {}, {}
    for u, s, _ in sorted(events, key=lambda e: e[1]):
        want += u not in last or s - last[u] > 300
        last[u] = s
        users[u] = users.get(u, 0) + 1
    got = sessions.sessionize(df)
    assert got.count() == want
    assert got.agg(F.sum("n_events")).first()[0] == 600


# --- fusion, context ---

def test_fusion_weights_and_threshold(spark):
    dense = spark.createDataFrame([(1, 10, .9, 1), (1, 11, .1, 2)], "query_id long, doc_id long, score double, rank long")
    lex = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank long")
    got = rows(fusion.fuse(dense, lex, 3, weights=(7, 3)).select("doc_id", "rank", "score", "rrf"), "rank")
    assert [g[0] for g in got] == [11, 10, 12]
    assert got[0][2] == pytest.approx(.7 * .1 + .3) and got[0][3] == pytest.approx(.7 / 62 + .3 / 61, abs=1e-8)


def _optimized(spark, texts, query, size):
    df = spark.createDataFrame([(1, query, i + 1, t) for i, t in enumerate(texts)], "query_id long, query string, rank int, text string")
    return [r[0] for r in context.optimize_context(df, size).orderBy("rank").select("text").collect()]


@pytest.mark.parametrize("size", ["small", "large"])
def test_counted_context_leaves_texts_in_place(spark, size):
    rows_of = [(i // 3, f"q {'test' if i % 2 else ''}", i % 3, "word, " * (900 * (i + 1))) for i in range(9)]
    df = spark.createDataFrame(rows_of, "query_id long, query string, rank int, text string")
    counted = written(df.groupBy("query_id").agg(F.sum(tx.token_estimate(F.col("text"))).alias("total")))
    known = written(df.join(counted, "query_id"))
    got = context.optimize_context(known, size, total="total")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got.drop("total"), "query_id", "query", "rank", "text") == rows(context.optimize_context(df, size), "query_id", "query", "rank", "text")


def test_context_fixtures(spark):
    small = _optimized(spark, ["A" * 3000, "B" * 2000], "test query", "small")
    assert len(small) == 2 and len(small[0]) == 1536
    large = _optimized(spark, ["A" * 5000, "B" * 2000], "test query", "large")
    assert large[0] == "A" * 1536 + "..." + "A" * 1536 and large[1] == "B" * 2000
    assert _optimized(spark, ["A" * 500, "B" * 800], "anything", "small") == ["A" * 500, "B" * 800]
    assert _optimized(spark, [], "anything", "small") == []


def test_store_decision():
    assert [incremental.needs(*a) for a in ((True, True, True), (False, False, True), (False, True, True), (False, True, False))] == [
        "rebuild", "rebuild", "incremental", "load"]


# --- quality ---

CONTEXT = ("The Roman Empire fell in 476 CE when Romulus Augustulus was deposed. "
           "Python is a language created by Guido van Rossum and released in 1991.")


def _one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(expr).first()[0]


def test_quality_functions(spark):
    q, r, c = F.col("q"), F.col("r"), F.col("c")
    rel = lambda a, b: _one(spark, ql.relevance(q, r), q=a, r=b)
    assert rel("When did the Roman Empire fall?", "The Roman Empire did fall in 476 CE, when it ended.") > .7
    assert rel("When did the Roman Empire fall?", "Bananas contain potassium and many other minerals too.") < .3
    assert rel("", "anything at all in the response") == .5
    claim = lambda t: _one(spark, ql.unsupported_claim(r, c), r=t, c=CONTEXT)
    assert not claim("The Roman Empire fell in 476 CE.")
    assert claim("I am certain that Napoleon conquered Jupiter yesterday.")
    assert not claim("I am certain that Python language created Guido.")
    issues = lambda t: _one(spark, F.size(ql.formatting_issues(r)), r=t)
    assert issues("A clean answer.") == 0
    assert issues("It stops here...") == 1
    assert issues("List:" + "\n- x" * 11) == 1
    assert issues("List:\n- a\n* b\n• c") == 1
    assert issues("Code:\n```python\nprint(1)") == 1
    fits = lambda a, b: _one(spark, ql.length_fits(q, r, "large"), q=a, r=b)
    assert fits("What is Python?", "It is a programming language, of course.")
    assert not fits("What is Python?", "word " * 201) and not fits("What is Python?", "Too short")
    ans = lambda a, b: _one(spark, ql.question_answered(q, r), q=a, r=b)
    assert ans("When was Python created?", "Python was created in 1991.")
    assert not ans("When was Python created?", "I like turtles.")
    assert ans("Tell me about Python", "Python is a language.")


def test_validate_modes(spark):
    text = "I cannot access that document today."
    assert _one(spark, fm.validate_response(F.col("r"), F.col("q")), r=text, q="x") == fm.NOT_COVERED
    assert _one(spark, fm.validate_response(F.col("r"), F.col("q"), literal=True), r=text, q="x") == text


# --- intent ---

@pytest.mark.parametrize("query,category,confidence", [
    ("find the parser", it.SEARCH, .98), ("Where can I find docs", it.SEARCH, .95), ("tl;dr the design", it.CONCISE, .95),
    ("hello", it.CONVERSATION, .95), ("how does the api work", it.DOCUMENT, .85), ("the parser of things", it.DOCUMENT, .6),
    ("parser", it.DOCUMENT, .5),
])
def test_pattern_rules(spark, query, category, confidence):
    df = spark.createDataFrame([(query,)], "q string")
    assert tuple(df.select(it.pattern_category(F.col("q")), it.pattern_confidence(F.col("q"))).first()) == (category, confidence)


def test_seed_tables():
    assert {k: len(v) for k, v in it.SEED_EXAMPLES.items()} == dict.fromkeys(it.SEED_DESCRIPTIONS, 10)
    assert all(len(v) == 4 for v in it.SEED_DESCRIPTIONS.values())


@pytest.mark.parametrize("name,expected", [
    ("regex", it.SEARCH), ("neural", it.SEARCH), ("hybrid", it.SEARCH), ("zero-shot", it.SEARCH), ("unheard-of", it.SEARCH),
])
def test_classifiers_by_name(spark, name, expected):
    df = spark.createDataFrame([(1, "Find configuration examples")], "query_id long, text string")
    row = classifiers.classify(df, name).first()
    assert row.category == expected and 0 < row.confidence <= 1.000001


def test_zero_shot_with_given_vectors(spark):
    """Four categories with orthogonal vectors; each query lies close to one."""
    axis = lambda i: [.95 if j == i else .05 for j in range(4)]
    names = [it.CONVERSATION, it.DOCUMENT, it.CONCISE, it.SEARCH]
    known = spark.createDataFrame([(i, n, axis(i)) for i, n in enumerate(names)], "doc_id long, category string, embedding array<double>")
    asked = spark.createDataFrame([(i, f"query {i}", axis(i)) for i in range(4)] + [(9, "unclear", [.25] * 4)],
                                  "query_id long, text string, embedding array<double>")
    got = {r.query_id: (r.category, r.score) for r in prototypes.classify_zero_shot(asked, known, .6).collect()}
    assert [got[i][0] for i in range(4)] == names and all(got[i][1] > .6 for i in range(4))
    assert got[9][0] == it.DOCUMENT

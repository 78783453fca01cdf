"""Operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from docweave.llm import (
    chosen_path, components, decontaminate, edit_fingerprints, hidden_markov, host_trust, induced_sort, lattice_pieces, license_scan,
    line_templates, substring_dedup, weak_labels, words,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def shingles(text, n):
    w = split(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def classes(documents, n, percent=80):
    sets = {i: shingles(t, n) for i, t in documents}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_words_and_slices():
    column = pa.array(["Ab  cD\n", None, "", "É É", "x"])
    got, begin = words.split_words(column)
    assert [w.decode() for w in got.to_pylist()] == ["ab", "cd", "É", "É", "x"] and begin.tolist() == [0, 2, 2, 2, 4, 5]
    batch = pa.record_batch({"text": pa.array(["a" * 10, "b" * 3, None, "c" * 30])})
    assert [p.num_rows for p in words.slices(batch, "text", 12)] == [1, 2, 1]


# near duplicates


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rng = np.random.default_rng(n)
    docs = []
    for family in range(12):
        base = [f"v{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(6):
            w = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 7)):
                w[at] = f"n{rng.integers(0, 10_000)}"
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = classes(docs, n)
    got = dict(rows(chosen_path.near_duplicates(df, shingle=n), "doc_id", "component_id"))
    assert got == want


def test_large_family_without_a_centre(spark, monkeypatch):
    """A chain of copies, each like its neighbours only, in nodes that count as large."""
    monkeypatch.setattr(chosen_path, "SMALL", 3)
    base = [f"v{i}" for i in range(100)]
    docs = [(i, " ".join([f"n{k}" for k in range(2 * i)] + base[2 * i:])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = dict(rows(chosen_path.near_duplicates(df, shingle=2), "doc_id", "component_id"))
    assert got == classes(docs, 2)


def test_spanning_links_join_what_links_join():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30, 20)) for _ in range(40)]
    inner = np.arange(40) < 15
    found = chosen_path._spanning(sets, inner, 60)
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))
    assert all(similar(sets[a], sets[b]) for a, b in found)
    reach = {i: i for i in range(40)}

    def top(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a, b in found:
        reach[top(a)] = top(b)
    for a in range(15):
        for b in range(40):
            assert not similar(sets[a], sets[b]) or top(a) == top(b)


def test_near_duplicates_odd(spark, odd):
    got = rows(chosen_path.near_duplicates(odd, shingle=5), "doc_id", "n_shingles", "component_id")
    by = {(i, n): c for i, n, c in got}
    assert len(got) == odd.count()
    assert by[(1, 116)] == by[(2, 116)] == 1 and by[(4, 0)] == 4 and by[(5, 0)] == 5 and by[(6, 0)] == 6
    assert by[(12, 1)] == 12 and (None, 116, None) in got
    once = chosen_path.distinct_documents(odd)
    assert once.columns == odd.columns
    kept = sorted(r[0] for r in rows(once.filter("doc_id is not null"), "doc_id"))
    assert kept.count(12) == 1 and 2 not in kept and 1 in kept and 4 in kept
    assert chosen_path.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (7, 6), (6, 5), (9, 9), (20, 10), (30, 20), (40, 30), (50, 40)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a bigint, b bigint")), "id", "component"))
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 10: 10, 20: 10, 30: 10, 40: 10, 50: 10}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# induced sorting and repeated bytes


@pytest.mark.parametrize("memory", [100, 1 << 20])
def test_suffix_order(memory):
    rng = np.random.default_rng(memory)
    for trial in range(60):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 80))
        t = np.append(np.tile(t, 1 + trial % 3), 0)
        order, common = induced_sort.suffix_order(t, memory)
        text = t.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        for a, b, n in zip(want, want[1:], common[1:].tolist()):
            assert text[a:a + n] == text[b:b + n] and text[a + n:a + n + 1] != text[b + n:b + n + 1]


def brute_repeats(texts, length):
    starts = defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            starts[b[i:i + length]].append((d, i))
    cover = [np.zeros(len(b), bool) for b in raw]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i:i + length] = True
    out = []
    for b, c in zip(raw, cover):
        edge = np.flatnonzero(np.diff(c.astype(int), prepend=0, append=0))
        kept = hashlib.sha256(bytes(x for x, gone in zip(b, c) if not gone)).hexdigest()
        out.append((len(b), int(c.sum()), len(edge) // 2, kept))
    return out


def test_repeated_bytes(spark):
    rng = np.random.default_rng(3)
    fresh = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared, period = fresh(700), "abcde" * 300
    texts = [fresh(900), shared, fresh(50) + shared + fresh(10), fresh(300) + shared[:399] + fresh(100), shared[100:560] + fresh(500),
             period, fresh(100) + period[:450], None, "", "short", "z" * 1000, fresh(2000), shared + fresh(30) + shared]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(rows(substring_dedup.repeated_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert [g[1:] for g in got] == brute_repeats(texts, 400)


def test_repeated_bytes_odd(spark, odd):
    got = rows(substring_dedup.repeated_bytes(odd), "doc_id", "n_bytes", "n_removed")
    assert len(got) == odd.count() and got.count((12, 1000, 1000)) == 2 and (4, 0, 0) in got
    assert all(r == n for i, n, r in got if i in (1, 2, None)) and substring_dedup.repeated_bytes(odd.limit(0)).count() == 0


def test_repeated_bytes_of_a_common_passage(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fresh = lambda n: "".join(rng.choice(list("abcdefg \n"), n))
    # each with surroundings of its own, some of which come twice
    passage, edges = fresh(300), [(fresh(200), fresh(200)) for _ in range(60)]
    texts = [a + passage + b for a, b in edges] + [edges[0][0] + passage + edges[1][1], edges[2][0] + passage + edges[2][1]]
    longer = fresh(500)
    texts += [fresh(150) + longer + fresh(150) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    want = brute_repeats(texts, 400)
    for limit in (4000, 1 << 20):
        monkeypatch.setattr(substring_dedup, "CORE_BYTES", limit)
        counted = []
        plain = substring_dedup._counted
        monkeypatch.setattr(substring_dedup, "_counted", lambda c, n: counted.append(c.count()) or plain(c, n))
        got = sorted(rows(substring_dedup.repeated_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
        monkeypatch.setattr(substring_dedup, "_counted", plain)
        assert [g[1:] for g in got] == want
        # beyond the limit the records of the passage's cores lie in no shard
        assert sum(counted) > 50 if limit == 4000 else not counted


# benchmark passages


def brute_contamination(documents, items, window=13):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for i, t in documents:
        own, hit, found = w(t), set(), set()
        for item, text in items:
            x = w(text)
            k = min(window, len(x))
            windows = {tuple(x[j:j + k]) for j in range(len(x) - k + 1)} if k else set()
            for j in range(len(own) - k + 1):
                if tuple(own[j:j + k]) in windows:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
        out.append((i, len(own), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return out


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_contamination(spark, block):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    items = [(k, " ".join(word(30))) for k in range(6)] + [(6, "Only, three words"), (7, None), (8, ""), (9, "... !"), (0, "again " * 20), (None, "no id here")]
    docs = [(i, " ".join(word(200) + items[i % 6][1].split()[i % 4:15 + i] + word(20))) for i in range(20)]
    docs += [(20, "only THREE words"), (21, None), (22, ""), (23, "again " * 13), (24, "has no id here"), (25, items[0][1]), (25, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(df, bench, block_bytes=block)
    named = [(i, n, h, sorted(x for x in ids if x != "None"), c) for i, n, h, ids, c in brute_contamination(docs, items)]
    key = lambda r: (r[0], r[1])
    assert sorted(rows(got, "doc_id", "n_words", "n_hit", "item_ids", "contaminated"), key=key) == sorted(named, key=key)
    best = {r[0]: r[1:] for r in rows(got.filter("doc_id = 25"), "doc_id", "longest_match", "longest_item", "longest_at", "spans")}
    assert best[25] == (30, "0", 0, [0, 30])


def test_contamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, "token3 token4 token5 token6 token7 token8")], "item_id bigint, text string")
    left = decontaminate.clean_documents(odd, bench)
    assert left.columns == odd.columns and sorted(i for i, in rows(left.filter("doc_id is not null"), "doc_id")) == [
        i for i in [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12, 14, 15]]
    assert {r[0] for r in rows(left, "n_words")} == {0}
    assert decontaminate.clean_documents(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


# language model


def test_forward_is_exact():
    """The scaled recursion against the sum over all state paths."""
    rng = np.random.default_rng(2)
    emit = rng.random((2, hidden_markov.SYMBOLS)) ** 3
    model = hidden_markov.Model(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), emit)
    symbols, begin = np.array([5, 9, 5, 7, 1, 2, 3], np.int32), np.array([0, 4, 7])
    order, log, *_ = hidden_markov._forward(model, symbols, begin, np.arange(2), False)
    for text, got in zip(order, log):
        own = symbols[begin[text]:begin[text + 1]]
        total = 0.0
        for path in range(2 ** len(own)):
            states = [path >> k & 1 for k in range(len(own))]
            p = model.start[states[0]] * emit[states[0], own[0]]
            for a, b, s in zip(states, states[1:], own[1:]):
                p *= model.move[a, b] * emit[b, s]
            total += p
        assert got == pytest.approx(np.log10(total))


def test_training_raises_likelihood():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, 40) + 60 * (k % 2) for k in range(40)]
    symbols, begin = np.concatenate(texts).astype(np.int32), np.arange(41) * 40
    base = np.full(hidden_markov.SYMBOLS, 1 / hidden_markov.SYMBOLS)
    model = hidden_markov._warm(symbols, begin, base, 2)
    assert np.allclose(model.emit.sum(axis=1), 1) and np.allclose(model.move.sum(axis=1), 1)
    logs = []
    for _ in range(4):
        counts = hidden_markov.Counts(2)
        counts.add(model, symbols, begin, np.arange(40))
        assert counts.emit.sum() == pytest.approx(len(symbols), rel=1e-4)
        logs.append(counts.log)
        model = hidden_markov._maximise(counts.start, counts.move, counts.emit, base)
    assert logs == sorted(logs)


def test_scores(spark, odd):
    train = F.col("doc_id") % 3 != 0
    got = hidden_markov.score_texts(odd, train, passes=1).collect()
    assert len(got) == odd.count()
    learned = Counter()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    for i, t in texts:
        if i is not None and i % 3 != 0:
            learned.update([*split(t), "\n"])
    total, distinct = sum(learned.values()), len(learned)
    want = Counter()
    for i, t in texts:
        tokens = [*split(t), "\n"]
        base = sum(np.log10((learned[w] + 1) / (total + distinct + 1)) for w in tokens)
        want[(i, len(tokens), sum(w in learned for w in tokens), total, f"{base:.6f}")] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}") for r in got) == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert hidden_markov.score_texts(odd.limit(0), train, passes=1).count() == 0


def test_scores_beat_the_unigram(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    held = hidden_markov.score_texts(docs, train).filter("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


# quality


def test_quality_on_held_out_labels(spark):
    folder = f"{DATA}/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = weak_labels.classify(docs, labels.filter("doc_id % 4 <> 0")).join(labels.filter("doc_id % 4 = 0"), "doc_id")
    share = lambda cond: got.filter(cond).agg(F.avg(F.col("accepted").cast("int"))).first()[0]
    assert share("quality = 1 and toxic = 0") > 0.97 and share("quality = 0") < 0.3


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(4000) < 0.4
    votes = [np.where(rng.random(4000) < 0.3, 0, np.where(rng.random(4000) < a, truth, ~truth).astype(int) * -1 + 2) for a in (0.95, 0.85, 0.6)]
    patterns = Counter("".join(map(str, v)) for v in zip(*votes))
    belief = weak_labels._em(list(patterns), np.array(list(patterns.values()), float), [0, 1, 2])
    right = [(belief["".join(map(str, v))] > 0.5) == t for v, t in zip(zip(*votes), truth) if any(v)]
    assert np.mean(right) > 0.85 and belief["120"] > 0.5 > belief["210"]


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert weak_labels.classify(odd, labels).count() == odd.count()
    assert weak_labels.classify(odd, None).count() == odd.count()
    assert weak_labels.accepted(odd, labels).columns == odd.columns
    assert weak_labels.classify(odd.limit(0), labels).count() == 0 == weak_labels.accepted(odd, labels.limit(0)).limit(0).count()


# pieces


def test_pieces_round_trip(spark, odd):
    got = lattice_pieces.encode(odd, check=True)
    assert got.filter("not lossless").count() == 0 and set(odd.columns) < set(got.columns)
    back = lattice_pieces.decode(got)
    assert back.filter(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0
    assert got.filter("text is null and piece_ids is not null").count() == 0
    again = lattice_pieces.encode(odd.repartition(5))
    assert Counter((r[0], tuple(r[1] or ())) for r in rows(got, "doc_id", "piece_ids")) == Counter(
        (r[0], tuple(r[1] or ())) for r in rows(again, "doc_id", "piece_ids"))
    assert lattice_pieces.encode(odd.limit(0)).count() == 0


def test_pieces_are_drawn_by_weight():
    """Drawn segmentations of one word against all of them."""
    pieces = lattice_pieces.load_pieces(alpha=0.3)
    names = {pieces.content[i].as_py().decode("utf-8", "replace"): i for i in range(259, len(pieces.content))}
    word = " then"

    def every(rest):
        if not rest:
            return [()]
        return [(names[rest[:k]], *tail) for k in range(1, len(rest) + 1) if rest[:k] in names for tail in every(rest[k:])]

    weight = {s: np.exp(sum(pieces.weight[i] for i in s)) for s in every(word)}
    total = sum(weight.values())
    n = 20_000
    got = lattice_pieces.Encoder(pieces)(pa.array(["then"] * n), pa.array(np.arange(n)))["piece_ids"]
    seen = Counter(map(tuple, got.to_pylist()))
    assert set(seen) <= set(weight)
    for s, w in weight.items():
        p = w / total
        assert abs(seen[s] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


# lines, hosts and licences


def test_lines(spark, odd):
    def lines(i):
        letter = chr(97 + i)
        return f"Own{letter} start of a text that nobody else has\nRead the terms of page {i} before you go on\nend {letter}x of it"

    docs = [(i, lines(i)) for i in range(12)] + [(100 + i, "same\nold\ntext") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r[0]: r[1:] for r in rows(line_templates.drop_recurring(df, min_docs=10), "doc_id", "n_lines", "n_dropped", "text")}
    assert got[0] == (3, 0, lines(0)) and got[5][1] >= 1 and "Read the terms" not in got[5][2]
    assert got[105] == (3, 0, "same\nold\ntext")  # copies are no recurring lines
    assert line_templates.drop_recurring(odd).count() == odd.count()
    assert line_templates.cleaned(odd).columns == odd.columns and line_templates.cleaned(odd.limit(0)).count() == 0
    assert rows(line_templates.drop_recurring(odd).filter("doc_id = 4"), "text", "n_lines") == [(None, 0)]


def test_lines_with_equal_surroundings(spark):
    block = ["Terms of this site", "all pages are given as they are", "no part of them may be sold", "write to us for more", "End of the terms"]
    own = [f"Only {chr(97 + i)}{chr(97 + i)} has this" for i in range(12)]
    docs = [(i, "\n".join([o, "", "Sign up for our letter", "", f"{o} too"])) for i, o in enumerate(own)]
    docs += [(100 + i, "\n".join([f"x {o}", *block, f"y {o}"])) for i, o in enumerate(own)]
    docs += [(200 + i, f"This page was moved by its old owner to the place {o}") for i, o in enumerate(own)]
    docs += [(300 + i, "one\nold\ntext\nof five\nlines") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r[0]: r[1:] for r in rows(line_templates.drop_recurring(df, min_docs=10), "doc_id", "n_dropped", "text")}
    for i, o in enumerate(own[1:], 1):
        assert got[i] == (1, f"{o}\n\n\n{o} too") and got[100 + i] == (5, f"x {o}\ny {o}") and got[200 + i] == (1, "")
    assert all(got[k][0] == 0 for k in (0, 100, 200)) and all(got[300 + i][0] == 0 for i in range(20))


def test_lines_with_new_surroundings(spark):
    """With surroundings, a template counts the documents that bring it between new neighbours."""
    docs = [(i, f"{chr(97 + i)} one\nsame words here\n{chr(97 + i)} two") for i in range(10)]
    docs += [(100 + i, f"fixed before\nframed line\nfixed after\nown{chr(97 + i)}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r[0]: r[1:] for r in rows(line_templates.drop_recurring(df, min_docs=10, surroundings=True), "doc_id", "n_dropped", "text")}
    assert got[0][0] == 0 and got[3] == (1, "d one\nd two")
    # "fixed after" stands before ten own lines; the two lines above it always have the same neighbours
    assert got[100][0] == 0 and got[105] == (1, "fixed before\nframed line\nownf")


def test_hosts(spark):
    rules = [host_trust.Rule("allow", "good.test", "/"), host_trust.Rule("block", "bad.test", "/"), host_trust.Rule("block", "good.test", "/ads/")]
    pages = [
        (1, "https://good.test/a", '<a href="https://friend.test/x">'), (2, "HTTP://Sub.Good.test/ads/1?q", ""), (3, "http://friend.test", None),
        (4, "http://bad.test/z#f", '<a href="http://friend.test">'), (5, "http://shady.test/p", '<a href=http://bad.test/z> <a href="/own">'),
        (6, None, None), (7, "no scheme", "<a href='//bad.test'>"), (8, "http://alone.test/", ""), (8, "http://alone.test/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = sorted(rows(host_trust.judge(df, rules), "page_id", "host", "path", "rule", "verdict"))
    assert got == [
        (1, "good.test", "/a", "good.test/", "allow"), (2, "sub.good.test", "/ads/1", "good.test/ads/", "block"), (3, "friend.test", "", None, "allow"),
        (4, "bad.test", "/z", "bad.test/", "block"), (5, "shady.test", "/p", None, "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "alone.test", "/", None, "allow"), (8, "alone.test", "/", None, "allow")]
    assert host_trust.judge(df.limit(0), rules).count() == 0


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/f.py", "x = 1"), (3, "a/b/g.py", "# Licensed under the Apache License, Version 2.0."),
        (4, "c/d.py", "nothing"), (5, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "a/h.py", None),
        (7, None, "All rights reserved."), (8, "ab/i.py", ""), (8, "ab/i.py", ""), (9, "a/b/c/d.py", "copyright notice of another kind altogether, see elsewhere"),
    ]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    got = sorted(rows(license_scan.scan(df), "doc_id", "license", "origin", "from_dir"))
    assert got == [
        (1, "MIT", "own", None), (2, "GPL-3.0", "inherited", "a/b"), (3, "Apache-2.0", "own", None), (4, None, None, None), (5, "GPL-3.0", "own", None),
        (6, "MIT", "inherited", "a"), (7, "Proprietary", "own", None), (8, None, None, None), (8, None, None, None), (9, "GPL-3.0", "inherited", "a/b")]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_wrapped_licences(spark):
    import textwrap

    files = [(999, "src/LICENSE", "Released under the MIT License.")]
    for i, (_, t) in enumerate(license_scan.TEMPLATES):
        for k, (width, mark) in enumerate(((72, "# "), (40, " * "), (1000, ""))):
            notice = "\n".join(mark + x for x in textwrap.wrap(t, width))
            files.append((10 * i + k, f"src/f{i}_{k}.py", f"#!/bin/run\n{mark}\n{notice}\n{mark}\nvalue = {i}\nother = value + {k}\n"))
    files += [(1000, "src/plain.py", "first = 1\nsecond = first\n")]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    got = {r[0]: r[1:] for r in rows(license_scan.scan(df), "doc_id", "license", "origin")}
    assert got[1000] == ("MIT", "inherited")
    for i, (name, _) in enumerate(license_scan.TEMPLATES):
        assert [got[10 * i + k] for k in range(3)] == [(name, "own")] * 3


# fingerprints


def plain_walk(text):
    """The notes of the walk, step by step."""
    classes, out, at, t = edit_fingerprints._classes(text), [], 0, 0
    rest = 0
    while at < len(classes):
        if not rest:
            rest = int(edit_fingerprints.WAITS[(t % edit_fingerprints.PERIOD) * 256 + int(classes[at])])
        out.append(int(classes[at]))
        t, rest = t + 1, rest - 1
        at += not rest
    return bytes(out)


def plain_print(text):
    notes, level = plain_walk(text), 0
    while len(notes[::1 << level]) > edit_fingerprints.SAMPLES:
        level += 1
    return level, notes[::1 << level]


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprints(spark, odd, parts):
    df = odd.filter("length(text) < 20000 or text is null").unionByName(odd.filter("doc_id = 9").withColumn("doc_id", F.lit(-5).cast("bigint")))
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()), reverse=True)
    want = Counter()
    for k, (has, i, t) in enumerate(texts):
        follow = texts[(k + 1) % len(texts)][2]
        third = len(t) // 3
        edited = t[:len(t) - third] + follow[:third]
        mine, theirs = plain_print(t), plain_print(edited)
        want[(i if has else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), edit_fingerprints.spelled(mine), edit_fingerprints.spelled(theirs),
              edit_fingerprints.likeness(mine, theirs), edit_fingerprints.likeness(mine, plain_print(follow)))] += 1
    got = edit_fingerprints.fingerprints(df, parts=parts)
    assert Counter(rows(got, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want
    assert edit_fingerprints.fingerprints(df.limit(0), parts=parts).count() == 0


def test_likeness_follows_edits():
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefgh ijkl"), 4000))
    few, many = text, text
    for k in range(40):
        at = int(rng.integers(0, 4000))
        many = many[:at] + "xy"[k % 2] * (k % 3) + many[at + 1:]
        few = many if k == 4 else few
    prints, *_ = edit_fingerprints.fingerprints_of([text, few, many, text[::-1]])
    near = [edit_fingerprints.likeness(prints[0], p) for p in prints]
    assert near[0] == 1 and near[1] > 0.85 and near[1] > near[2] > near[3] and near[3] < 0.3


def test_near_links(spark):
    rng = np.random.default_rng(11)
    base = ["".join(rng.choice(list("abcdefgh ijkl"), 3000)) for _ in range(5)]
    docs = [(i, base[i % 5][:1500] + ("" if i < 5 else f"edit {i} ") + base[i % 5][1500:]) for i in range(40)] + [(40, None), (41, "")]
    prints = edit_fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = {r[0]: r[1:] for r in rows(edit_fingerprints.near_links(prints), "doc_id", "near_id", "likeness")}
    # bands may miss a copy near the threshold, but never join different texts
    assert set(got) <= set(range(5, 40)) and len(got) >= 32 and all(n % 5 == i % 5 and x >= 0.8 for i, (n, x) in got.items())


def test_planted_pairs_among_half_alike_sets(spark, monkeypatch):
    """Sets that share boilerplate (0.6 alike) fill large nodes without being linked; pairs at 0.8 among them are found."""
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(150)]
    docs = []
    for i in range(150):
        own = [f"d{i}x{j}" for j in range(50)]
        docs.append((2 * i, " ".join(common + own)))
        # 21 of 199 shingles differ on each side: 178 of 220
        docs.append((2 * i + 1, " ".join(common + own[:29] + [f"e{i}x{j}" for j in range(21)])))
    order = rng.permutation(len(docs))
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    monkeypatch.setattr(chosen_path, "BLOCK", 64)
    df = spark.createDataFrame([docs[i] for i in order], "doc_id bigint, text string")
    got = dict(rows(chosen_path.near_duplicates(df, shingle=2), "doc_id", "component_id"))
    assert got == classes(docs, 2) and all(got[2 * i + 1] == 2 * i for i in range(150))

"""Files, stores and streams."""

import json

import pytest
from pyspark.sql import functions as F

from docweave import api
from docweave.operators import chunking
from docweave.sources import files
from docweave.streaming import jobs


def _folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("line one\nline two\nline three")
    (tmp_path / "sub" / "b.py").write_text("def f():\n    return 1\n")
    (tmp_path / "c.csv").write_text("name,age\nAda,36\nBob,\n")
    (tmp_path / "d.csv").write_text("city\nRome\n")
    (tmp_path / "e.json").write_text(json.dumps({"k": [1, 2]}, indent=1))
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "f.bin").write_bytes(b"\x00")
    (tmp_path / "g.md").write_bytes(b"caf\xc3\xa9 \xff!")
    return str(tmp_path)


def test_load_files(spark, tmp_path):
    folder = _folder(tmp_path)
    got = {(r.relative_path, r.filetype, r.text) for r in files.load_files(spark, folder).collect()}
    assert got == {
        ("a.txt", "txt", "line one\nline two\nline three"), ("sub/b.py", "py", "def f():\n    return 1\n"),
        ("c.csv", "csv", "name: Ada\nage: 36"), ("c.csv", "csv", "name: Bob\nage: "), ("d.csv", "csv", "city: Rome"),
        ("e.json", "json", '{"k":[1,2]}'), ("g.md", "md", "café !"),
    }
    assert {r.filename for r in files.load_files(spark, folder, [".txt"]).collect()} == {"a.txt"}
    assert files.load_files(spark, folder + "/none").count() == 0
    stats = {r.filetype: r.files for r in files.file_stats(spark, folder).collect()}
    assert stats["csv"] == 2
    chunks = api.ingest(spark, folder, ["txt", "py"])
    assert chunks.count() >= 2 and chunks.filter("source is null").count() == 0


def test_csv_records_across_lines_and_splits(spark, tmp_path):
    import csv
    import io
    import random

    rnd, want = random.Random(3), set()
    for name, head in (("a", ["id", "note"]), ("b", ["x", "y", "z"])):
        rows = [[str(i), *(rnd.choice(['plain', 'a,b', 'say "hi"', 'two\nlines', '"', ',\n"', '', 'é ü', ' 5" pipe', '\n\n,"\n'])
                           for _ in head[1:])] for i in range(300)]
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\r\n" if name == "b" else "\n")
        w.writerow(head)
        for i, r in enumerate(rows):
            w.writerow(r[:-1] if i == 7 else [*r, "surplus"] if i == 8 else r)
            if i == 9:
                out.write("\n")
            r = [*r[:-1], ""] if i == 7 else r
            want.add((f"{name}.csv", "\n".join(f"{h}: {v}" for h, v in zip(head, r))))
        (tmp_path / f"{name}.csv").write_text(out.getvalue(), newline="")
    (tmp_path / "stray.csv").write_text('k,size\n1,5" pipe\n2,"6"" pipe"\n')
    want |= {("stray.csv", 'k: 1\nsize: 5" pipe'), ("stray.csv", 'k: 2\nsize: 6" pipe')}
    (tmp_path / "head.csv").write_text("only,head\n")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [(r.filename, r.text) for r in files.load_files(spark, str(tmp_path), ["csv"]).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small[0])
        spark.conf.set("spark.sql.files.openCostInBytes", small[1])
    assert set(got) == want and len(got) == len(want)


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """No reader of Spark's lists the folders, so the driver holds no list; names, hidden and empty files are treated as by these readers."""
    for name, data in (("a b%.txt", b"x"), ("sub/_k=1/k.txt", b"k"), ("sub/_hid/h.txt", b"h"), (".h.txt", b"h"), ("empty.txt", b""), ("U.TXT", b"u"),
                       ("m.md", b"\xef\xbb\xbfm"), ("c.csv", b'\xef\xbb\xbfk,v\r\n1,"a\nb"\r\n' + b"2,c\n" * 200)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(files, "PART_BYTES", 50)
    monkeypatch.setattr(files, "WALKED", 2)
    monkeypatch.setattr(files, "TASK_FOLDERS", 1)
    loaded = files.load_files(spark, str(tmp_path), ["txt", "md", "csv"])
    got = sorted((r.relative_path, r.text) for r in loaded.collect())
    assert got == [("a%20b%25.txt", "x"), ("c.csv", "k: 1\nv: a\nb")] + [("c.csv", "k: 2\nv: c")] * 200 + [("m.md", "\ufeffm"), ("sub/_k=1/k.txt", "k")]
    assert all(not f.startswith(f"file://{tmp_path}") for f in loaded.inputFiles())
    assert {r.filetype: r.files for r in files.file_stats(spark, str(tmp_path)).collect()} == {"txt": 3, "md": 1, "csv": 1}
    assert files.load_files(spark, [str(tmp_path / "sub"), str(tmp_path / "none")]).count() == 0
    assert files.load_files(spark, f"{tmp_path}/s*b", ["txt"]).count() == 1


def test_refresh_store(spark, tmp_path):
    store = str(tmp_path / "store")
    docs = [(i, f"text number {i} " * 5) for i in range(20)]
    make = lambda d: spark.createDataFrame(d, "doc_id long, text string")
    assert api.refresh(spark, make(docs), store) == "rebuild"
    assert api.refresh(spark, make(docs), store) == "load"
    changed = docs[1:] + [(99, "a new one")]
    changed[0] = (1, "edited")
    assert api.refresh(spark, make(changed), store) == "incremental"
    got = {(r.doc_id, r.text) for r in api.chunks_of(spark, store).collect()}
    assert got == {(d, t.strip()) for d, t in changed}
    assert api.refresh(spark, make(changed), store, force=True) == "rebuild"
    assert {(r.doc_id, r.text) for r in api.chunks_of(spark, store).collect()} == got


def test_refresh_writes_touched_buckets_only(spark, tmp_path):
    store, docs = str(tmp_path / "store"), [(i, f"text number {i}") for i in range(60)]
    make = lambda d: spark.createDataFrame(d, "doc_id long, text string")
    assert api.refresh(spark, make(docs), store, buckets=8) == "rebuild"
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    docs[7] = (7, "edited")
    assert api.refresh(spark, make(docs), store) == "incremental"
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    new = set(after) - set(before)
    assert before.items() <= after.items() and len({f.parent.name for f in new}) == 1 and len(new) == 2
    assert {(r.doc_id, r.text) for r in api.chunks_of(spark, store).collect()} == set(docs)
    assert api.refresh(spark, make([]), store) == "incremental" and api.chunks_of(spark, store).count() == 0
    assert api.refresh(spark, make([]), store) == "load"
    assert api.refresh(spark, make([]), str(tmp_path / "none")) == "rebuild" and api.chunks_of(spark, str(tmp_path / "none")).count() == 0


def test_answer_and_evaluate(spark):
    corpus = spark.createDataFrame([(1, "the parser reads tokens"), (2, "cats sleep all day")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "how does the parser code work"), (2, "hello")], "query_id long, text string")
    got = {r.query_id: r for r in api.answer_inputs(queries, corpus).collect()}
    assert "the parser reads tokens" in got[1].prompt and got[2].prompt is None and got[2].category == "CONVERSATION"
    hits = spark.createDataFrame([(1, 1, "the parser reads tokens")], "query_id long, rank int, text string")
    answers = spark.createDataFrame([(1, "how does the parser work?", "The parser reads tokens and does its work.")],
                                    "query_id long, query string, response string")
    r = api.evaluate(answers, hits).first()
    assert r.overall > .8 and not r.regenerate


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        files.append_feedback(spark.createDataFrame([(i, i)], "entry_id long, ts long"), path)
    assert [r.entry_id for r in files.load_feedback(spark, path, 2).collect()] == [2, 1]


def _entries(spark, first, last):
    n = F.col("id")
    return spark.range(first, last).select(
        n.alias("entry_id"), n.alias("query_id"), F.lit(0).alias("predicted"), (n % 3).cast("int").alias("correct"),
        F.lit(.9).alias("confidence"), (n % 3 == 0).alias("is_correct"), F.timestamp_seconds(n).alias("ts"))


def test_learning_stream_updates_every_interval(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = _entries(spark, 0, 1).schema
    for at, to in ((0, 30), (30, 60), (60, 62), (62, 230)):
        _entries(spark, at, to).repartition(3).write.mode("append").parquet(src)
        jobs.learning_stream(spark.readStream.schema(schema).parquet(src), out, cp, per_category=7).awaitTermination()
    counts = [(r.total, r.updates) for r in spark.read.parquet(f"{out}/counts").orderBy("epoch").collect()]
    assert counts == [(30, 0), (60, 1), (62, 1), (230, 4)]
    learned = spark.read.parquet(f"{out}/examples").collect()
    want = set()
    for update in range(4):  # the newest seven wrong ones of each category among its fifty entries
        for c in (1, 2):
            want |= {(q, c, update + 1) for q in [q for q in range(update * 50, update * 50 + 50) if q % 3 == c][-7:]}
    assert {(r.query_id, r.category, r.update_no) for r in learned} == want and len(learned) == len(want)
    assert spark.read.parquet(f"{out}/pending").groupBy("epoch").count().orderBy("epoch").collect()[-1]["count"] == 30


def test_corpus_stream_replaces_and_deletes(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "doc_id long, version int, text string"
    for v, docs in enumerate([[(1, 0, "one"), (2, 0, "two"), (3, 0, "three")], [(1, 1, "one"), (2, 1, "TWO"), (3, 1, None)]]):
        spark.createDataFrame(docs, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.corpus_stream(spark.readStream.schema(schema).parquet(src), chunking.chunk_fixed, out, cp).awaitTermination()
    got = {(r.doc_id, r.text) for r in jobs.current_chunks(spark, out).collect()}
    assert got == {(1, "one"), (2, "TWO")}
    assert spark.read.parquet(f"{out}/documents").filter("epoch = 1").count() == 2  # the unchanged one is left alone


def test_history_stream_over_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    events = [(1, s, i) for i, s in enumerate([*range(0, 150, 10), 1000, 1010])]
    schema = "user_id long, ts timestamp, event_id long"
    for part in (events[:8], events[8:]):
        df = spark.createDataFrame(part, "user_id long, s long, event_id long")
        df.select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id").coalesce(1).write.mode("append").parquet(src)
        jobs.history_stream(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination()
    got = sorted((r.back, r.event_id) for r in jobs.current_histories(spark, out).collect())
    assert got == [(1, 16), (2, 15)]


def test_history_state_goes_when_sessions_are_over(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "user_id long, ts timestamp, event_id long"
    held = []
    for part in ([(u, 1000 + u, u) for u in range(20)], [(100, 5000, 100)], [(101, 9000, 101), (3, 9001, 102)]):
        df = spark.createDataFrame(part, "user_id long, s long, event_id long")
        df.select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id").repartition(2).write.mode("append").parquet(src)
        query = jobs.history_stream(spark.readStream.schema(schema).parquet(src), out, cp)
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[0] == 20 and held[1] == 1 and held[2] == 2
    got = {(r.user_id, r.event_id) for r in jobs.current_histories(spark, out).collect()}
    assert got == {(u, u) for u in range(20) if u != 3} | {(100, 100), (101, 101), (3, 102)}


@pytest.mark.parametrize("files", [1, 3])
def test_table_stream_reads_a_file_and_a_folder(spark, tmp_path, files):
    """A table may be one file or a folder of files beside other tables."""
    for name in ("documents", "labels"):
        spark.range(9 if name == "documents" else 4).selectExpr("id AS doc_id", "concat('t', id) AS text").repartition(files).write.parquet(
            f"{tmp_path}/{name}.parquet" if files > 1 else f"{tmp_path}/parts/{name}")
    if files == 1:
        [part] = (tmp_path / "parts" / "documents").glob("*.parquet")
        (tmp_path / "documents.parquet").write_bytes(part.read_bytes())
    docs = jobs.table_stream(spark, str(tmp_path), "documents").select("doc_id", F.lit(0).alias("version"), "text")
    out = f"{tmp_path}/out"
    jobs.corpus_stream(docs, chunking.chunk_fixed, out, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.doc_id for r in jobs.current_chunks(spark, out).collect()) == list(range(9))


def test_write_files(spark, tmp_path):
    """A file in a folder of its own per name; equal names share one, null lines are empty."""
    rows = [(f"docs/doc_id={i}/part.txt", f"é {i}\nmore") for i in range(300)] + [
        ("docs/doc_id=7/part.txt", "twice"), ("docs/doc_id=none/part.txt", None), ("pages/p/part.json", '{"url":"u"}')]
    at = f"{tmp_path}/tree"
    files.write_files(spark.createDataFrame(rows, "name string, line string"), at)
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    former = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    loaded = files.load_files(spark, at, ["txt", "json"])
    sc.setJobGroup("other", "other")
    stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup("listing")
              for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert sum(s.numTasks for s in stages) <= 4 * sc.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == former
    got = {r.relative_path: r.text for r in loaded.collect()}
    assert len(got) == 302 and got["docs/doc_id=3/part.txt"] == "é 3\nmore\n" and got["pages/p/part.json"] == '{"url":"u"}'
    assert sorted(got["docs/doc_id=7/part.txt"].split("\n")) == ["", "more", "twice", "é 7"] and got["docs/doc_id=none/part.txt"] == "\n"
    assert {r.filetype: r.files for r in files.file_stats(spark, at).collect()} == {"txt": 301, "json": 1}

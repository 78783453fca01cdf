"""Files and stores: tables written to files of the shared folder, loaded again and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave import api
from docweave.operators import chunking, feedback
from docweave.operators.tables import shared_folder
from docweave.plans import derived
from docweave.plans.corpus import CHUNKS
from docweave.plans.derived import with_inputs
from docweave.plans.registry import query
from docweave.sources import files
from docweave.sources.tables import table


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"


def _tree(spark, sf) -> str:
    """A text file per document, a JSON file per page, and the benchmark as CSV."""
    at = _folder(spark)
    for name, rows in (("docs/doc_id=%s/part.txt", table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("line"))),
                       ("pages/page_id=%s/part.json", table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.to_json(F.struct("url")).alias("line")))):
        files.write_files(rows.select(F.format_string(name, F.coalesce(F.col("id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))).alias("name"), "line"), at)
    table(spark, sf, "benchmark").select("item_id", "text").write.option("header", True).option("escape", '"').csv(f"{at}/items")
    return at


@query("ingest_files", """
SELECT 'txt' AS filetype, 'docs/doc_id=' || doc_id AS folder, md5(text || chr(10)) AS text_key FROM documents
UNION ALL SELECT 'json', 'pages/page_id=' || page_id, md5('{"url":"' || url || '"}') FROM pages
UNION ALL SELECT 'csv', 'items', md5('item_id: ' || item_id || chr(10) || 'text: ' || text) FROM benchmark""")
def ingest_files(spark, sf):
    loaded = files.load_files(spark, _tree(spark, sf), ["txt", ".JSON", "csv", "exe"])
    return loaded.select("filetype", F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1).alias("folder"), F.md5("text").alias("text_key"))


@query("ingest_csv", """
SELECT 'documents' AS folder, md5('doc_id: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'text: ' || text) AS text_key FROM documents
UNION ALL SELECT 'items', md5('item_id: ' || item_id || chr(10) || 'text: ' || text) FROM benchmark""")
def ingest_csv(spark, sf):
    """CSV files of two headers in one folder; texts hold line breaks and quotes."""
    at = _folder(spark)
    for name, rows in (("documents", table(spark, sf, "documents").select("doc_id", "lang", "text")), ("items", table(spark, sf, "benchmark").select("item_id", "text"))):
        rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(f"{at}/{name}")
    loaded = files.load_files(spark, at, ["csv"])
    return loaded.select(F.regexp_extract("relative_path", "^([^/]*)/", 1).alias("folder"), F.md5("text").alias("text_key"))


@query("ingest_types", "SELECT doc_id, length(text)::BIGINT + 1 AS n_chars FROM documents")
def ingest_types(spark, sf):
    """Only the text files of the same folders."""
    loaded = files.load_files(spark, _tree(spark, sf), ["txt"])
    return loaded.select(F.regexp_extract("source", "doc_id=([0-9]+)/", 1).cast("bigint").alias("doc_id"),
                         F.length("text").cast("bigint").alias("n_chars"))


@query("ingest_chunks", """
WITH files AS (SELECT doc_id, text || chr(10) AS text FROM documents)
SELECT doc_id, i AS chunk_index, md5(substr(text, i * 1000 + 1, 1000)) AS text_key
FROM (SELECT *, unnest(range(0, ceil(length(text) / 1000.0)::BIGINT)) AS i FROM files)""")
def ingest_chunks(spark, sf):
    chunks = api.ingest(spark, _tree(spark, sf), ["txt"], lambda d: chunking.chunk_fixed(d, 1000))
    return chunks.select(F.regexp_extract("source", "doc_id=([0-9]+)/", 1).cast("bigint").alias("doc_id"),
                         "chunk_index", F.md5("text").alias("text_key"))


@query("file_stats", """
SELECT 'txt' AS filetype, count(*) AS files FROM documents UNION ALL SELECT 'json', count(*) FROM pages""")
def file_stats(spark, sf):
    return files.file_stats(spark, _tree(spark, sf)).filter("filetype IN ('txt', 'json')").select("filetype", "files")


@query("store_refresh", """
WITH new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' rev2' ELSE text END AS text
  FROM documents WHERE doc_id % 10 <> 1)
SELECT doc_id, i AS chunk_index, md5(substr(text, i * 1000 + 1, 1000)) AS text_key, 'rebuild,incremental,load' AS steps
FROM (SELECT *, unnest(range(0, ceil(length(text) / 1000.0)::BIGINT)) AS i FROM new)""")
def store_refresh(spark, sf):
    """A store built from one state of the corpus, brought to the next one, and found up to date."""
    store = _folder(spark)
    old, new = derived.snapshots(spark, sf)
    steps = [api.refresh(spark, corpus, store, chunker=lambda d: chunking.chunk_fixed(d, 1000)) for corpus in (old, new, new)]
    return api.chunks_of(spark, store).select("doc_id", "chunk_index", F.md5("text").alias("text_key"), F.lit(",".join(steps)).alias("steps"))


@query("chunks_json", f"WITH {CHUNKS} SELECT doc_id, chunk_index, md5(text) AS text_key, source FROM chunks")
def chunks_json(spark, sf):
    at = _folder(spark)
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    files.write_chunks_json(chunking.chunk_fixed(docs, 1000).select("doc_id", "chunk_index", "text", "source"), at, by="source")
    back = spark.read.schema("doc_id bigint, chunk_index bigint, text string, source string").json(at)
    return back.select("doc_id", "chunk_index", F.md5("text").alias("text_key"), "source")


@query("feedback_log", with_inputs("feedback", "SELECT entry_id, query_id, predicted, correct, confidence, is_correct FROM feedback"))
def feedback_log(spark, sf):
    """The log appended in three parts and read back without a limit."""
    at, log = _folder(spark), derived.feedback(spark, sf)
    for part in range(3):
        files.append_feedback(log.filter(F.col("entry_id") % 3 == part), at)
    return files.load_feedback(spark, at, newest=None).drop("ts")


@query("examples_store", with_inputs("feedback", """--cte
wrong AS (SELECT query_id, correct AS category, row_number() OVER (PARTITION BY correct ORDER BY ts DESC, entry_id DESC) AS pos
  FROM feedback WHERE NOT is_correct AND confidence >= 0.3)
SELECT query_id, category, pos FROM wrong WHERE pos <= 30"""))
def examples_store(spark, sf):
    """Examples learned from the whole log, saved over an earlier state and read back."""
    at, log = _folder(spark), derived.feedback(spark, sf)
    none = spark.createDataFrame([], "query_id bigint, category int")
    files.save_examples(log.select("query_id", F.col("correct").alias("category")), at)
    files.save_examples(feedback.learn_examples(log, none, min_confidence=0.3, recent=None).select("query_id", "category", "pos"), at)
    return spark.read.parquet(at)

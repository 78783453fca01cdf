"""Jobs that combine operators: ingest, refresh, answer, evaluate."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import quality
from docweave.functions.vectors import hashed_embedding
from docweave.operators import chunking, context, fusion, incremental, intents
from docweave.operators.tables import written
from docweave.sources import files
from docweave.sources.tables import exists

Chunker = Callable[[DataFrame], DataFrame]


def ingest(spark: SparkSession, paths: str | list[str], types: list[str] | None = None,
           chunker: Chunker = chunking.chunk_recursive) -> DataFrame:
    """Files to chunks."""
    return chunker(files.with_doc_id(files.load_files(spark, paths, types)))


def embedded(chunks: DataFrame, embedder=None) -> DataFrame:
    return chunks.withColumn("embedding", (embedder or hashed_embedding())("text"))


#: Parts of a chunk store; a refresh writes those anew that hold a changed document.
BUCKETS = 256
VERSION = "version int, buckets int, generations array<int>, fields string"


def _newest(spark: SparkSession, store: str) -> Row | None:
    """The newest complete version: for each bucket, the generation that its files belong to."""
    if not exists(spark, f"{store}/versions"):
        return None
    return spark.read.schema(VERSION).json(f"{store}/versions").orderBy(F.desc("version")).first()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, store: str, kind: str, version: Row, only: list[int] | None = None) -> DataFrame:
    """Rows of a version, of some of its buckets if asked: the folders of other generations are not read."""
    fields = T.StructType.fromJson(json.loads(json.loads(version.fields)[kind]))
    wanted: dict[int, list[int]] = {}
    for bucket in range(version.buckets) if only is None else only:
        wanted.setdefault(version.generations[bucket], []).append(bucket)
    here = F.lit(False)
    for generation, buckets in wanted.items():
        here = here | ((F.col("generation") == generation) & F.col("bucket").isin(buckets))
    schema = T.StructType([*fields, T.StructField("generation", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{store}/{kind}").filter(here).select(*fields.names)


def refresh(spark: SparkSession, corpus: DataFrame, store: str, force: bool = False,
            chunker: Chunker = chunking.chunk_recursive, embedder=None, buckets: int = BUCKETS) -> str:
    """Bring a chunk store up to date with ``corpus(doc_id, text, ...)``; says what was done.

    Documents lie in buckets by a hash of their id. Only buckets with a changed document are written, as a new
    generation beside the old one; the version that names it is added last, so a failed run leaves the store as
    it was. Only changed documents are chunked and embedded.
    """
    newest = _newest(spark, store)
    digests = corpus.select("doc_id", F.md5("text").alias("text"))
    number = 0 if newest is None else newest.version + 1
    if newest is None or force:
        action, touched = "rebuild", list(range(buckets))
        parts = {"chunks": embedded(chunker(corpus), embedder), "documents": digests}
    else:
        buckets = newest.buckets
        changes = written(incremental.doc_changes(_stored(spark, store, "documents", newest), digests))
        touched = [r[0] for r in changes.select(_bucket(buckets)).distinct().collect()]  # at most as many as there are buckets
        action = incremental.needs(False, True, bool(touched))
        if action == "load":
            return action
        parts = {
            "chunks": incremental.merge_chunks(_stored(spark, store, "chunks", newest, touched), corpus, changes,
                                               lambda d: embedded(chunker(d), embedder)),
            "documents": digests.filter(_bucket(buckets).isin(touched))}
    for kind, rows in parts.items():
        (rows.withColumn("bucket", _bucket(buckets)).repartitionByRange("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{store}/{kind}/generation={number}"))
    generations = [number] * buckets if newest is None or force else [
        number if b in set(touched) else g for b, g in enumerate(newest.generations)]
    fields = json.dumps({kind: rows.schema.json() for kind, rows in parts.items()})
    spark.createDataFrame([(number, buckets, generations, fields)], VERSION).coalesce(1).write.mode("append").json(f"{store}/versions")
    return action


def chunks_of(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, store, "chunks", _newest(spark, store))


def answer_inputs(queries: DataFrame, corpus: DataFrame, model_size: str = "large", embedder=None) -> DataFrame:
    """Classify, route, retrieve, fit and prompt: ``(query_id, category, prompt)``.

    The prompt is NULL for conversation. A model may be applied to it as a batch function.
    """
    routed = written(context.route(intents.classify_pattern(queries), model_size))
    asked = routed.filter("k > 0")
    embed = embedder or hashed_embedding()
    hits = fusion.search(asked.select("query_id", "text").withColumn("embedding", embed("text")),
                         corpus.withColumn("embedding", embed("text")), context.profile(model_size)["document_limit"])
    passages = fusion.with_texts(hits, asked, corpus)
    fitted = context.optimize_context(passages, model_size).select("query_id", "rank", "text")
    prompts = context.build_prompts(asked.withColumnRenamed("text", "query"), fitted, model_size)
    return routed.select("query_id", "category").join(prompts, "query_id", "left")


def evaluate(responses: DataFrame, hits: DataFrame, model_size: str = "large") -> DataFrame:
    """Quality of ``responses(query_id, query, response)`` given ``hits(query_id, rank, text)``."""
    return quality.evaluate(responses.join(context.joined_context(hits, " "), "query_id", "left"), model_size)

"""Inputs derived from the given tables, each with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions.vectors import hashed_embedding
from docweave.operators import lexical
from docweave.operators.prototypes import classify_centroid
from docweave.operators.tables import written
from docweave.sources.tables import table

DIM = 64
HITS = 5
SP, NSP = tx.SPACE, tx.NOT_SPACE


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """User turns turned into queries of ten kinds, each from the whole turn: ``(query_id, session_id, turn, text)``."""
    w = F.array_join(tx.tokens(F.col("text")), " ")
    kinds = [
        F.concat(F.lit("find "), w),
        F.concat(F.lit("Search for "), w),
        F.concat(F.lit("summarize "), w),
        F.concat(F.lit("how does "), w, F.lit(" work?")),
        F.concat(w, F.lit(" in one sentence")),
        F.concat(F.lit("hello "), w),
        F.concat(F.lit("thank you "), w),
        F.concat(F.lit("explain the "), w, F.lit(" architecture")),
        F.concat(w, F.lit("?")),
        w,
    ]
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(10))
    text = kinds[-1]
    for i, expr in reversed(list(enumerate(kinds[:-1]))):
        text = F.when(kind == i, expr).otherwise(text)
    return (
        table(spark, sf, "conversations").filter("role = 'user'")
        .select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
                F.col("conv_id").alias("session_id"), "turn", text.alias("text"))
    )


def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Queries with the assistant turn that follows, in eight shapes."""
    answers = table(spark, sf, "conversations").filter("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("turn"),
        F.col("text").alias("answer"))
    a = F.col("answer")
    shape = F.pmod(F.col("session_id") + F.col("turn"), F.lit(8))
    response = (
        F.when(shape == 1, F.concat(F.lit("I am certain that "), a))
        .when(shape == 2, F.concat(a, F.lit("...")))
        .when(shape == 3, F.concat(a, F.repeat(F.lit("\n- item"), 11)))
        .when(shape == 4, F.concat(a, F.lit("\n- a\n* b")))
        .when(shape == 5, F.concat(a, F.lit("\n```python\ncode")))
        .when(shape == 6, F.concat(F.lit("Answer: "), a))
        .when(shape == 7, F.concat(F.lit("As an AI "), a))
        .otherwise(a)
    )
    return query_log(spark, sf).join(answers, ["session_id", "turn"]).select(
        "query_id", F.col("text").alias("query"), response.alias("response"))


def hit_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The five best documents of each query by BM25, without their texts: ``(query_id, rank, doc_id)``."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return written(lexical.bm25_topk(query_log(spark, sf), docs, HITS).select("query_id", "rank", "doc_id"))


def query_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The five best documents of each query by BM25: ``(query_id, rank, doc_id, source, text)``."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return hit_ids(spark, sf).join(docs, "doc_id").select("query_id", "rank", "doc_id", "source", "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("category"))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return written(query_log(spark, sf).select("query_id", "text", hashed_embedding(DIM)("text").alias("embedding")))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-centroid prediction of every vector against its label."""
    v = vectors(spark, sf)
    predicted = classify_centroid(v.select(F.col("doc_id").alias("query_id"), "embedding"), v)
    minutes = F.make_dt_interval(mins=F.col("query_id").cast("int"))
    return (
        predicted.join(v.select(F.col("doc_id").alias("query_id"), F.col("category").alias("correct")), "query_id")
        .select(
            F.col("query_id").alias("entry_id"), "query_id",
            F.col("category").alias("predicted"), "correct", F.col("score").alias("confidence"),
            F.when(F.col("query_id") % 11 != 0, F.col("category") == F.col("correct")).alias("is_correct"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp") + minutes).alias("ts"),
        )
    )


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: a tenth deleted, a tenth new, a seventh edited."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" rev2"))).otherwise(F.col("text"))
    return (
        docs.filter("doc_id % 10 <> 0"),
        docs.filter("doc_id % 10 <> 1").withColumn("text", edited),
    )


def headed_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose every third line is a heading of level one or two."""
    line = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.when(i % 6 == 1, F.concat(F.lit("# "), l))
        .when(i % 6 == 4, F.concat(F.lit("## "), l)).otherwise(l),
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(line, "\n").alias("text"))


TOKEN = tx.TOKEN

CTE = {
    "query_log": f"""
      query_log AS (
        SELECT conv_id * 100 + turn AS query_id, conv_id AS session_id, turn,
          CASE (conv_id + turn) % 10
            WHEN 0 THEN 'find ' || w WHEN 1 THEN 'Search for ' || w WHEN 2 THEN 'summarize ' || w
            WHEN 3 THEN 'how does ' || w || ' work?' WHEN 4 THEN w || ' in one sentence'
            WHEN 5 THEN 'hello ' || w WHEN 6 THEN 'thank you ' || w
            WHEN 7 THEN 'explain the ' || w || ' architecture' WHEN 8 THEN w || '?' ELSE w END AS text
        FROM (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '{TOKEN}'), ' ') AS w
              FROM conversations WHERE role = 'user'))""",
    "qa_pairs": """
      qa_pairs AS (
        SELECT q.query_id, q.text AS query,
          CASE (q.session_id + q.turn) % 8
            WHEN 1 THEN 'I am certain that ' || c.text WHEN 2 THEN c.text || '...'
            WHEN 3 THEN c.text || repeat(chr(10) || '- item', 11)
            WHEN 4 THEN c.text || chr(10) || '- a' || chr(10) || '* b'
            WHEN 5 THEN c.text || chr(10) || '```python' || chr(10) || 'code'
            WHEN 6 THEN 'Answer: ' || c.text WHEN 7 THEN 'As an AI ' || c.text
            ELSE c.text END AS response
        FROM query_log q JOIN conversations c
          ON c.conv_id = q.session_id AND c.turn = q.turn + 1 AND c.role = 'assistant')""",
    "query_hits": f"""
      hit_postings AS (
        SELECT doc_id, term, count(*) AS tf FROM (
          SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents) GROUP BY 1, 2),
      hit_lengths AS (SELECT doc_id, sum(tf) AS dl FROM hit_postings GROUP BY 1),
      hit_stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM hit_lengths),
      hit_terms AS (SELECT term, count(*) AS df FROM hit_postings GROUP BY 1),
      hit_queries AS (
        SELECT query_id, term, count(*) AS qtf FROM (
          SELECT query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM query_log) GROUP BY 1, 2),
      hit_scores AS (
        SELECT query_id, doc_id, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1)
          * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM hit_queries JOIN hit_postings USING (term) JOIN hit_terms USING (term) JOIN hit_lengths USING (doc_id), hit_stats
        GROUP BY 1, 2),
      query_hits AS (
        SELECT query_id, rank, doc_id, source, text FROM (
          SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit_scores)
        JOIN documents USING (doc_id) WHERE rank <= {HITS})""",
    "query_vectors": f"""
      query_buckets AS (
        SELECT query_id, ('0x' || substr(md5(t), 1, 4))::INT % {DIM} AS b, count(*)::DOUBLE AS x
        FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS t FROM query_log)
        GROUP BY 1, 2),
      query_vectors AS (
        SELECT q.query_id, any_value(q.text) AS text,
          list(coalesce(x, 0) ORDER BY r.b) AS embedding
        FROM query_log q CROSS JOIN (SELECT unnest(range(0, {DIM})) AS b) r
        LEFT JOIN query_buckets USING (query_id, b) GROUP BY 1)""",
    "centroids": f"""
      centroids AS (
        SELECT category, list(m ORDER BY pos) AS embedding FROM (
          SELECT label AS category, pos, avg(embedding[pos]::DOUBLE) AS m
          FROM embeddings, (SELECT unnest(range(1, {DIM} + 1)) AS pos) GROUP BY 1, 2) GROUP BY 1)""",
    "feedback": """
      feedback AS (
        SELECT vec_id AS entry_id, vec_id AS query_id, predicted, correct, confidence,
          CASE WHEN vec_id % 11 <> 0 THEN predicted = correct END AS is_correct,
          TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS ts
        FROM (SELECT vec_id, e.label AS correct, c.category AS predicted,
                round(list_dot_product(e.embedding::DOUBLE[], c.embedding)
                  / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))
                  / sqrt(list_dot_product(c.embedding, c.embedding)), 6) AS confidence
              FROM embeddings e CROSS JOIN centroids c)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, predicted) = 1)""",
    "headed_docs": """
      headed_docs AS (
        SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
          lambda l, i: CASE WHEN (i - 1) % 6 = 1 THEN '# ' || l WHEN (i - 1) % 6 = 4 THEN '## ' || l ELSE l END),
          chr(10)) AS text
        FROM documents)""",
}

NEEDS = {
    "qa_pairs": ["query_log"], "query_hits": ["query_log"], "query_vectors": ["query_log"],
    "feedback": ["centroids"],
}


def with_inputs(names: str, body: str) -> str:
    """``body`` preceded by the definitions of the inputs it names; ``body`` may add more."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = ",".join(CTE[n] for n in order)
    return f"WITH {ctes}{',' if body.lstrip().startswith('--cte') else ''} {body.replace('--cte', '', 1)}"

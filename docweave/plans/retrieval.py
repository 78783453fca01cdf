"""Lexical, dense and hybrid retrieval over all queries and all documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.functions import scores, vectors
from docweave.functions import text as tx
from docweave.operators import fusion, lexical
from docweave.operators.cells import Cells
from docweave.operators.ranks import global_rank, running
from docweave.operators.context import search_report
from docweave.operators.tables import shared_folder, written
from docweave.operators.vector import vector_topk
from docweave.plans import derived
from docweave.plans.corpus import POSTINGS
from docweave.plans.derived import DIM
from docweave.plans.registry import query, s_tokens
from docweave.sources.tables import spread, table


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("tokenize", f"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct,
  md5(array_to_string(t, ' ')) AS token_key
FROM (SELECT doc_id, {s_tokens('text')} AS t FROM documents)""")
def tokenize(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
                    F.md5(F.array_join("t", " ")).alias("token_key"))


@query("term_frequency", f"""
WITH {POSTINGS} SELECT doc_id, term, tf, round(tf / dl, 6) AS rel_tf FROM postings JOIN doclen USING (doc_id)""")
def term_frequency(spark, sf):
    p = lexical.build_index(_docs(spark, sf)).postings
    return p.select("doc_id", "term", "tf", F.round(F.col("tf") / F.col("dl"), 6).alias("rel_tf"))


@query("inverted_index", f"""
WITH {POSTINGS}
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
  max(tf) AS max_tf FROM postings GROUP BY 1""")
def inverted_index(spark, sf):
    return lexical.build_index(_docs(spark, sf)).postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"), F.max("tf").alias("max_tf"))


QTERMS = f"""
qterms AS (SELECT query_id, term, count(*) AS qtf
  FROM (SELECT item_id AS query_id, unnest({s_tokens('text')}) AS term FROM benchmark) GROUP BY 1, 2),
bm25 AS (SELECT query_id, doc_id, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1)
    * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qterms JOIN postings USING (term) JOIN terms USING (term) JOIN doclen USING (doc_id), stats GROUP BY 1, 2)"""


def bm25_rows(k: int) -> str:
    return f"""
bm25_top AS (SELECT *, round(CASE WHEN max(score) OVER (PARTITION BY query_id) > 0
    THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS rel_score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25)
  WHERE rank <= {k})"""


@query("bm25_scores", f"""
WITH {POSTINGS}, {QTERMS} SELECT query_id, doc_id, score FROM bm25""")
def bm25_scores(spark, sf):
    """Every query against every document that shares a term with it."""
    return lexical.bm25_all(_items(spark, sf), _docs(spark, sf))


@query("bm25_topk", f"""
WITH {POSTINGS}, {QTERMS}, {bm25_rows(4)}
SELECT query_id, doc_id, rank, score, rel_score FROM bm25_top""")
def bm25_topk(spark, sf):
    return lexical.bm25_topk(_items(spark, sf), _docs(spark, sf), 4)


@query("bm25_topk_bounded", f"""
WITH {POSTINGS}, {QTERMS}, {bm25_rows(4)}
SELECT query_id, doc_id, rank, score, rel_score FROM bm25_top""")
def bm25_topk_bounded(spark, sf):
    """The same search over many small shards, most of which their bounds exclude."""
    return lexical.bm25_topk(_items(spark, sf), _docs(spark, sf), 4, shard_docs=64)


@query("bm25_from_index", f"""
WITH {POSTINGS}, {QTERMS}, {bm25_rows(4)}
SELECT query_id, doc_id, rank, score, rel_score FROM bm25_top""")
def bm25_from_index(spark, sf):
    """The same search over a stored index that was written for two thirds of the documents and then extended."""
    docs = _docs(spark, sf)
    path = f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
    lexical.store_index(docs.filter("doc_id % 3 <> 0"), path)
    store = lexical.store_index(docs, path)
    return lexical.search_store(_items(spark, sf), store, 4)


@query("bm25_stats", f"""
WITH {POSTINGS} SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM terms) AS vocabulary,
  1.5::DOUBLE AS k1, 0.75::DOUBLE AS b FROM stats""")
def bm25_stats(spark, sf):
    counts = lexical.build_index(_docs(spark, sf)).rows.groupBy("term").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))
    of_documents = F.col("term") == lexical.DOCUMENT
    return counts.agg(
        F.max(F.when(of_documents, F.col("n"))).alias("n_docs"),
        F.round(F.max(F.when(of_documents, F.col("tokens") / F.col("n"))), 6).alias("avgdl"),
        F.count(F.when(~of_documents, 1)).alias("vocabulary")).select(
        "*", F.lit(lexical.K1).alias("k1"), F.lit(lexical.B).alias("b"))


@query("bm25_incremental", f"""
WITH {POSTINGS} SELECT term, df, n_docs, n_tokens FROM terms, stats""")
def bm25_incremental(spark, sf):
    """An index of two thirds extended by everything equals the index of everything."""
    docs = _docs(spark, sf)
    start = lexical.LexicalIndex(written(lexical.build_index(docs.filter("doc_id % 3 <> 0")).rows))
    grown = lexical.LexicalIndex(written(lexical.extend_index(start, docs).rows))
    return grown.terms.select("term", "df", grown.stats.select("n_docs").scalar().alias("n_docs"),
                              grown.stats.select("n_tokens").scalar().alias("n_tokens"))


# Dense side: hashed embeddings of texts.

def s_hashed(name: str, source: str, key: str) -> str:
    return f"""
{name}_x AS (SELECT {key}, ('0x' || substr(md5(t), 1, 4))::INT % {DIM} AS b, count(*)::DOUBLE AS x
  FROM (SELECT {key}, unnest({s_tokens('text')}) AS t FROM {source}) GROUP BY 1, 2),
{name}_n AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {name}_x GROUP BY 1)"""


ITEMS = "items AS (SELECT item_id AS query_id, text FROM benchmark)"
# A document without tokens has the zero vector, similarity 0.
DENSE = f"""
{s_hashed('dv', 'documents', 'doc_id')}, {ITEMS}, {s_hashed('qv', 'items', 'query_id')},
dots AS (SELECT query_id, doc_id, sum(q.x * d.x) AS dot FROM qv_x q JOIN dv_x d USING (b) GROUP BY 1, 2),
sims AS (SELECT i.query_id, d.doc_id, round(coalesce(dot / qn.norm / dn.norm, 0), 6) AS score
  FROM items i CROSS JOIN documents d LEFT JOIN dots x ON x.query_id = i.query_id AND x.doc_id = d.doc_id
  LEFT JOIN qv_n qn ON qn.query_id = i.query_id LEFT JOIN dv_n dn ON dn.doc_id = d.doc_id)"""


def dense_rows(k: int) -> str:
    return f"""
dense_top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims) WHERE rank <= {k})"""


def _embedded(df):
    return df.withColumn("embedding", vectors.hashed_embedding(DIM)("text"))


@query("embed_hashed", f"""
WITH {s_hashed('dv', 'documents', 'doc_id')}
SELECT doc_id, (b + 1)::BIGINT AS dim, round(x / norm, 6) AS value FROM dv_x JOIN dv_n USING (doc_id)""")
def embed_hashed(spark, sf):
    return (
        _embedded(_docs(spark, sf)).select("doc_id", F.posexplode("embedding").alias("pos", "x"))
        .filter("x <> 0").select("doc_id", (F.col("pos") + 1).cast("bigint").alias("dim"), F.round("x", 6).alias("value")))


@query("embed_weighted", f"""
WITH {POSTINGS},
wv_x AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 4))::INT % {DIM} AS b, sum(tf * ln((n_docs - df + 0.5) / (df + 0.5) + 1)) AS x
  FROM postings JOIN terms USING (term), stats GROUP BY 1, 2),
wv_n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM wv_x GROUP BY 1)
SELECT doc_id, (b + 1)::BIGINT AS dim, round(x / norm, 6) AS value FROM wv_x JOIN wv_n USING (doc_id)""")
def embed_weighted(spark, sf):
    """The hashed embedding with rare terms weighted up."""
    found = lexical.weighted_embeddings(_docs(spark, sf), DIM)
    return found.select("doc_id", F.posexplode("embedding").alias("pos", "x")).filter("x <> 0").select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("dim"), F.round("x", 6).alias("value"))


@query("cosine_pairs", """
SELECT a.vec_id AS id_a, b.vec_id AS id_b,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
     * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf):
    """Every vector with its successor."""
    v = table(spark, sf, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("id_a"), F.col("vec_id").alias("id_b"), F.col("embedding").alias("y"))
    return v.select(F.col("vec_id").alias("id_a"), F.col("embedding").alias("x")).join(nxt, "id_a").select(
        "id_a", "id_b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


VEC_SIMS = """
vec_sims AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
    / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
  FROM embeddings a CROSS JOIN embeddings b),
vec_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vec_sims)"""


def _vec_topk(spark, sf, k, **kw):
    v = derived.vectors(spark, sf)
    return vector_topk(v.withColumnRenamed("doc_id", "query_id"), v, k, **kw)


@query("vector_topk", f"WITH {VEC_SIMS} SELECT query_id, doc_id, rank, score FROM vec_top WHERE rank <= 5")
def vector_topk_all(spark, sf):
    return _vec_topk(spark, sf, 5)


@query("vector_topk_grid", f"WITH {VEC_SIMS} SELECT query_id, doc_id, rank, score FROM vec_top WHERE rank <= 5")
def vector_topk_grid(spark, sf):
    """The same search when neither side fits a broadcast."""
    return _vec_topk(spark, sf, 5, broadcast_bytes=0, grid_rows=1000)


@query("vector_topk_ivf", f"WITH {VEC_SIMS} SELECT query_id, doc_id, rank, score FROM vec_top WHERE rank <= 5")
def vector_topk_ivf(spark, sf):
    """The same search over stored cells, learned from half of the vectors; rings that cannot reach the k-th best are not compared."""
    v = derived.vectors(spark, sf)
    store = Cells.learn(v.filter("doc_id % 2 = 0"), f"{shared_folder(spark)}/cells/{uuid.uuid4().hex}")
    store.add(v.filter("doc_id % 2 <> 0"))
    return store.topk(v.withColumnRenamed("doc_id", "query_id"), 5).select("query_id", "doc_id", "rank", "score")


@query("normalize_score", """
SELECT event_id, round(CASE WHEN value > 1 THEN greatest(0, 1 - least(1, value / 10))
  WHEN value < 0 THEN greatest(0, (value + 1) / 2) ELSE value END, 6)::DOUBLE AS score FROM events""")
def normalize_score(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.round(scores.normalize_score(F.col("value")), 6).alias("score"))


@query("sigmoid_normalize", """
SELECT event_id, round(CASE WHEN value > 1 THEN 1 / (1 + exp(-value)) ELSE value END, 6)::DOUBLE AS score FROM events""")
def sigmoid_normalize(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.round(scores.squash_above_one(F.col("value")), 6).alias("score"))


@query("rank_scores", f"""
WITH {VEC_SIMS} SELECT query_id, doc_id, rank, round(greatest(0.2, 1 - 0.1 * (rank - 1)), 6)::DOUBLE AS estimate,
  round(1 - 0.1 * ((rank - 1) % 8), 6)::DOUBLE AS fallback
FROM vec_top WHERE rank <= 12""")
def rank_scores(spark, sf):
    return _vec_topk(spark, sf, 12).select(
        "query_id", "doc_id", "rank", F.round(scores.rank_score(F.col("rank")), 6).alias("estimate"),
        F.round(scores.positional_score(F.col("rank")), 6).alias("fallback"))


def fused_rows(dense: float, sparse: float) -> str:
    return f"""
{POSTINGS}, {QTERMS}, {bm25_rows(20)}, {DENSE}, {dense_rows(20)},
merged AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.doc_id, b.doc_id) AS doc_id,
    d.rank AS dr, b.rank AS br,
    coalesce(CASE WHEN d.score > 1 THEN greatest(0, 1 - least(1, d.score / 10))
      WHEN d.score < 0 THEN greatest(0, (d.score + 1) / 2) ELSE d.score END, 0) AS ds,
    CASE WHEN b.rank IS NULL THEN 0 ELSE greatest(0.2, 1 - 0.1 * (b.rank - 1)) END AS bs
  FROM dense_top d FULL JOIN bm25_top b ON d.query_id = b.query_id AND d.doc_id = b.doc_id),
fused AS (SELECT query_id, doc_id, round({dense} * ds + {sparse} * bs, 7)::DOUBLE AS score,
    round(coalesce({dense} / (dr + 60), 0) + coalesce({sparse} / (br + 60), 0), 9)::DOUBLE AS rrf FROM merged),
rrf_top AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY rrf DESC, score DESC, doc_id) AS rank FROM fused) WHERE rank <= 4)"""


FUSED = fused_rows(0.7, 0.3)


def _both(spark, sf):
    q, d = (written(_embedded(t).drop("text")) for t in (_items(spark, sf), _docs(spark, sf)))
    return (vector_topk(q, d, fusion.FETCH_K),
            lexical.bm25_topk(_items(spark, sf), _docs(spark, sf), fusion.FETCH_K))


@query("rrf_fusion", f"WITH {FUSED} SELECT query_id, doc_id, rank, score, rrf FROM rrf_top")
def rrf_fusion(spark, sf):
    return fusion.fuse(*_both(spark, sf), 4)


@query("weighted_fusion", f"""
WITH {FUSED} SELECT query_id, doc_id, rank, score, rrf FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 4""")
def weighted_fusion(spark, sf):
    return fusion.fuse(*_both(spark, sf), 4, method="weighted")


@query("weighted_fusion_lexical", f"""
WITH {fused_rows(0.2, 0.8)} SELECT query_id, doc_id, rank, score, rrf FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 4""")
def weighted_fusion_lexical(spark, sf):
    """Fusion with other weights: mostly the lexical side."""
    return fusion.fuse(*_both(spark, sf), 4, method="weighted", weights=(1.0, 4.0))


@query("hybrid_topk", f"""
WITH {FUSED} SELECT query_id, doc_id, rank, score, rrf FROM rrf_top WHERE score >= 0.25""")
def hybrid_topk(spark, sf):
    return fusion.search(_embedded(_items(spark, sf)), _embedded(_docs(spark, sf)))


@query("retrieval_stats", f"""
WITH {FUSED}, per_query AS (SELECT query_id, count_if(score >= 0.25) AS kept, count_if(score < 0.25) AS cut,
    avg(score) FILTER (score >= 0.25) AS s FROM rrf_top GROUP BY 1)
SELECT count(*) AS queries, sum(cut)::BIGINT AS filtered_docs, round(avg(kept), 6) AS avg_docs,
  round(avg(s), 6) AS avg_score FROM per_query""")
def retrieval_stats(spark, sf):
    kept = F.col("score") >= fusion.THRESHOLD
    per_query = fusion.fuse(*_both(spark, sf), 4).groupBy("query_id").agg(
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("cut"),
        F.avg(F.when(kept, F.col("score"))).alias("s"))
    return per_query.agg(
        F.count("*").alias("queries"), F.sum("cut").alias("filtered_docs"),
        F.round(F.avg("kept"), 6).alias("avg_docs"), F.round(F.avg("s"), 6).alias("avg_score"))


def s_coverage(q: str, d: str) -> str:
    return (f"CASE WHEN len({s_tokens(q)}) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({s_tokens(q)}), "
            f"list_distinct({s_tokens(d)}))) / len(list_distinct({s_tokens(q)})) END")


RERANKED = f"""
{POSTINGS}, {QTERMS}, {bm25_rows(20)},
raw AS (SELECT t.query_id, t.doc_id, t.rank AS fetched, t.rel_score, {s_coverage('b.text', 'd.text')} AS raw
  FROM bm25_top t JOIN benchmark b ON b.item_id = t.query_id JOIN documents d USING (doc_id)),
reranked AS (SELECT query_id, doc_id, fetched, pair_score, round(0.7 * pair_score + 0.3 * rel_score, 7) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, doc_id) AS rank
  FROM (SELECT *, round(raw, 6) AS pair_score FROM raw))"""


@query("rerank", f"""
WITH {RERANKED} SELECT query_id, doc_id, rank, pair_score, score FROM reranked""")
def rerank(spark, sf):
    hits = lexical.bm25_topk(_items(spark, sf), _docs(spark, sf), 20).select(
        "query_id", "doc_id", F.col("rel_score").alias("score"))
    return fusion.rerank(fusion.with_texts(hits, _items(spark, sf), _docs(spark, sf)), 20)


@query("retrieve_rerank", f"""
WITH {RERANKED} SELECT query_id, doc_id, rank, pair_score, score FROM reranked WHERE rank <= 4""")
def retrieve_rerank(spark, sf):
    return fusion.retrieve_rerank(_items(spark, sf), _docs(spark, sf))


@query("minmax_normalize", f"""
WITH {POSTINGS}, {QTERMS}, {bm25_rows(20)}
SELECT query_id, doc_id, round(CASE WHEN lo >= 0 AND hi <= 1 THEN score WHEN lo = hi THEN 0.5
  ELSE (score - lo) / (hi - lo) END, 6) AS score
FROM (SELECT query_id, doc_id, score, min(score) OVER w AS lo, max(score) OVER w AS hi FROM bm25_top
      WINDOW w AS (PARTITION BY query_id))""")
def minmax_normalize(spark, sf):
    return lexical.bm25_topk(_items(spark, sf), _docs(spark, sf), 20).select(
        "query_id", "doc_id", F.round(scores.minmax_per_query(F.col("score"), "query_id"), 6).alias("score"))


@query("rerank_stats", f"""
WITH {RERANKED} SELECT count(DISTINCT query_id) AS calls, count(*) AS documents_scored,
  (SELECT sum(ceil(n / 8.0))::BIGINT FROM (SELECT count(*) AS n FROM reranked GROUP BY query_id)) AS batches,
  count_if(rank <= 4 AND fetched > 4)::BIGINT AS promoted FROM reranked""")
def rerank_stats(spark, sf):
    hits = lexical.bm25_topk(_items(spark, sf), _docs(spark, sf), 20)
    done = fusion.rerank(fusion.with_texts(
        hits.select("query_id", "doc_id", F.col("rel_score").alias("score")), _items(spark, sf), _docs(spark, sf)), 20)
    both = done.join(hits.select("query_id", "doc_id", F.col("rank").alias("fetched")), ["query_id", "doc_id"])
    per_query = both.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if((F.col("rank") <= 4) & (F.col("fetched") > 4)).alias("up"))
    return per_query.agg(
        F.count("*").alias("calls"), F.sum("n").alias("documents_scored"),
        F.sum(F.ceil(F.col("n") / 8)).alias("batches"), F.sum("up").alias("promoted"))


@query("search_snippets", f"""
WITH {POSTINGS}, {QTERMS}, {bm25_rows(4)}
SELECT query_id, count(*) AS n_hits,
  string_agg('- ' || source || ': ' || substr(text, 1, 200) || '...', chr(10) ORDER BY rank) AS snippets
FROM bm25_top JOIN documents USING (doc_id) GROUP BY 1""")
def search_snippets(spark, sf):
    hits = written(lexical.bm25_topk(_items(spark, sf), _docs(spark, sf), 4))
    return search_report(hits.join(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id"))


@query("running_mean", """
SELECT event_id, count(*) OVER w AS n, (sum(value::DECIMAL(20, 6)) OVER w)::DOUBLE / count(*) OVER w AS running_mean FROM events
WINDOW w AS (ORDER BY ts, event_id)""")
def running_mean(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    exact = F.col("value").cast("decimal(20,6)")
    r = running(e, ["ts", "event_id"], n=F.lit(1).cast("bigint"), total=exact)
    return r.select("event_id", "n", (F.col("total").cast("double") / F.col("n")).alias("running_mean"))

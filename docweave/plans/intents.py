"""Query-intent classification over the whole query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import intent as it
from docweave.functions import text as tx
from docweave.functions.scores import exact_mean
from docweave.operators import classifiers, intents, prototypes
from docweave.operators.setsim import similar_sets
from docweave.plans import derived
from docweave.plans.derived import with_inputs
from docweave.plans.registry import (
    query, quoted, s_any, s_count, s_list, s_match, s_squeeze, s_starts, s_strip, s_tokens, s_words,
)
from docweave.sources.tables import table

LOW = "lower(text)"
N = s_count("text")
MATCHED = s_match(LOW, it.SEARCH_PATTERNS + it.CONCISE_PATTERNS + it.CONVERSATION_PATTERNS)
STARTS, KEYWORD = s_starts(LOW, it.QUESTION_STARTS), s_any(LOW, it.DOCUMENT_KEYWORDS)

PATTERN = f"""
pattern AS (SELECT query_id, text,
  CASE WHEN starts_with({LOW}, 'find ') OR {s_match(LOW, it.SEARCH_PATTERNS)} THEN 'DOCUMENT_SEARCH'
    WHEN {s_match(LOW, it.CONCISE_PATTERNS)} THEN 'CONCISE_QUERY'
    WHEN {s_match(LOW, it.CONVERSATION_PATTERNS)} THEN 'CONVERSATION' ELSE 'DOCUMENT_QUERY' END AS category,
  (CASE WHEN starts_with({LOW}, 'find ') THEN 0.98 WHEN {MATCHED} THEN 0.95
    WHEN {STARTS} AND {KEYWORD} THEN 0.85 WHEN {STARTS} OR {KEYWORD} THEN 0.7
    WHEN {N} >= 4 THEN 0.6 ELSE 0.5 END)::DOUBLE AS confidence
  FROM query_log)"""


@query("classify_pattern", with_inputs("query_log", f"--cte {PATTERN} SELECT query_id, category, confidence FROM pattern"))
def classify_pattern(spark, sf):
    return intents.classify_pattern(derived.query_log(spark, sf)).drop("text")


NEAREST = """
query_best AS (SELECT q.query_id, q.text, e.label AS category, e.vec_id,
    coalesce(round(list_dot_product(q.embedding, e.embedding::DOUBLE[])
      / nullif(sqrt(list_dot_product(q.embedding, q.embedding)), 0)
      / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6), 0) AS score
  FROM query_vectors q CROSS JOIN embeddings e
  QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, e.vec_id) = 1)"""
THRESHOLD = 0.35  # the given vectors are unrelated to the texts; most similarities stay low


@query("classify_nearest", with_inputs("query_vectors", f"""--cte {NEAREST}
SELECT query_id, CASE WHEN score < {THRESHOLD} THEN -1 ELSE category END AS category, score FROM query_best"""))
def classify_nearest(spark, sf):
    return prototypes.classify_nearest(
        derived.query_vectors(spark, sf), derived.vectors(spark, sf), THRESHOLD, default=-1)


@query("classify_zero_shot", with_inputs("query_vectors", f"""--cte {NEAREST}
SELECT query_id, CASE WHEN {s_starts(LOW, prototypes.SEARCH_PREFIXES)} THEN -2
    WHEN score < {THRESHOLD} THEN -1 ELSE category END AS category,
  CASE WHEN {s_starts(LOW, prototypes.SEARCH_PREFIXES)} THEN 0.95 ELSE score END::DOUBLE AS score FROM query_best"""))
def classify_zero_shot(spark, sf):
    return prototypes.classify_zero_shot(
        derived.query_vectors(spark, sf), derived.vectors(spark, sf), THRESHOLD, search=-2, default=-1)


CENTROID = """
query_centroid AS (SELECT q.query_id, q.text, c.category,
    coalesce(round(list_dot_product(q.embedding, c.embedding)
      / nullif(sqrt(list_dot_product(q.embedding, q.embedding)), 0)
      / sqrt(list_dot_product(c.embedding, c.embedding)), 6), 0) AS score
  FROM query_vectors q CROSS JOIN centroids c
  QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, c.category) = 1)"""


@query("classify_centroid", with_inputs("query_vectors centroids", f"""--cte {CENTROID}
SELECT query_id, CASE WHEN score >= 0.35 THEN category::VARCHAR WHEN {N} <= 3 THEN 'CONVERSATION'
  ELSE 'DOCUMENT_QUERY' END AS category, CASE WHEN score < 0.35 THEN 0.6 ELSE score END::DOUBLE AS score
FROM query_centroid"""))
def classify_centroid(spark, sf):
    q = derived.query_vectors(spark, sf)
    best = prototypes.classify_centroid(q, derived.vectors(spark, sf)).join(q.select("query_id", "text"), "query_id")
    category, score = prototypes.centroid_or_length(
        F.col("category").cast("string"), F.col("score"), F.col("text"), 0.35)
    return best.select("query_id", category.alias("category"), score.alias("score"))


# The vector voter names one of the four categories by its label.
NAMES = ["CONVERSATION", "DOCUMENT_QUERY", "CONCISE_QUERY", "DOCUMENT_SEARCH"]
ENSEMBLE = f"""{PATTERN}, {NEAREST},
votes AS (SELECT p.query_id, p.text, p.category AS pc, p.confidence AS p,
    ({s_list(NAMES)})[b.category % 4 + 1] AS vc, b.score AS v FROM pattern p JOIN query_best b USING (query_id)),
tally AS (SELECT *, pc = vc AS agree, pc = vc OR p * 0.6 >= v * 0.4 AS rules FROM votes),
ensemble AS (SELECT query_id, agree,
  CASE WHEN starts_with({LOW}, 'find ') THEN 'DOCUMENT_SEARCH' WHEN rules THEN pc ELSE vc END AS category,
  round(CASE WHEN starts_with({LOW}, 'find ') THEN 1.0
    WHEN agree THEN 0.7 * (p * 0.6 + v * 0.4) + 0.3 * (p + v) / 2
    WHEN rules THEN 0.7 * p * 0.6 + 0.3 * p ELSE 0.7 * v * 0.4 + 0.3 * v END, 8)::DOUBLE AS confidence FROM tally)"""


def _votes(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("category") % 4 + 1).cast("int"))
    return prototypes.nearest_example(derived.query_vectors(spark, sf), derived.vectors(spark, sf)).withColumn(
        "category", name)


def _ensemble(spark, sf):
    return intents.classify_ensemble(derived.query_log(spark, sf), _votes(spark, sf)).withColumn(
        "confidence", F.round("confidence", 8))


@query("classify_ensemble", with_inputs("query_vectors", f"""--cte {ENSEMBLE}
SELECT query_id, category, confidence FROM ensemble"""))
def classify_ensemble(spark, sf):
    return _ensemble(spark, sf).drop("agree")


@query("ensemble_agreement", with_inputs("query_vectors", f"""--cte {ENSEMBLE}
SELECT count(*) AS calls, count_if(agree)::BIGINT AS consensus, count_if(NOT agree)::BIGINT AS disagreement
FROM ensemble"""))
def ensemble_agreement(spark, sf):
    return _ensemble(spark, sf).agg(
        F.count("*").alias("calls"), F.count_if("agree").alias("consensus"),
        F.count_if(~F.col("agree")).alias("disagreement"))


@query("category_stats", with_inputs("query_log", f"""--cte {PATTERN}
SELECT category, count(*) AS calls, sum(confidence::DECIMAL(20, 8))::DOUBLE / count(*) AS avg_confidence,
  count_if(confidence >= 0.65)::BIGINT AS above, count_if(confidence < 0.65)::BIGINT AS below
FROM pattern GROUP BY 1"""))
def category_stats(spark, sf):
    return intents.category_stats(intents.classify_pattern(derived.query_log(spark, sf)), 0.65)


@query("classify_cascade", with_inputs("query_vectors", f"""--cte {PATTERN}, {NEAREST}
SELECT query_id, CASE WHEN score < 0.3 AND confidence >= 0.6 THEN p.category ELSE b.category::VARCHAR END AS category,
  CASE WHEN score < 0.3 AND confidence >= 0.6 THEN confidence ELSE score END AS score
FROM query_best b JOIN pattern p USING (query_id)"""))
def classify_cascade(spark, sf):
    first = prototypes.nearest_example(derived.query_vectors(spark, sf), derived.vectors(spark, sf)).withColumn(
        "category", F.col("category").cast("string"))
    second = intents.classify_pattern(derived.query_log(spark, sf)).withColumnRenamed("confidence", "score")
    return intents.classify_cascade(first, second, trust_first=0.3)


IS_DOC = f"""CASE
  WHEN {s_match(LOW, it.GREETING_PATTERNS)} THEN false
  WHEN {N} < 3 AND NOT {s_any(LOW, it.SHORT_QUERY_KEYWORDS)} THEN false
  WHEN {s_starts(LOW, ['find ', 'search '])} OR contains(text, '?') THEN true
  WHEN {s_match(LOW, it.SMALL_TALK_PATTERNS)} THEN false
  WHEN {s_starts(LOW, it.QUESTION_WORDS)} OR {N} >= 5 THEN true
  WHEN {s_any(LOW, it.QUESTION_WORDS)} OR {s_any(LOW, it.TOPIC_KEYWORDS)} THEN true
  WHEN {s_match(LOW, it.DOCUMENT_PATTERNS)} OR {N} >= 3 THEN true ELSE false END"""


@query("is_document_query", with_inputs("query_log", f"SELECT query_id, {IS_DOC} AS is_document FROM query_log"))
def is_document_query(spark, sf):
    return derived.query_log(spark, sf).select("query_id", it.is_document_query(F.col("text")).alias("is_document"))


def s_categorize(small: bool) -> str:
    chat = s_match(LOW, it.SMALL_TALK_PATTERNS + it.COURTESY_PATTERNS)
    terse = f"({N} <= 2 AND NOT contains(text, '?'))"
    first = f"WHEN {s_match(LOW, [it.ONE_SHORT_LINE, it.SHORT_QUESTION])} THEN 'CONCISE_QUERY'" if small else ""
    return f"""CASE WHEN starts_with({LOW}, 'find ') THEN 'DOCUMENT_SEARCH' {first}
      WHEN {s_match(LOW, it.CONCISE_PATTERNS + it.BREVITY_PATTERNS)} THEN 'CONCISE_QUERY'
      WHEN {chat} {f'OR {terse}' if small else ''} THEN 'CONVERSATION'
      WHEN {IS_DOC} THEN {f"CASE WHEN {N} < 8 THEN 'CONCISE_QUERY' ELSE 'DOCUMENT_QUERY' END" if small else "'DOCUMENT_QUERY'"}
      ELSE 'CONVERSATION' END"""


@query("categorize_query", with_inputs("query_log", f"""
SELECT query_id, {s_categorize(True)} AS small_category, {s_categorize(False)} AS large_category,
  CASE WHEN starts_with({LOW}, 'find ') THEN substr(text, 6) ELSE text END AS argument
FROM (SELECT query_id, {s_strip('text')} AS text FROM query_log)"""))
def categorize_query(spark, sf):
    q = F.col("text")
    return derived.query_log(spark, sf).select(
        "query_id", it.categorize(q, "small").alias("small_category"),
        it.categorize(q, "large").alias("large_category"), it.search_argument(q).alias("argument"))


TINY = f"(length({s_strip('text')}) <= 3 OR lower({s_strip('text')}) IN ({', '.join(map(quoted, it.TINY_GREETINGS))}))"


@query("classify_keywords", with_inputs("query_log", f"""
SELECT query_id,
  CASE WHEN {TINY} OR {LOW} IN ({', '.join(map(quoted, it.CONVERSATION_KEYWORDS))}) OR {N} < 3 THEN 'CONVERSATION'
    WHEN {s_any(LOW, it.SEARCH_KEYWORDS)} THEN 'DOCUMENT_SEARCH'
    WHEN {s_any(LOW, it.CONCISE_KEYWORDS)} THEN 'CONCISE_QUERY'
    WHEN {N} < 5 OR ends_with(text, '?') OR contains({LOW}, 'you') THEN 'CONVERSATION'
    ELSE 'DOCUMENT_QUERY' END AS category,
  CASE WHEN starts_with({LOW}, 'find ') THEN 'DOCUMENT_SEARCH' WHEN {N} < 4 THEN 'CONVERSATION'
    WHEN {s_any(LOW, it.FALLBACK_CONCISE)} THEN 'CONCISE_QUERY' ELSE 'DOCUMENT_QUERY' END AS fallback
FROM query_log"""))
def classify_keywords(spark, sf):
    q = F.col("text")
    return derived.query_log(spark, sf).select(
        "query_id", it.keyword_category(q).alias("category"), it.fallback_category(q).alias("fallback"))


@query("query_complexity", with_inputs("query_log", f"""
SELECT query_id, CASE WHEN {N} < 5 AND NOT {s_any(LOW, it.TECHNICAL_TERMS)} THEN 'simple'
  WHEN {N} < 12 OR NOT {s_any(LOW, it.TECHNICAL_TERMS)} THEN 'moderate' ELSE 'complex' END AS complexity
FROM query_log"""))
def query_complexity(spark, sf):
    return derived.query_log(spark, sf).select("query_id", it.complexity(F.col("text")).alias("complexity"))


TOPIC = f"array_to_string({s_words('text')}[2:], ' ')"
BARE = LOW
for _w in it.BRIEF_WORDS:
    BARE = f"replace({BARE}, '{_w}', '')"


@query("describe_query", with_inputs("query_log", f"""
SELECT query_id, CASE WHEN {N} <= 3 THEN 'Queries like ''' || text || ''''
  WHEN {s_starts(LOW, it.FIND_WORDS)} THEN 'Requests to find or locate information about ' || {TOPIC}
  WHEN {s_any(LOW, it.BRIEF_WORDS)} THEN 'Requests for brief or summarized information about ' || {s_strip(BARE)}
  WHEN {s_starts(LOW, it.ASK_WORDS)} THEN 'Questions seeking information about ' || {TOPIC}
  ELSE 'Conversational queries similar to ''' || text || '''' END AS description
FROM query_log"""))
def describe_query(spark, sf):
    return derived.query_log(spark, sf).select("query_id", it.description_of(F.col("text")).alias("description"))


@query("similar_queries", with_inputs("query_log", f"""--cte
qsets AS (SELECT query_id, list_sort(list_filter(list_distinct({s_tokens('text')}),
    lambda w: NOT list_contains({s_list(it.STOPWORDS)}, w))) AS items FROM query_log),
keyed AS (SELECT query_id, items, min(query_id) OVER (PARTITION BY items) AS rep FROM qsets WHERE len(items) > 0),
reps AS (SELECT query_id, items, len(items) AS n FROM keyed WHERE query_id = rep),
post AS (SELECT query_id, n, unnest(items) AS item FROM reps),
shared AS (SELECT a.query_id AS a, b.query_id AS b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM post a JOIN post b ON a.item = b.item AND a.query_id < b.query_id GROUP BY 1, 2)
SELECT a AS id_a, b AS id_b, round(o / (na + nb - o), 6)::DOUBLE AS similarity FROM shared WHERE o / (na + nb - o) >= 0.8
UNION ALL SELECT rep, query_id, 1.0 FROM keyed WHERE rep <> query_id"""))
def similar_queries(spark, sf):
    sets = derived.query_log(spark, sf).select(F.col("query_id").alias("id"), it.content_words(F.col("text")).alias("items"))
    return similar_sets(sets, 0.8, strict=False).select("id_a", "id_b", F.round("jaccard", 6).alias("similarity"))


QKEY = f"md5({s_squeeze('lower(text)')})"


@query("query_hash", with_inputs("query_log", f"SELECT query_id, {QKEY} AS query_key FROM query_log"))
def query_hash(spark, sf):
    return derived.query_log(spark, sf).select("query_id", tx.query_key(F.col("text")).alias("query_key"))


@query("query_reuse", with_inputs("query_log", f"""
SELECT {QKEY} AS query_key, min(query_id) AS first_id, count(*) AS requests, count(*) - 1 AS hits
FROM query_log GROUP BY 1"""))
def query_reuse(spark, sf):
    return intents.query_reuse(derived.query_log(spark, sf))


@query("cache_split", with_inputs("query_log", f"""--cte
keyed AS (SELECT *, {QKEY} AS query_key FROM query_log),
cached AS (SELECT DISTINCT query_key FROM keyed WHERE turn = 0)
SELECT query_id, query_key IN (SELECT query_key FROM cached) AS hit FROM keyed"""))
def cache_split(spark, sf):
    """Results stored for the opening turns answer every repeat of them."""
    log = derived.query_log(spark, sf)
    cached = log.filter("turn = 0").select(tx.query_key(F.col("text")).alias("query_key")).distinct().withColumn("k", F.lit(4))
    hits, misses = intents.split_cached(log, cached, 4)
    return hits.select("query_id", F.lit(True).alias("hit")).unionByName(misses.select("query_id", F.lit(False).alias("hit")))


@query("prototype_counts", """
SELECT label AS category, count(*) AS prototypes, min(vec_id) AS first_id, max(vec_id) AS last_id
FROM embeddings GROUP BY 1""")
def prototype_counts(spark, sf):
    return derived.vectors(spark, sf).groupBy("category").agg(
        F.count("*").alias("prototypes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def s_greedy(source: str, apart: float = 0.85, picks: int = 4) -> str:
    """Picks in order of id, each barring later candidates like it, from ``source(query_id, category, embedding)``."""
    steps = [f"open1 AS (SELECT query_id, category, embedding FROM {source})"]
    for k in range(1, picks + 1):
        steps.append(f"take{k} AS (SELECT * FROM open{k} QUALIFY row_number() OVER (PARTITION BY category ORDER BY query_id) = 1)")
        steps.append(f"""open{k + 1} AS (SELECT o.* FROM open{k} o JOIN take{k} t USING (category) WHERE o.query_id <> t.query_id
  AND coalesce(round(list_dot_product(o.embedding, t.embedding) / nullif(sqrt(list_dot_product(o.embedding, o.embedding))
    * sqrt(list_dot_product(t.embedding, t.embedding)), 0), 6), 0) <= {apart})""")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT query_id, category, {k}::BIGINT AS pos FROM take{k}" for k in range(1, picks + 1))


@query("novel_examples", with_inputs("query_vectors", f"""--cte
candidates AS (SELECT *, (session_id % 10)::INT AS category FROM query_vectors JOIN (
  SELECT query_id, session_id FROM query_log) USING (query_id) WHERE {N} >= 3),
nearest AS (SELECT c.query_id, max(coalesce(round(list_dot_product(c.embedding, e.embedding::DOUBLE[])
    / nullif(sqrt(list_dot_product(c.embedding, c.embedding)), 0)
    / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6), 0)) AS score
  FROM candidates c JOIN embeddings e ON e.label = c.category GROUP BY 1),
picked AS (SELECT * FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY category, {QKEY} ORDER BY query_id) = 1)
  LEFT JOIN nearest USING (query_id) WHERE coalesce(score, -1) <= 0.25), {s_greedy("picked", 0.7)}"""))
def novel_examples(spark, sf):
    log = derived.query_log(spark, sf).select("query_id", (F.col("session_id") % 10).cast("int").alias("category"))
    candidates = derived.query_vectors(spark, sf).join(log, "query_id")
    return intents.novel_examples(candidates, derived.vectors(spark, sf), below=0.25, apart=0.7).drop("description")


@query("system_stats", with_inputs("query_log", f"""--cte {PATTERN}
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT lang) FROM documents) AS languages,
  (SELECT count(*) FROM embeddings) AS vectors, (SELECT max(len(embedding))::BIGINT FROM embeddings) AS dimension,
  (SELECT count(DISTINCT {QKEY}) FROM query_log) AS cache_misses,
  (SELECT round(100 * (count(*) - count(DISTINCT {QKEY})) / count(*), 2) FROM query_log) AS hit_rate,
  (SELECT sum(confidence::DECIMAL(20, 8))::DOUBLE / count(*) FROM pattern) AS avg_confidence"""))
def system_stats(spark, sf):
    docs = table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"))
    vecs = table(spark, sf, "embeddings").agg(
        F.count("*").alias("vectors"), F.max(F.size("embedding")).cast("bigint").alias("dimension"))
    log = derived.query_log(spark, sf)
    reuse = intents.reuse_stats(log)
    classified = intents.classify_pattern(log).agg(
        exact_mean(F.col("confidence")).alias("avg_confidence"))
    return docs.select(
        "*", vecs.select("vectors").scalar().alias("vectors"), vecs.select("dimension").scalar().alias("dimension"),
        reuse.select("misses").scalar().alias("cache_misses"), reuse.select("hit_rate").scalar().alias("hit_rate"),
        classified.scalar().alias("avg_confidence"))


SEEDS = ", ".join(
    f"({i}, {quoted(c)}, {quoted(t)})"
    for i, (c, t) in enumerate((c, t) for c, ts in it.SEED_EXAMPLES.items() for t in ts))


@query("classify_seeded", with_inputs("query_vectors", f"""--cte
seeds(doc_id, category, text) AS (VALUES {SEEDS}),
seed_x AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 4))::INT % {derived.DIM} AS b, count(*)::DOUBLE AS x
  FROM (SELECT doc_id, unnest({s_tokens('text')}) AS t FROM seeds) GROUP BY 1, 2),
best AS (SELECT q.query_id, s.category, s.doc_id, coalesce(round(sum(q.embedding[x.b + 1] * x.x)
    / nullif(any_value(sqrt(list_dot_product(q.embedding, q.embedding))), 0) / sqrt(sum(x.x * x.x)), 6), 0) AS score
  FROM query_vectors q CROSS JOIN seeds s JOIN seed_x x ON x.doc_id = s.doc_id GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, s.doc_id) = 1)
SELECT query_id, CASE WHEN score < 0.65 THEN 'DOCUMENT_QUERY' ELSE category END AS category, score AS confidence FROM best"""))
def classify_seeded(spark, sf):
    """The query log against the seed examples."""
    return classifiers.classify(derived.query_log(spark, sf), "embedding")

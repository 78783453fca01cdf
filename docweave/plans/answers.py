"""Contexts, prompts and response quality over all queries and their passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import formatting as fm
from docweave.functions import quality as ql
from docweave.functions import text as tx
from docweave.operators import context as cx
from docweave.operators import intents
from docweave.operators.tables import written
from docweave.plans import derived
from docweave.plans.derived import with_inputs
from docweave.plans.intents import PATTERN
from docweave.plans.registry import (
    query, quoted, s_any, s_count, s_list, s_match, s_no_punct, s_squeeze, s_starts, s_strip, s_token_estimate, s_words,
)
from docweave.sources.tables import table

EST = s_token_estimate("text")


@query("token_count", f"SELECT doc_id, {EST} AS tokens FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("truncate_tokens", """
SELECT doc_id, CASE WHEN length(text) <= 800 THEN text ELSE substr(text, 1, 797) || '...' END AS text FROM documents""")
def truncate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.truncate_to_tokens(F.col("text"), 200).alias("text"))


def _doubled(spark, sf):
    """Passages repeated to be long enough for cutting, with the tokens of their query's whole context; every third query mentions a test.

    Tokens are counted once a document and added up by query without the texts, which then meet the hits at their documents.
    """
    found = derived.hit_ids(spark, sf)
    queries = derived.query_log(spark, sf).select("query_id", F.col("text").alias("query"))
    asked = found.join(queries.withColumn("query", F.when(F.col("query_id") % 3 == 0, F.concat("query", F.lit(" test"))).otherwise(F.col("query"))), "query_id")
    docs = table(spark, sf, "documents").join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.repeat("text", F.lit(6)).alias("text"))
    tokens = written(docs.select("doc_id", tx.token_estimate(F.col("text")).alias("tokens")))
    totals = asked.select("query_id", "doc_id").join(tokens, "doc_id").groupBy("query_id").agg(F.sum("tokens").alias("total"))
    return asked.join(totals, "query_id").join(docs, "doc_id")


DOUBLED = """
hits AS (SELECT h.query_id, h.rank, h.doc_id, repeat(h.text, 6) AS text,
    q.query_id % 3 = 0 OR contains(lower(q.text), 'test') AS test
  FROM query_hits h JOIN query_log q USING (query_id))"""


def s_optimized(small: bool) -> str:
    cut = ("substr(text, 1, CASE WHEN test THEN 1536 ELSE 3072 END)" if small else
           "CASE WHEN test THEN substr(text, 1, 1536) || '...' || right(text, 1536) "
           "ELSE substr(text, 1, 3070) || '...' || right(text, 3070) END")
    limit = "CASE WHEN test THEN 1536 ELSE 3072 END" if small else "CASE WHEN test THEN 3072 ELSE 6144 END"
    budget = 1536 if small else 6963
    return f"""CASE WHEN (test OR sum({EST}) OVER (PARTITION BY query_id) > {budget})
      AND length(text) > {limit} THEN {cut} ELSE text END"""


@query("optimize_context", with_inputs("query_hits", f"""--cte {DOUBLED}
SELECT query_id, rank, doc_id, md5({s_optimized(True)}) AS small_key, md5({s_optimized(False)}) AS large_key,
  length({s_optimized(False)})::BIGINT AS large_chars FROM hits"""))
def optimize_context(spark, sf):
    hits = _doubled(spark, sf).withColumn("whole", F.col("text"))
    large = cx.optimize_context(hits, "large", total="total").select(
        "query_id", "query", "rank", "doc_id", "total", F.md5("text").alias("large_key"), F.length("text").cast("bigint").alias("large_chars"),
        F.col("whole").alias("text"))
    keys = written(cx.optimize_context(large, "small", total="total").select(
        "query_id", "rank", "doc_id", "large_key", "large_chars", F.md5("text").alias("small_key")))
    return keys.drop("small_key").join(keys.select("query_id", "rank", "small_key"), ["query_id", "rank"])


@query("pack_context", with_inputs("query_hits", f"""
SELECT query_id, rank, doc_id, tokens, used FROM (
  SELECT *, (sum(tokens) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS used
  FROM (SELECT *, {EST} AS tokens FROM query_hits)) WHERE used <= 800"""))
def pack_context(spark, sf):
    return cx.pack_context(derived.query_hits(spark, sf), 800).select("query_id", "rank", "doc_id", "tokens", "used")


ROUTED = f"""{PATTERN},
routed AS (SELECT *, CASE category WHEN 'CONVERSATION' THEN 0 WHEN 'CONCISE_QUERY' THEN 3 ELSE 5 END AS k FROM pattern)"""


@query("route_queries", with_inputs("query_hits", f"""--cte {ROUTED}
SELECT query_id, category, k::BIGINT AS k, string_agg(source, ',' ORDER BY rank) FILTER (rank <= k) AS sources
FROM routed LEFT JOIN query_hits USING (query_id) GROUP BY ALL"""))
def route_queries(spark, sf):
    routed = cx.route(intents.classify_pattern(derived.query_log(spark, sf)), "large").select("query_id", "category", "k")
    wanted = derived.query_hits(spark, sf).join(routed, "query_id").filter("rank <= k")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "source")))
    sources = wanted.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda e: e["source"]), ",").alias("sources"))
    return routed.join(sources, "query_id", "left")


def s_prompt(size: str, style: str) -> str:
    before, rest = fm.PROMPTS[size, style].split("{context}")
    between, after = rest.split("{query}")
    return f"{quoted(before)} || context || {quoted(between)} || text || {quoted(after)}"


@query("build_prompts", with_inputs("query_hits", f"""--cte {ROUTED},
contexts AS (SELECT query_id, category, r.text, coalesce(string_agg(h.text, chr(10) || chr(10) ORDER BY rank), '') AS context
  FROM routed r LEFT JOIN query_hits h USING (query_id) WHERE k > 0 AND rank <= k GROUP BY ALL)
SELECT query_id, md5(CASE category WHEN 'CONCISE_QUERY' THEN {s_prompt('large', 'concise')}
    ELSE {s_prompt('large', 'document')} END) AS large_key,
  length({s_prompt('small', 'document')})::BIGINT AS small_chars FROM contexts"""))
def build_prompts(spark, sf):
    routed = cx.route(intents.classify_pattern(derived.query_log(spark, sf)), "large").withColumnRenamed("text", "query")
    hits = derived.query_hits(spark, sf)
    large = cx.build_prompts(routed, hits, "large").select("query_id", F.md5("prompt").alias("large_key"))
    small = cx.build_prompts(routed.withColumn("category", F.lit("DOCUMENT_QUERY")), hits, "small").select(
        "query_id", F.length("prompt").cast("bigint").alias("small_chars"))
    return large.join(small, "query_id")


# Response quality.

def _pairs(spark, sf):
    """Query, response and the text of all its passages."""
    contexts = cx.joined_context(derived.query_hits(spark, sf), " ")
    return derived.qa_pairs(spark, sf).join(contexts, "query_id", "left")


def s_terms(x: str) -> str:
    return f"list_distinct({s_words(s_no_punct(f'lower({x})'))})"


S_REL = f"""CASE WHEN len({s_terms('query')}) = 0 THEN 0.5 ELSE least(1.0,
    len(list_intersect({s_terms('query')}, {s_terms('response')})) / len({s_terms('query')})
    * CASE WHEN {s_count('response')} < 5 THEN 0.5 WHEN {s_count('response')} > 500 THEN 0.8 ELSE 1.0 END * 1.5) END"""


@query("eval_relevance", with_inputs("qa_pairs", f"SELECT query_id, round({S_REL}, 6)::DOUBLE AS relevance FROM qa_pairs"))
def eval_relevance(spark, sf):
    return derived.qa_pairs(spark, sf).select(
        "query_id", F.round(ql.relevance(F.col("query"), F.col("response")), 6).alias("relevance"))


CONTEXTS = """
pairs AS (SELECT p.*, coalesce(lower(c.context), '') AS context FROM qa_pairs p LEFT JOIN (
  SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS context FROM query_hits GROUP BY 1) c
  USING (query_id))"""
S_CLAIMS = "list_concat(" * (len(ql.CERTAINTY) - 1)
for _i, _c in enumerate(ql.CERTAINTY):
    _x = f"regexp_extract_all(lower(response), {quoted(_c.lower() + '[^.!?]*[.!?]')})"
    S_CLAIMS += _x if _i == 0 else f", {_x})"
_KEY = f"list_filter({s_words(s_no_punct('claim'))}, lambda t: length(t) > 4 AND NOT list_contains({s_list(ql.EMPTY_WORDS)}, t))"
CLAIMS = f"""
claims AS (SELECT query_id, context, {_KEY} AS terms FROM (SELECT query_id, context, unnest({S_CLAIMS}) AS claim FROM pairs)),
unsupported AS (SELECT query_id, bool_or(len(terms) > 0
    AND len(list_filter(terms, lambda t: contains(context, t))) * 2 < len(terms)) AS u FROM claims GROUP BY 1)"""


@query("eval_hallucination", with_inputs("qa_pairs query_hits", f"""--cte {CONTEXTS}, {CLAIMS}
SELECT query_id, coalesce(u, false) AS unsupported FROM pairs LEFT JOIN unsupported USING (query_id)"""))
def eval_hallucination(spark, sf):
    return _pairs(spark, sf).select(
        "query_id", ql.unsupported_claim(F.col("response"), F.col("context")).alias("unsupported"))


_BUL = f"regexp_extract_all(response, {quoted(ql.BULLET)}, 1)"
S_ISSUES = f"""list_concat(list_filter([
  CASE WHEN {s_match('response', [r'[a-zA-Z],' + chr(92) + 's*$'])} OR ends_with(response, '...') THEN 'Response ends with incomplete sentence' END,
  CASE WHEN len({_BUL}) > 10 THEN 'Excessive use of bullet points (' || len({_BUL}) || ' found)' END,
  CASE WHEN len(list_distinct({_BUL})) > 1 THEN 'Inconsistent bullet point styles' END,
  CASE WHEN len(regexp_extract_all(response, '```')) <> len(regexp_extract_all(response, {quoted(ql.CLOSED_FENCE)}))
    THEN 'Mismatched code block formatting' END], lambda s: s IS NOT NULL),
  list_filter(list_transform(regexp_split_to_array(response, '[\\n\\r]{{2,}}'), lambda p, i:
    CASE WHEN {s_count('p')} > 150 THEN 'Paragraph ' || i || ' is excessively long (' || {s_count('p')} || ' words)' END),
    lambda s: s IS NOT NULL))"""


@query("eval_formatting", with_inputs("qa_pairs", f"""
SELECT query_id, len(issues)::BIGINT AS n_issues, array_to_string(issues, '; ') AS issues
FROM (SELECT query_id, {S_ISSUES} AS issues FROM qa_pairs)"""))
def eval_formatting(spark, sf):
    return derived.qa_pairs(spark, sf).select("query_id", ql.formatting_issues(F.col("response")).alias("i")).select(
        "query_id", F.size("i").cast("bigint").alias("n_issues"), F.array_join("i", "; ").alias("issues"))


def s_length(limit: int) -> str:
    return f"""({s_count('response')} >= 5 AND {s_count('response')} <= CASE WHEN {s_count('query')} < 15 THEN 200
      WHEN {s_count('query')} < 30 THEN 400 ELSE {limit} END)"""


@query("eval_length", with_inputs("qa_pairs", f"""
SELECT query_id, {s_length(800)} AS small_ok, {s_length(600)} AS large_ok FROM qa_pairs"""))
def eval_length(spark, sf):
    q, r = F.col("query"), F.col("response")
    return derived.qa_pairs(spark, sf).select(
        "query_id", ql.length_fits(q, r, "small").alias("small_ok"), ql.length_fits(q, r, "large").alias("large_ok"))


_Q, _R = "lower(query)", "lower(response)"
_SUBJECT = f"""regexp_replace({s_strip(f"regexp_replace({_Q}, '{'|'.join(ql.TOPIC_REQUESTS)}', '', 'g')")}, '\\A\\.+|\\.+\\z', '', 'g')"""
_NOUNS = f"list_filter({s_words(s_no_punct(_Q))}, lambda w: length(w) > 3 AND NOT list_contains({s_list(ql.QUESTION_WORDS)}, w))"
S_ANSWERED = f"""CASE
  WHEN {s_starts(_Q, ql.TOPIC_REQUESTS)} AND length({_SUBJECT}) > 0 AND contains({_R}, {_SUBJECT}) THEN true
  WHEN NOT ({s_starts(_Q, ql.QUESTION_WORDS)} OR contains(query, '?')) THEN {s_count('response')} >= 10
  WHEN len({_NOUNS}) > 0 AND len(list_filter({_NOUNS}, lambda w: contains({_R}, w))) * 2 >= len({_NOUNS}) THEN true
  WHEN contains(query, '?') AND {s_match(_R, ql.ANSWER_PATTERNS)} THEN true
  WHEN {s_any(_Q, ['when', 'date', 'year'])} AND {s_match(_R, ql.DATE_PATTERNS)} THEN true
  ELSE {s_count('response')} >= 20 END"""


@query("eval_answered", with_inputs("qa_pairs", f"SELECT query_id, {S_ANSWERED} AS answered FROM qa_pairs"))
def eval_answered(spark, sf):
    return derived.qa_pairs(spark, sf).select(
        "query_id", ql.question_answered(F.col("query"), F.col("response")).alias("answered"))


EVALUATED = f"""{CONTEXTS}, {CLAIMS},
measured AS (SELECT query_id, {S_REL} AS rel, coalesce(u, false) AS u, {S_ISSUES} AS issues,
    {s_length(600)} AS fits, {S_ANSWERED} AS answered FROM pairs LEFT JOIN unsupported USING (query_id)),
scored AS (SELECT *, greatest(0, least(1, rel * 0.4 + CASE WHEN u THEN -0.3 ELSE 0.3 END
    + (1 - least(1, len(issues) / 5)) * 0.1 + CASE WHEN fits THEN 0.1 ELSE 0 END
    + CASE WHEN answered THEN 0.1 ELSE 0 END))::DOUBLE AS overall FROM measured)"""


@query("eval_overall", with_inputs("qa_pairs query_hits", f"""--cte {EVALUATED}
SELECT query_id, round(overall, 6) AS overall FROM scored"""))
def eval_overall(spark, sf):
    return ql.evaluate(_pairs(spark, sf)).select("query_id", F.round("overall", 6).alias("overall"))


@query("eval_regenerate", with_inputs("qa_pairs query_hits", f"""--cte {EVALUATED}
SELECT query_id, reason <> '' AS regenerate, reason FROM (SELECT query_id,
  CASE WHEN u THEN 'Potential hallucination detected'
    WHEN overall < 0.5 THEN 'Low quality score (' || printf('%.2f', overall) || ')'
    WHEN NOT answered THEN 'Question not directly answered'
    WHEN len(issues) >= 3 THEN 'Multiple formatting issues: ' || array_to_string(issues[1:3], ', ')
    ELSE '' END AS reason FROM scored)"""))
def eval_regenerate(spark, sf):
    return ql.evaluate(_pairs(spark, sf)).select("query_id", "regenerate", "reason")


_CLEAN = s_squeeze(f"regexp_replace(response, {quoted(fm.LABEL_PREFIX)}, '')")


def s_format(limit: int) -> str:
    return f"""CASE WHEN length(c) <= {limit} THEN c
      WHEN {limit} - instr(reverse(substr(c, 1, {limit})), '.') > {limit} * 0.8 AND contains(substr(c, 1, {limit}), '.')
        THEN substr(c, 1, {limit} - instr(reverse(substr(c, 1, {limit})), '.') + 1)
      ELSE substr(c, 1, {limit}) || '...' END"""


@query("format_response", with_inputs("qa_pairs", f"""
SELECT query_id, {s_format(250)} AS small_text, {s_format(500)} AS large_text
FROM (SELECT query_id, {_CLEAN} AS c FROM qa_pairs)"""))
def format_response(spark, sf):
    r = F.col("response")
    return derived.qa_pairs(spark, sf).select(
        "query_id", fm.format_response(r, 250).alias("small_text"), fm.format_response(r, 500).alias("large_text"))


@query("validate_response", with_inputs("qa_pairs", f"""
SELECT query_id, CASE WHEN length(coalesce(response, '')) < 10 THEN {quoted(fm.TOO_SHORT)}
  WHEN {s_any(_R, [p.lower() for p in fm.REFUSALS])} THEN {quoted(fm.NOT_COVERED)}
  WHEN contains({_Q}, 'test') THEN response || {quoted(fm.TEST_NOTE)} ELSE response END AS response FROM qa_pairs"""))
def validate_response(spark, sf):
    return derived.qa_pairs(spark, sf).select(
        "query_id", fm.validate_response(F.col("response"), F.col("query")).alias("response"))


@query("hybrid_response", with_inputs("qa_pairs query_hits", f"""
SELECT p.query_id, CASE WHEN {s_count('query')} < 4 OR contains({_Q}, 'test') OR h.text IS NULL
    OR contains({_R}, lower(CASE WHEN length(h.text) > 150 THEN substr(h.text, 1, 150) || '...' ELSE h.text END))
  THEN response ELSE response || chr(10) || chr(10) || 'Relevant information from documentation: "'
    || CASE WHEN length(h.text) > 150 THEN substr(h.text, 1, 150) || '...' ELSE h.text END || '"' END AS response
FROM qa_pairs p LEFT JOIN query_hits h ON h.query_id = p.query_id AND h.rank = 1"""))
def hybrid_response(spark, sf):
    top = derived.query_hits(spark, sf).filter("rank = 1").select("query_id", F.col("text").alias("top_text"))
    return derived.qa_pairs(spark, sf).join(top, "query_id", "left").select(
        "query_id", fm.hybrid_response(F.col("response"), F.col("query"), F.col("top_text")).alias("response"))

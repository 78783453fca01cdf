"""Corpus scans, chunking, hygiene and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import chunking, hygiene, incremental, lexical
from docweave.operators.ranks import global_rank
from docweave.plans import derived
from docweave.plans.derived import with_inputs
from docweave.plans.registry import query, s_strip, s_tokens, s_words
from docweave.sources.tables import spread, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _texts(spark, sf):
    return spread(_docs(spark, sf).select("doc_id", "text"), "doc_id")


@query("doc_source_scan", """
SELECT doc_id, source, lower(regexp_extract(source, '[0-9]+$', 0)) AS source_no, lang,
  length(text)::BIGINT AS n_chars, octet_length(encode(text))::BIGINT AS n_bytes
FROM documents WHERE lang IN ('en', 'de')""")
def doc_source_scan(spark, sf):
    return _docs(spark, sf).filter(F.col("lang").isin("en", "de")).select(
        "doc_id", "source", F.lower(F.regexp_extract("source", "[0-9]+$", 0)).alias("source_no"), "lang",
        F.length("text").cast("bigint").alias("n_chars"), F.octet_length("text").cast("bigint").alias("n_bytes"))


CHUNKS = """
chunks AS (SELECT doc_id, source, i AS chunk_index, n AS total_chunks, substr(text, i * 1000 + 1, 1000) AS text
  FROM (SELECT *, ceil(length(text) / 1000.0)::BIGINT AS n, unnest(range(0, ceil(length(text) / 1000.0)::BIGINT)) AS i
        FROM documents))"""


@query("chunk_fixed", f"WITH {CHUNKS} SELECT doc_id, chunk_index, total_chunks, text FROM chunks")
def chunk_fixed(spark, sf):
    return chunking.chunk_fixed(_docs(spark, sf).select("doc_id", "text"), 1000).select(
        "doc_id", "chunk_index", "total_chunks", "text")


@query("chunk_counts", f"""
WITH {CHUNKS} SELECT doc_id, count(*) AS chunk_count, sum(length(text))::BIGINT AS n_chars
FROM chunks GROUP BY 1""")
def chunk_counts(spark, sf):
    return chunking.chunk_fixed(_docs(spark, sf).select("doc_id", "text"), 1000).groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"), F.sum(F.length("text")).alias("n_chars"))


def s_recursive(size: int, overlap: int, separators: tuple[str, ...]) -> str:
    """Pieces level by level, cuts as running sums of their lengths, and a chain of chunks from cut to cut."""
    levels, pieces = [], "[text]"
    for k, sep in enumerate(separators):
        mark = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in sep) or "''"
        cut = (f"list_filter(list_transform(string_split(p, {mark}), lambda c, i: CASE WHEN i = 1 THEN c ELSE {mark} || c END), lambda c: c <> '')"
               if sep else "regexp_extract_all(p, '(?s).')")
        held = f"contains(p, {mark})" if sep else "true"
        levels.append(f"level{k} AS (SELECT doc_id, text, flatten(list_transform({pieces}, lambda p: CASE WHEN length(p) > {size} AND {held} "
                      f"THEN {cut} ELSE [p] END)) AS pieces FROM {'level' + str(k - 1) if k else 'documents'})")
        pieces = "pieces"
    return f"""
WITH RECURSIVE {", ".join(levels)},
ends AS (SELECT doc_id, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS b FROM (
  SELECT doc_id, unnest(pieces) AS p, unnest(range(1, len(pieces) + 1)) AS i FROM level{len(separators) - 1})),
cuts AS (SELECT doc_id, list_prepend(0::BIGINT, list(b ORDER BY b)) AS bs FROM ends WHERE b > 0 GROUP BY 1),
chain AS (
  SELECT doc_id, bs, 1::BIGINT AS i, 0::BIGINT AS s, list_max(list_filter(bs, lambda x: x <= {size})) AS e FROM cuts
  UNION ALL
  SELECT doc_id, bs, i + 1, s2, list_max(list_filter(bs, lambda x: x <= s2 + {size})) FROM (
    SELECT *, list_min(list_filter(bs, lambda x: x >= greatest(e - {overlap}, list_min(list_filter(bs, lambda y: y > e)) - {size}))) AS s2
    FROM chain WHERE e < list_max(bs))),
chunks AS (SELECT doc_id, i, {s_strip("substr(text, s + 1, e - s)")} AS text FROM chain JOIN documents USING (doc_id))
SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS total_chunks,
  row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, text FROM chunks WHERE text <> ''"""


@query("chunk_recursive", s_recursive(**chunking.PLAIN))
def chunk_recursive(spark, sf):
    return chunking.chunk_recursive(_texts(spark, sf), **chunking.PLAIN)


@query("chunk_sentences", s_recursive(**chunking.SENTENCE))
def chunk_sentences(spark, sf):
    return chunking.chunk_recursive(_texts(spark, sf), **chunking.SENTENCE)


@query("chunk_paragraph", f"""
WITH RECURSIVE paras AS (
  SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
fold AS (
  SELECT doc_id, p, 1::BIGINT AS i, p[1] AS cur, NULL::VARCHAR AS emitted, 0::BIGINT AS done FROM paras
  UNION ALL
  SELECT doc_id, p, i + 1,
    CASE WHEN base <> '' THEN base || chr(10) || p[i + 1] ELSE p[i + 1] END,
    CASE WHEN full_ THEN cur END, done + full_::INT
  FROM (SELECT *, CASE WHEN NOT full_ THEN cur WHEN len(w) > 20 THEN array_to_string(w[-20:], ' ') || chr(10) ELSE '' END AS base
    FROM (SELECT *, length(cur) + length(p[i + 1]) > 1000 AND cur <> '' AS full_, {s_words('cur')} AS w
          FROM fold WHERE i < len(p)))),
pieces AS (
  SELECT doc_id, done - 1 AS chunk_index, emitted AS text FROM fold WHERE emitted IS NOT NULL
  UNION ALL SELECT doc_id, done, cur FROM fold WHERE i = len(p) AND cur <> '')
SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, text FROM pieces""")
def chunk_paragraph(spark, sf):
    return chunking.chunk_paragraphs(
        _texts(spark, sf), 1000, separator="\n", glue="\n"
    ).select("doc_id", "chunk_index", "total_chunks", "text")


@query("split_headings", with_inputs("headed_docs", r"""--cte
lines AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM headed_docs),
marked AS (SELECT *, regexp_matches(line, '^#{1,2}[ \t]+[^\s]') AS h FROM lines),
kind AS (SELECT doc_id, max(n) > 2000 AS big, bool_or(h) AS headed FROM marked GROUP BY 1),
numbered AS (SELECT m.*, k.big, k.headed,
    CASE WHEN big THEN sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) ELSE 0 END AS sec
  FROM marked m JOIN kind k USING (doc_id)),
sections AS (
  SELECT doc_id, sec, arg_min(line, i) AS first_line, string_agg(line, chr(10) ORDER BY i) AS text, max(i) AS last_i
  FROM numbered WHERE headed OR NOT big GROUP BY 1, 2),
parts AS (
  SELECT doc_id, first_line,
    CASE WHEN last_i < max(last_i) OVER (PARTITION BY doc_id) THEN text || chr(10) ELSE text END AS text,
    row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS chunk_index,
    count(*) OVER (PARTITION BY doc_id) AS total_chunks
  FROM sections
  UNION ALL
  SELECT doc_id, '', substr(text, j * 2000 + 1, 2000), j, ceil(length(text) / 2000.0)::BIGINT
  FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 2000.0)::BIGINT)) AS j
        FROM headed_docs JOIN kind USING (doc_id) WHERE big AND NOT headed))
SELECT doc_id, chunk_index, total_chunks, text,
  CASE WHEN total_chunks > 1 THEN regexp_replace(lower(""" + s_strip(
    rf"regexp_replace(regexp_extract(first_line, '\A#{{1,2}}[ \t]+([^\n]+)', 1), '[^{tx.WORD_SET}{tx.SPACE_SET}\-]', '', 'g')"
) + rf"""), '[\-{tx.SPACE_SET}]+', '-', 'g') ELSE '' END AS slug
FROM parts"""))
def split_headings(spark, sf):
    return chunking.split_headings(derived.headed_docs(spark, sf), 2000).select(
        "doc_id", "chunk_index", "total_chunks", "text", "slug")


@query("placeholder_docs", f"""
SELECT doc_id, length({s_strip('text')})::BIGINT AS kept_chars FROM documents
WHERE length({s_strip('text')}) < 20""")
def placeholder_docs(spark, sf):
    return _docs(spark, sf).filter(hygiene.is_placeholder(F.col("text"))).select(
        "doc_id", F.length(tx.strip(F.col("text"))).cast("bigint").alias("kept_chars"))


@query("exact_duplicates", """
SELECT md5(text) AS text_key, min(doc_id) AS keep_id, count(*) AS copies
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark, sf):
    return hygiene.exact_duplicates(_docs(spark, sf))


WORD_SETS = f"""
sets AS (SELECT doc_id, list_sort(list_distinct({s_words(f"regexp_replace(text, '{hygiene.MARKS}', '', 'g')")})) AS items
  FROM documents),
keyed AS (SELECT doc_id, items, min(doc_id) OVER (PARTITION BY items) AS rep FROM sets WHERE len(items) > 0),
reps AS (SELECT doc_id, items, len(items) AS n FROM keyed WHERE doc_id = rep),
postings AS (SELECT doc_id, n, unnest(items) AS item FROM reps),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM postings a JOIN postings b ON a.item = b.item AND a.doc_id < b.doc_id
    AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9 GROUP BY 1, 2),
edges AS (
  SELECT a AS id_a, b AS id_b, o / (na + nb - o) AS jaccard FROM shared WHERE o / (na + nb - o) > 0.85
  UNION ALL SELECT rep, doc_id, 1.0 FROM keyed WHERE rep <> doc_id)"""


@query("near_duplicates", f"WITH {WORD_SETS} SELECT id_a, id_b, round(jaccard, 6)::DOUBLE AS jaccard FROM edges")
def near_duplicates(spark, sf):
    return hygiene.near_duplicates(_texts(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@query("near_duplicate_groups", f"""
WITH RECURSIVE {WORD_SETS},
links AS (SELECT id_a AS a, id_b AS b FROM edges UNION SELECT id_b, id_a FROM edges),
reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, min(other) AS group_id FROM reach GROUP BY 1""")
def near_duplicate_groups(spark, sf):
    """Every near duplicate with the lowest id of its group."""
    return hygiene.near_duplicate_groups(_texts(spark, sf)).select("doc_id", "group_id")


def s_decided(rounds: int = 8) -> str:
    """Ids decided in order: the lowest of what is open stays, its neighbours go, and so on."""
    steps = ["open0 AS (SELECT id_a, id_b FROM edges WHERE id_a IN (SELECT doc_id FROM reps) AND id_b IN (SELECT doc_id FROM reps))"]
    for k in range(rounds):
        steps.append(f"out{k} AS (SELECT DISTINCT id_b FROM open{k} WHERE id_a NOT IN (SELECT id_b FROM open{k}))")
        steps.append(f"open{k + 1} AS (SELECT * FROM open{k} WHERE id_b NOT IN (FROM out{k}) AND id_a NOT IN (FROM out{k}))")
    return ", ".join(steps) + ", lost AS (" + " UNION ".join(f"FROM out{k}" for k in range(rounds)) + ")"


@query("dedup_keep_first", f"""
WITH {WORD_SETS}, {s_decided()},
wordless AS (SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY d.text) AS keep
  FROM documents d JOIN sets s USING (doc_id) WHERE len(s.items) = 0)
SELECT doc_id, source FROM documents
WHERE doc_id NOT IN (FROM lost) AND doc_id NOT IN (SELECT doc_id FROM keyed WHERE doc_id <> rep)
  AND doc_id NOT IN (SELECT doc_id FROM wordless WHERE doc_id <> keep)""")
def dedup_keep_first(spark, sf):
    return hygiene.drop_duplicates(spread(_docs(spark, sf).select("doc_id", "source", "text"), "doc_id")).select(
        "doc_id", "source")


@query("large_docs", """
SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes FROM documents WHERE octet_length(encode(text)) > 30000""")
def large_docs(spark, sf):
    return _docs(spark, sf).filter(hygiene.is_large(F.col("text"))).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("hygiene_summary", f"""
SELECT count(*) AS documents, count_if(length({s_strip('text')}) < 20)::BIGINT AS placeholders,
  count_if(octet_length(encode(text)) > 30000)::BIGINT AS large,
  (count(*) - count(DISTINCT text))::BIGINT AS surplus_copies FROM documents""")
def hygiene_summary(spark, sf):
    return hygiene.hygiene_summary(_docs(spark, sf).select("doc_id", "text"))


@query("corpus_stats", """
SELECT lang, source, count(*) AS documents, sum(n_chars)::BIGINT AS n_chars, max(doc_id) AS latest
FROM documents GROUP BY 1, 2""")
def corpus_stats(spark, sf):
    return _docs(spark, sf).groupBy("lang", "source").agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("n_chars"), F.max("doc_id").alias("latest"))


@query("list_sources", f"""
WITH {CHUNKS} SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, min(doc_id) AS first_doc,
  row_number() OVER (ORDER BY min(doc_id)) AS position FROM chunks GROUP BY 1""")
def list_sources(spark, sf):
    n_chunks = F.ceil(F.length("text") / 1000)
    per_source = _docs(spark, sf).filter(F.length("text") > 0).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(n_chunks).cast("bigint").alias("chunks"),
        F.min("doc_id").alias("first_doc"))
    return global_rank(per_source, ["first_doc"], "position")


@query("vector_stats", """
SELECT count(*) AS vectors, max(len(embedding))::BIGINT AS dimension, count(DISTINCT label) AS categories,
  (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS sources
FROM embeddings""")
def vector_stats(spark, sf):
    docs = _docs(spark, sf).agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
    return table(spark, sf, "embeddings").agg(
        F.count("*").alias("vectors"), F.max(F.size("embedding")).cast("bigint").alias("dimension"),
        F.countDistinct("label").alias("categories"),
    ).select("*", docs.select("documents").scalar().alias("documents"), docs.select("sources").scalar().alias("sources"))


POSTINGS = f"""
toks AS (SELECT doc_id, source, unnest({s_tokens('text')}) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
doclen AS (SELECT doc_id, count(*) AS dl FROM toks GROUP BY 1),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
stats AS (SELECT count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens, avg(dl) AS avgdl FROM doclen)"""


@query("domain_terms", f"""
WITH {POSTINGS}
SELECT source, term, tf, df, weight, rank FROM (
  SELECT source, term, tf, df, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank
  FROM (SELECT source, term, tf, df, round(tf * ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) AS weight
        FROM (SELECT source, term, count(*) AS tf FROM toks GROUP BY 1, 2) JOIN terms USING (term), stats))
WHERE rank <= 10""")
def domain_terms(spark, sf):
    return lexical.domain_terms(_docs(spark, sf).select("doc_id", "source", "text"), "source", 10)


@query("doc_changes", """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 = 1 THEN 'deleted' ELSE 'modified' END AS change
FROM documents WHERE doc_id % 10 IN (0, 1) OR doc_id % 7 = 0""")
def doc_changes(spark, sf):
    return incremental.doc_changes(*derived.snapshots(spark, sf))


@query("incremental_merge", """
WITH new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' rev2' ELSE text END AS text
  FROM documents WHERE doc_id % 10 <> 1)
SELECT doc_id, i AS chunk_index, substr(text, i * 1000 + 1, 1000) AS text
FROM (SELECT *, unnest(range(0, ceil(length(text) / 1000.0)::BIGINT)) AS i FROM new)""")
def incremental_merge(spark, sf):
    old, new = derived.snapshots(spark, sf)
    merged = incremental.merge_chunks(
        chunking.chunk_fixed(old, 1000), new, incremental.doc_changes(old, new), lambda d: chunking.chunk_fixed(d, 1000))
    return merged.select("doc_id", "chunk_index", "text")

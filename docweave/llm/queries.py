"""Registered queries of this package over the given tables, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import (
    chosen_path, decontaminate, edit_fingerprints, hidden_markov, host_trust, lattice_pieces, license_scan, line_templates, substring_dedup,
    threshold_search, turn_repair, weak_labels, whitening,
)
from docweave.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


ALNUM_SQL = r"regexp_extract_all(" + LOWER_SQL.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_decontaminate", sql=f"""
    WITH d AS (SELECT doc_id, {ALNUM_SQL} AS w FROM documents),
    b AS (SELECT item_id, {ALNUM_SQL} AS w FROM benchmark),
    windows AS (
      SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
      FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
            FROM b WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT k FROM windows),
    places AS (
      SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
    hits AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, s)),
    words AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY 1),
    items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document inside verbatim benchmark passages of 13 words."""
    judged = decontaminate.contamination(
        table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), drop=("text",))
    return judged.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


WORDS_SQL = r"regexp_extract_all(" + LOWER_SQL.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"


@query("op5_chosen_path", sql=f"""
    WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) < 2 THEN w
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    common AS (
      SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
      FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY 1, 2),
    links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sets JOIN classes USING (doc_id)""")
def op5_chosen_path(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all documents on shingles of two words, similarity 0.8."""
    found = chosen_path.near_duplicates(table(spark, sf, "documents"), shingle=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op2_hidden_markov")
def op2_hidden_markov(spark: SparkSession, sf: str) -> DataFrame:
    """Log10 probability of every document under a hidden Markov model of the training share."""
    docs = table(spark, sf, "documents")
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    scored = hidden_markov.score_texts(docs, train)
    return scored.withColumn("held_out", ~F.col("train")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_weak_labels")
def op3_weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of all documents: posteriors of the weak labels and scores of the linear model."""
    return weak_labels.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_lattice_pieces")
def op7_lattice_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """A sampled segmentation of every document, decoded again and compared."""
    pieces = lattice_pieces.encode(table(spark, sf, "documents").select("doc_id", "text"), check=True).drop("text")
    return pieces.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), "piece_ids", "lossless")


LEAF_SQL = """
    split_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    tokens AS (
      SELECT doc_id, i, list_filter(string_split_regex(regexp_replace(ls[i], '[0-9]+', '<*>', 'g'), '[ \t\r]+'), lambda t: t <> '') AS t
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split_lines)),
    leaves AS (
      SELECT doc_id, i, CASE WHEN len(t) = 0 THEN ''
        ELSE len(t) || ' ' || array_to_string(t[1:greatest((len(t) + 1) // 2, least(len(t), 6))], ' ') END AS leaf FROM tokens),
    placed AS (
      SELECT doc_id, i, leaf, coalesce(lag(leaf) OVER w, '') AS a, coalesce(lead(leaf) OVER w, '') AS b
      FROM leaves WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    recurring AS (
      SELECT leaf, min(doc) AS keeper FROM (SELECT leaf, a, b, min(doc_id) AS doc FROM placed WHERE leaf <> '' GROUP BY ALL)
      GROUP BY 1 HAVING count(DISTINCT doc) >= 10),
    gone AS (SELECT doc_id, i FROM placed JOIN recurring USING (leaf) WHERE doc_id <> keeper)"""


@query("op8_line_templates", sql=f"""
    WITH {LEAF_SQL},
    dropped AS (SELECT doc_id, list(i) AS g, count(*) AS n FROM gone GROUP BY 1)
    SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n, 0) AS n_dropped,
      array_to_string(CASE WHEN g IS NULL THEN ls ELSE list_filter(ls, lambda l, i: NOT list_contains(g, i)) END, chr(10)) AS text
    FROM split_lines LEFT JOIN dropped USING (doc_id)""")
def op8_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without lines of templates that recur across documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs, surroundings=True).select("doc_id", "n_lines", "n_dropped", "text")


RULES = [
    host_trust.Rule("allow", "org", "/"), host_trust.Rule("block", "example.org", "/es/"),
    host_trust.Rule("block", "example.org", "/en/1"), host_trust.Rule("allow", "com", "/fr/"), host_trust.Rule("block", "com", "/de/"),
]


def _trust_sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r.host + r.path))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered]
    rule = " ".join(f"WHEN {f} THEN '{r.host}{r.path}'" for f, r in zip(fits, ordered))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, ordered))
    lower = LOWER_SQL.format("regexp_extract(rest, '^[^/?#]*')")
    target = LOWER_SQL.format("unnest(regexp_extract_all(html, '" + host_trust.LINK.replace("'", "''") + "', 1))")
    steps = []
    for k in range(host_trust.ROUNDS):
        steps.append(f"""
        r{k + 1} AS (SELECT kind, host, sum(x) AS x FROM (
          SELECT r.kind, coalesce(e.target, r.host) AS host, r.x * coalesce(e.share, {host_trust.DAMPING}) AS x
          FROM r{k} r LEFT JOIN edges e ON e.kind = r.kind AND e.host = r.host
          UNION ALL SELECT kind, host, {1 - host_trust.DAMPING} * x FROM r0) GROUP BY 1, 2)""")
    return f"""
    WITH rests AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, html, {lower} AS host,
      regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rests),
    judged AS (SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {verdict} END AS verdict FROM parts),
    raw AS (SELECT host AS source, {target} AS target FROM judged),
    hosts AS (SELECT host FROM judged UNION SELECT target FROM raw),
    labels AS (SELECT string_split(host, '.') AS l FROM hosts),
    chain AS (
      SELECT DISTINCT array_to_string(l[i:], '.') AS low, array_to_string(l[i + 1:], '.') AS high
      FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels WHERE len(l) > 2)),
    links AS (
      SELECT source, target, count(*) AS links FROM (
        SELECT source, target FROM raw UNION ALL SELECT low, high FROM chain UNION ALL SELECT high, low FROM chain)
      WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2),
    both_ways AS (SELECT 'trust' AS kind, source, target, links FROM links UNION ALL SELECT 'distrust', target, source, links FROM links),
    edges AS (SELECT kind, source AS host, target, {host_trust.DAMPING} * links / sum(links) OVER (PARTITION BY kind, source) AS share FROM both_ways),
    r0 AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS x
           FROM judged WHERE rule IS NOT NULL AND host <> '' GROUP BY 1, 2),
    {",".join(steps)},
    scores AS (SELECT host, sum(CASE kind WHEN 'distrust' THEN x ELSE -x END) AS excess FROM r{host_trust.ROUNDS} GROUP BY 1)
    SELECT page_id, host, path, rule,
      coalesce(verdict, CASE WHEN round(coalesce(excess, 0), 9) > 0 THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged LEFT JOIN scores USING (host)"""


@query("op9_host_trust", sql=_trust_sql())
def op9_host_trust(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's verdict by URL rules, else by the trust its host has gathered over links."""
    return host_trust.judge(table(spark, sf, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def repository_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files of source trees; every third with a licence notice is a licence file."""
    notice = F.translate("text", host_trust.UPPER, host_trust.LOWER).rlike(license_scan.CUE)
    name = F.when(notice & (F.col("doc_id") % 3 == 0), F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    deep = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/d"), (F.floor(F.col("doc_id") / 20) % 10).cast("string"))).otherwise("")
    return table(spark, sf, "documents").select(
        "doc_id", F.concat("source", deep, F.lit("/"), name).alias("path"), "text")


def _license_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(license_scan.TEMPLATES))
    low = LOWER_SQL.format
    file = r"regexp_matches({}, '(?:\A|/)(?:licen[sc]e|copying)[^/]*\z')".format(low("path"))
    best = "max(score) AS score, arg_min(license, {'a': -score, 'b': license}) AS license"
    return f"""
    WITH files AS (
      SELECT doc_id, text, source || CASE WHEN doc_id % 2 = 0 THEN '/d' || (doc_id // 20 % 10) ELSE '' END || '/' ||
        CASE WHEN regexp_matches({low("text")}, '{license_scan.CUE}') AND doc_id % 3 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path
      FROM documents),
    templates AS (SELECT * FROM (VALUES {rows}) t(template, license, text)),
    tt AS (SELECT template, license, term, count(*) AS n FROM (
      SELECT template, license, unnest(regexp_extract_all({low("text")}, '{license_scan.WORD}')) AS term FROM templates) GROUP BY 1, 2, 3),
    vocabulary AS (SELECT DISTINCT term FROM tt),
    total AS (SELECT count(*) AS n FROM files),
    df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (
      SELECT doc_id, unnest(list_distinct(regexp_extract_all({low("text")}, '{license_scan.WORD}'))) AS term FROM files)
      WHERE term IN (SELECT term FROM vocabulary) GROUP BY 1),
    rarity AS (SELECT term, ln((1 + (SELECT n FROM total)) / (1 + coalesce(df, 0))) + 1 AS r FROM vocabulary LEFT JOIN df USING (term)),
    tw AS (SELECT template, license, term, n * r / sqrt(sum(n * r * n * r) OVER (PARTITION BY template)) AS weight FROM tt JOIN rarity USING (term)),
    passages AS (
      SELECT doc_id, path, i, l[i] AS passage FROM (SELECT doc_id, path, string_split(text, chr(10)) AS l,
        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM files) WHERE regexp_matches({low("l[i]")}, '{license_scan.CUE}')
      UNION ALL SELECT doc_id, path, 0, text FROM files WHERE {file}),
    pt AS (SELECT doc_id, path, i, term, count(*) AS n FROM (
      SELECT doc_id, path, i, unnest(regexp_extract_all({low("passage")}, '{license_scan.WORD}')) AS term FROM passages) GROUP BY ALL),
    pw AS (SELECT doc_id, path, i, term, n * coalesce(r, ln(1 + (SELECT n FROM total)) + 1) AS w FROM pt LEFT JOIN rarity USING (term)),
    norms AS (SELECT doc_id, path, i, sqrt(sum(w * w)) AS norm FROM pw GROUP BY 1, 2, 3),
    scores AS (SELECT doc_id, path, license, round(sum(w * weight) / any_value(norm), 6) AS score
      FROM pw JOIN tw USING (term) JOIN norms USING (doc_id, path, i) GROUP BY doc_id, path, i, template, license),
    best AS (SELECT doc_id, path, {best} FROM scores WHERE score >= {license_scan.THRESHOLD} GROUP BY 1, 2),
    dirs AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, {best} FROM best WHERE {file} GROUP BY 1),
    placed AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS own FROM files),
    up AS (SELECT own, arg_max({{'dir': dir, 'license': license, 'score': score}}, length(dir)) AS u
      FROM (SELECT DISTINCT own FROM placed) JOIN dirs ON dir = own OR starts_with(own, dir || '/') GROUP BY 1)
    SELECT doc_id, path, coalesce(b.license, u.license) AS license, coalesce(b.score, u.score) AS score,
      CASE WHEN b.license IS NOT NULL THEN 'own' WHEN u IS NOT NULL THEN 'inherited' END AS origin,
      CASE WHEN b.license IS NULL THEN u.dir END AS from_dir
    FROM placed LEFT JOIN best b USING (doc_id, path) LEFT JOIN up USING (own)"""


@query("op6_license_scan", sql=_license_sql())
def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licences of all documents as files: own notices, else the nearest licence file above."""
    return license_scan.scan(repository_files(spark, sf))


@query("op4_induced_sort", sql="""
    WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    starts AS (SELECT doc_id, i, md5(t[i:i + 399]) AS h FROM (SELECT doc_id, t, unnest(range(1, n - 398)) AS i FROM b WHERE n >= 400)),
    again AS (SELECT h FROM starts GROUP BY 1 HAVING count(*) > 1),
    hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM starts WHERE h IN (SELECT h FROM again)),
    grouped AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hits),
    spans AS (SELECT doc_id, g, min(i) AS s, max(i) + 400 AS e FROM grouped GROUP BY 1, 2),
    lists AS (SELECT doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed,
      list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM spans GROUP BY 1)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(CASE WHEN ss IS NULL THEN t ELSE unhex(array_to_string(list_transform(range(0, len(ss) + 1),
        lambda k: hex(t[(CASE WHEN k = 0 THEN 1 ELSE es[k] END):(CASE WHEN k = len(ss) THEN n ELSE ss[k + 1] - 1 END)])), '')) END) AS kept_sha256
    FROM b LEFT JOIN lists USING (doc_id)""")
def op4_induced_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of all documents inside strings of 400 bytes that occur elsewhere too."""
    return substring_dedup.repeated_bytes(table(spark, sf, "documents")).drop("removed")


@query("op1_edit_fingerprints")
def op1_edit_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like they are."""
    return edit_fingerprints.fingerprints(table(spark, sf, "documents"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings on the four leading components of their distinct vectors, with unit deviations."""
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op12_threshold_search", sql="""
    WITH x AS (
      SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM (SELECT DISTINCT * FROM x WHERE vec_id % 100 = 0) q JOIN x c ON c.vec_id IS DISTINCT FROM q.vec_id),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op12_threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of all embeddings by inner product for every hundredth."""
    vectors = table(spark, sf, "embeddings")
    return threshold_search.threshold_topk(vectors.filter("vec_id % 100 = 0"), vectors)


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Turns dropped, emptied, stripped of sentence ends, repeated or given to the user by the checksum of their place."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.withColumn("_kind", kind).filter("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("_copy")).drop("_copy")


def _repair_sql() -> str:
    """A dynamic program over places and states that carries the least letters of each state along."""
    after, moves = {"": ("u", "U"), "S": ("u", "U"), "U": ("a", "A"), "A": ("u", "U")}, []
    final = {"": 0, "A": 0}
    tails = []
    for start in after:
        state, letters, lines, cost = start, "", "", 0
        for inserted in range(3):
            if inserted:
                who, state = after[state]
                letters, cost = letters + "I", cost + 2
                lines += ("user:" if who == "u" else "assistant:") + "\n"
            who, to = after[state]
            moves.append((start, letters + "D", cost + 3, lines, "", state, "drop"))
            moves.append((start, letters + "R", cost + 2, lines, "user" if who == "u" else "assistant", to, "rerole"))
            moves.append((start, letters + "K", cost, lines, who, to, "keep"))
            if state == "":
                moves.append((start, letters + "K", cost, lines, "s", "S", "keep"))
            if state in final:
                tails.append((start, letters, cost, lines))
    values = lambda rows: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
    text = r"[^\x20\x09-\x0D]"
    return rf"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS t),
    given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
    kinds AS (SELECT given.*, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: unicode(s[i])::BIGINT),
        lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM given, crc),
    damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds) WHERE kind <> 0),
    names AS (SELECT DISTINCT conv_id FROM conversations),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS pos,
        regexp_extract(text, '({text})[\x20\x09-\x0D]*\z', 1) AS final, substr(role, 1, 1) AS initial FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM placed),
    judged AS (SELECT *, final = '' AS blank, final <> '' AND again AS duplicate, final NOT IN ('', '.', '!', '?') AND NOT again AS truncated FROM seen),
    faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1),
    moves AS (SELECT * FROM (VALUES {values(moves)}) t(state, letters, price, lines, who, target, kind)),
    walk AS (
      SELECT conv_id, 0::BIGINT AS pos, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM names
      UNION ALL
      SELECT conv_id, pos, state, (best).cost, (best).audit, (best).lines FROM (
        SELECT w.conv_id, w.pos + 1 AS pos, m.target AS state, min({{'cost': w.cost + m.price + CASE WHEN j.truncated AND m.kind <> 'drop' THEN 1 ELSE 0 END,
            'audit': w.audit || m.letters, 'lines': w.lines || m.lines || CASE m.kind WHEN 'drop' THEN ''
              WHEN 'keep' THEN j.role || ':' || j.text || chr(10) ELSE m.who || ':' || j.text || chr(10) END}}) AS best
        FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1
        JOIN moves m ON m.state = w.state AND (m.kind = 'drop' OR NOT (j.blank OR j.duplicate)) AND (m.kind <> 'keep' OR m.who = j.initial)
        GROUP BY 1, 2, 3)),
    ended AS (
      SELECT w.conv_id, arg_max(best, w.pos) AS best FROM (
        SELECT w.conv_id, w.pos, min({{'cost': w.cost + t.price, 'audit': w.audit || t.letters, 'lines': w.lines || t.lines}}) AS best
        FROM walk w JOIN (VALUES {values(tails)}) t(state, letters, price, lines) ON t.state = w.state GROUP BY 1, 2) w GROUP BY 1)
    SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, (best).cost AS cost, (best).audit AS audit,
      sha256(CASE WHEN (best).lines = '' THEN '' ELSE left((best).lines, length((best).lines) - 1) END) AS repaired_sha256
    FROM names n LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM n.conv_id JOIN ended e ON e.conv_id IS NOT DISTINCT FROM n.conv_id"""


@query("op13_turn_repair", sql=_repair_sql())
def op13_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of all conversations after damage."""
    given = table(spark, sf, "conversations")
    faults, repaired = turn_repair.repair(damaged_turns(given))
    named = lambda df: df.withColumn("_c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    found = named(given.select("conv_id").distinct()).join(named(faults).drop("conv_id"), "_c", "left").join(
        named(turn_repair.digests(repaired)).drop("conv_id"), "_c", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

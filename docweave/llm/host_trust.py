"""URL filtering by rules and by trust along host links, in DataFrame functions only.

Rules decide the pages that they fit. The hosts of allowed pages are seeds of trust, those of
blocked pages seeds of distrust, each weighted by its pages. Trust flows along links to the
hosts linked to; distrust flows backwards, to those that link to a distrusted host. Both are personalised
PageRank: a host passes on ``DAMPING`` of what it has, in proportion to its links, and seeds
get the rest anew. A host without links keeps its share. Pages that no rule fits get the
verdict of their host: block if it has gathered more distrust than trust, else allow.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.tables import written

DAMPING = 0.85
ROUNDS = 10
#: Rounds between two writes that cut the plan.
CUT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and protocol-relative link targets; the group is the host.
LINK = r"""href\s{0,9}=\s{0,9}["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/"'?#\s<>]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _judged(pages: DataFrame, key: str, url: str, rules: list[Rule]) -> DataFrame:
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the longest rule is asked first; of equal ones, block
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "block", r.host)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return rows.withColumn("_found", found).select(key, "host", "path", "_found.rule", "_found.verdict")


def host_links(pages: DataFrame, url: str = "url", html: str = "html", domains: bool = True) -> DataFrame:
    """``(source, target, links)`` between different hosts.

    Links of the pages count each; with ``domains``, each host also links once to the domain above
    it and back (down to two labels), as sites vouch for their parts.
    """
    host, _ = url_parts(F.col(url))
    targets = F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))
    edges = pages.select(host.alias("source"), targets.alias("target")).select(
        "source", F.translate("target", UPPER, LOWER).alias("target")).groupBy("source", "target").agg(F.count("*").alias("links"))
    if domains:
        hosts = pages.select(host.alias("host")).distinct().unionByName(edges.select(F.col("target").alias("host"))).distinct()
        label = F.split("host", r"\.")
        n = F.size(label)
        # each host with every domain above it, then neighbours along that chain
        chain = hosts.filter(n > 2).select(F.explode(F.transform(
            F.sequence(F.lit(1), n - 2), lambda i: F.struct(
                F.array_join(F.slice(label, i, n), ".").alias("low"), F.array_join(F.slice(label, i + 1, n), ".").alias("high")))).alias("e")
        ).select("e.low", "e.high").distinct()
        edges = edges.unionByName(chain.select(F.col("low").alias("source"), F.col("high").alias("target"), F.lit(1).cast("bigint").alias("links"))) \
            .unionByName(chain.select(F.col("high").alias("source"), F.col("low").alias("target"), F.lit(1).cast("bigint").alias("links")))
    return edges.filter("source <> '' and target <> '' and source <> target").groupBy("source", "target").agg(F.sum("links").alias("links"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(host, trust, distrust)`` from ``seeds(host, trust, distrust)`` along ``links(source, target, links)``."""
    both = links.select(F.lit("trust").alias("kind"), "source", "target", "links").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "links"))
    out = both.groupBy("kind", "source").agg(F.sum("links").alias("out"))
    edges = written(both.join(out, ["kind", "source"]).select(
        "kind", F.col("source").alias("host"), "target", (damping * F.col("links") / F.col("out")).alias("share")))
    start = written(seeds.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("trust").cast("double").alias("x")),
        F.struct(F.lit("distrust").alias("kind"), F.col("distrust").cast("double").alias("x")))).alias("e"))
        .select("e.kind", "host", "e.x").filter("x > 0"))
    now = start
    fresh = start.select("kind", "host", ((1 - damping) * F.col("x")).alias("x"))
    for step in range(1, rounds + 1):
        moved = now.join(edges, ["kind", "host"], "left").select(
            "kind", F.coalesce("target", "host").alias("host"), (F.col("x") * F.coalesce("share", F.lit(damping))).alias("x"))
        now = moved.unionByName(fresh).groupBy("kind", "host").agg(F.sum("x").alias("x"))
        if step % CUT == 0:
            now = written(now)
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("x"))), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(score("trust"), score("distrust"))


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html",
          domains: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """``(key, host, path, rule, verdict, trust, distrust)`` for every row of ``pages``.

    ``rules`` is a list in the program; one fits its host and all subdomains if the path starts
    with the rule's, and the longest fitting one wins. A null URL, or one without ``://``, has an empty
    host and path; the empty host neither links nor is linked to. Without seeds or links everything that no rule
    blocks is allowed. Repeated pages are judged each and weigh each. Extra columns are not returned.
    """
    judged = _judged(pages, key, url, rules)
    seeds = judged.filter("rule is not null and host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("trust"), F.count(F.when(F.col("verdict") == "block", 1)).alias("distrust"))
    scores = propagate(seeds, host_links(pages, url, html, domains), rounds)
    own = F.when(F.round(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)), 9) > 0, "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        key, "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

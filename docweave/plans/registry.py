"""Registry of runnable queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.functions import text as tx

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        assert name not in QUERIES, name
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


# SQL fragments used by the oracles.

def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{tx.TOKEN}')"


def s_words(x: str) -> str:
    return f"regexp_extract_all({x}, '{tx.NOT_SPACE}+')"


def s_count(x: str) -> str:
    return f"len({s_words(x)})"


def s_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{tx.SPACE}+|{tx.SPACE}+\z', '', 'g')"


def s_squeeze(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '{tx.SPACE}+', ' ', 'g')")


def s_no_punct(x: str) -> str:
    return f"regexp_replace({x}, '[^{tx.WORD_SET}{tx.SPACE_SET}]', '', 'g')"


def s_any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(n)})" for n in needles) + ")"


def s_starts(x: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {quoted(p)})" for p in prefixes) + ")"


def s_match(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(tx.portable(p))})" for p in patterns) + ")"


def s_list(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def s_token_estimate(x: str) -> str:
    return (
        f"(floor({s_count(x)} + 0.5 * len(regexp_extract_all({x}, {quoted(tx.TOKEN_PUNCTUATION)}))"
        f" + length(regexp_replace({x}, '{tx.SPACE}+', '', 'g')) / 4.0 * 0.2)::BIGINT + 1)"
    )

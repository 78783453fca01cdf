"""Text columns: tokens, words, trimming and regexes that mean the same on every engine.

Java's ``\\w`` is ASCII, RE2's ``\\b`` is ASCII, ``trim`` only strips blanks. All
patterns are therefore written with explicit Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_SET = r"\x09-\x0d\x1c-\x1f\x{85}\p{Z}"
WORD_SET = r"\p{L}\p{N}_"
SPACE = f"[{SPACE_SET}]"
NOT_SPACE = f"[^{SPACE_SET}]"
WORD = f"[{WORD_SET}]"
TOKEN = WORD + "+"

_OUTSIDE = {"s": SPACE, "S": NOT_SPACE, "w": WORD, "W": f"[^{WORD_SET}]", "d": r"\p{Nd}"}
_INSIDE = {"s": SPACE_SET, "w": WORD_SET, "d": r"\p{Nd}"}


def portable(pattern: str) -> str:
    """Spell out ``\\s \\w \\d \\b . $`` so that a yes/no search agrees on Java and RE2.

    A word boundary becomes a consumed neighbour, which is enough for matching
    but not for extraction or replacement.
    """
    out, i, in_set = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            i += 2
            if e == "b":
                opens = i < len(pattern) and (pattern[i].isalnum() or pattern[i] in "(\\")
                out.append(f"(?:^|[^{WORD_SET}])" if opens else f"(?:$|[^{WORD_SET}])")
            else:
                out.append((_INSIDE if in_set else _OUTSIDE).get(e, "\\" + e))
            continue
        if in_set:
            in_set = c != "]"
            out.append(c)
        elif c == "[":
            in_set = True
            out.append(c)
        elif c == ".":
            out.append(r"[^\n]")
        elif c == "$":
            out.append(r"\n?\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def any_of(patterns: list[str]) -> str:
    """One alternation for a list of patterns: a single regex pass per row."""
    return "|".join(f"(?:{portable(p)})" for p in patterns)


def tokens(text: Column) -> Column:
    """Lower-cased runs of word characters, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Whitespace-separated pieces."""
    return F.regexp_extract_all(text, F.lit(NOT_SPACE + "+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACE + "+"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def squeeze(text: Column) -> Column:
    """Whitespace runs to one blank, ends stripped."""
    return strip(F.regexp_replace(text, SPACE + "+", " "))


def drop_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{WORD_SET}{SPACE_SET}]", "")


def contains_any(text: Column, needles: list[str]) -> Column:
    """Plain substring test for any of a fixed list."""
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(text, F.lit(n))
    return cond


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.startswith(text, F.lit(p))
    return cond


def query_key(text: Column) -> Column:
    """Stable key of a query: case and whitespace do not matter."""
    return F.md5(squeeze(F.lower(text)))


def slug(heading: Column) -> Column:
    kept = F.regexp_replace(heading, rf"[^{WORD_SET}{SPACE_SET}\-]", "")
    return F.regexp_replace(F.lower(strip(kept)), rf"[\-{SPACE_SET}]+", "-")


# Characters that count as half a token each.
TOKEN_PUNCTUATION = r"""[.,;:!?()\[\]{}\-+*/='"]"""


def token_estimate(text: Column) -> Column:
    """Token count estimate: words, half a token per punctuation sign, 1/20 per character."""
    est = (
        word_count(text)
        + F.regexp_count(text, F.lit(TOKEN_PUNCTUATION)) * F.lit(0.5)
        + F.length(F.regexp_replace(text, SPACE + "+", "")) / F.lit(4.0) * F.lit(0.2)
    )
    return F.floor(est).cast("bigint") + 1


def truncate_to_tokens(text: Column, max_tokens: int) -> Column:
    """Cut by the four-characters-per-token rule, marking the cut."""
    limit = 4 * max_tokens
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    )

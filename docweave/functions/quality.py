"""Quality of a response to a query, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import text as tx


def term_set(text: Column) -> Column:
    return F.array_distinct(tx.words(tx.drop_punctuation(F.lower(text))))


def relevance(query: Column, response: Column) -> Column:
    """Share of query terms found in the response, scaled by 1.5 and by length."""
    q = term_set(query)
    n = tx.word_count(response)
    factor = F.when(n < 5, 0.5).when(n > 500, 0.8).otherwise(1.0)
    overlap = F.size(F.array_intersect(q, term_set(response))) / F.size(q)
    return F.when(F.size(q) == 0, 0.5).otherwise(F.least(F.lit(1.0), overlap * factor * 1.5))


# Phrases that claim certainty, and long words that carry no claim.
CERTAINTY = [
    "I am certain that",
    "It is definitely",
    "The document explicitly states",
    "The exact date is",
    "The precise number is",
    "The author specifically mentioned",
]
EMPTY_WORDS = ["about", "these", "those", "their"]


def unsupported_claim(response: Column, context: Column) -> Column:
    """A sentence claiming certainty of whose key terms under half occur in the context."""
    low, ctx = F.lower(response), F.lower(F.coalesce(context, F.lit("")))
    claims = F.flatten(F.array(*[
        F.regexp_extract_all(low, F.lit(c.lower() + "[^.!?]*[.!?]"), F.lit(0)) for c in CERTAINTY
    ]))

    def unsupported(claim: Column) -> Column:
        terms = F.filter(tx.words(tx.drop_punctuation(claim)),
                         lambda t: (F.length(t) > 4) & ~t.isin(EMPTY_WORDS))
        found = F.size(F.filter(terms, lambda t: F.contains(ctx, t)))
        return (F.size(terms) > 0) & (found * 2 < F.size(terms))

    return F.exists(claims, unsupported)


BULLET = rf"[\n\r]{tx.SPACE}*([-*•])"
FENCE = "```"
CLOSED_FENCE = rf"```{tx.SPACE}*\z|```{tx.SPACE}*[\n\r]"


def formatting_issues(response: Column) -> Column:
    """Issues of a response in a fixed order."""
    bullets = F.regexp_count(response, F.lit(BULLET))
    styles = F.size(F.array_distinct(F.regexp_extract_all(response, F.lit(BULLET), F.lit(1))))
    fences = F.regexp_count(response, F.lit(FENCE))
    closed = F.regexp_count(response, F.lit(CLOSED_FENCE))
    open_end = response.rlike(tx.portable(r"[a-zA-Z],\s*$")) | F.endswith(response, F.lit("..."))
    long_paragraphs = F.transform(
        F.split(response, r"[\n\r]{2,}"),
        lambda p, i: F.when(
            tx.word_count(p) > 150,
            F.concat(F.lit("Paragraph "), (i + 1).cast("string"), F.lit(" is excessively long ("),
                     tx.word_count(p).cast("string"), F.lit(" words)")),
        ),
    )
    single = F.array(
        F.when(open_end, F.lit("Response ends with incomplete sentence")),
        F.when(bullets > 10, F.concat(F.lit("Excessive use of bullet points ("),
                                      bullets.cast("string"), F.lit(" found)"))),
        F.when(styles > 1, F.lit("Inconsistent bullet point styles")),
        F.when(fences != closed, F.lit("Mismatched code block formatting")),
    )
    return F.array_compact(F.concat(single, long_paragraphs))


def length_fits(query: Column, response: Column, model_size: str) -> Column:
    q, r = tx.word_count(query), tx.word_count(response)
    limit = F.when(q < 15, 200).when(q < 30, 400).otherwise(800 if model_size == "small" else 600)
    return (r >= 5) & (r <= limit)


# Question openings, answer openings and dates.
QUESTION_WORDS = [
    "what", "when", "where", "who", "why", "how", "can", "could", "would", "should", "is", "are", "do", "does",
]
TOPIC_REQUESTS = ["tell me about", "explain", "describe"]
ANSWER_PATTERNS = [
    r"^\s*yes\b",
    r"^\s*no\b",
    r"\bthe answer is\b",
    r"\bto answer your question\b",
    r"^\s*it is\b",
    r"^\s*they are\b",
    r"^\s*there are\b",
    r"\bwas created\b",
    r"\bwas developed\b",
    r"\bwas founded\b",
    r"\bwas established\b",
    r"\bin \d{4}\b",
]
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
DATE_PATTERNS = [
    r"\b\d{4}\b",
    rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\b",
    rf"\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?\b",
]


def question_answered(query: Column, response: Column) -> Column:
    q, r, n = F.lower(query), F.lower(response), tx.word_count(response)
    bare = F.regexp_replace(q, "|".join(TOPIC_REQUESTS), "")
    subject = F.regexp_replace(tx.strip(bare), r"\A\.+|\.+\z", "")
    names_subject = (
        tx.starts_with_any(q, TOPIC_REQUESTS) & (F.length(subject) > 0) & F.contains(r, subject)
    )
    asks = F.contains(query, F.lit("?"))
    is_question = tx.starts_with_any(q, QUESTION_WORDS) | asks
    nouns = F.filter(tx.words(tx.drop_punctuation(q)),
                     lambda w: (F.length(w) > 3) & ~w.isin(QUESTION_WORDS))
    present = F.size(F.filter(nouns, lambda w: F.contains(r, w)))
    about_time = tx.contains_any(q, ["when", "date", "year"])
    return (
        F.when(names_subject, True)
        .when(~is_question, n >= 10)
        .when((F.size(nouns) > 0) & (present * 2 >= F.size(nouns)), True)
        .when(asks & r.rlike(tx.any_of(ANSWER_PATTERNS)), True)
        .when(about_time & r.rlike(tx.any_of(DATE_PATTERNS)), True)
        .otherwise(n >= 20)
    )


def overall_quality(rel: Column, unsupported: Column, n_issues: Column, fits: Column, answered: Column) -> Column:
    score = (
        rel * 0.4
        + F.when(unsupported, -0.3).otherwise(0.3)
        + (1 - F.least(F.lit(1.0), n_issues / 5)) * 0.1
        + F.when(fits, 0.1).otherwise(0.0)
        + F.when(answered, 0.1).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def regenerate_reason(unsupported: Column, overall: Column, answered: Column, issues: Column) -> Column:
    """First reason to generate again, empty if there is none."""
    return (
        F.when(unsupported, "Potential hallucination detected")
        .when(overall < 0.5, F.concat(F.lit("Low quality score ("), F.format_number(overall, 2), F.lit(")")))
        .when(~answered, "Question not directly answered")
        .when(F.size(issues) >= 3, F.concat(F.lit("Multiple formatting issues: "),
                                            F.array_join(F.slice(issues, 1, 3), ", ")))
        .otherwise("")
    )


def evaluate(df, model_size: str = "large"):
    """All measures for ``df(query, response, context, ...)``."""
    q, r = F.col("query"), F.col("response")
    return (
        df.withColumn("relevance", relevance(q, r))
        .withColumn("unsupported", unsupported_claim(r, F.col("context")))
        .withColumn("issues", formatting_issues(r))
        .withColumn("length_ok", length_fits(q, r, model_size))
        .withColumn("answered", question_answered(q, r))
        .withColumn("overall", overall_quality(
            F.col("relevance"), F.col("unsupported"), F.size("issues"), F.col("length_ok"), F.col("answered")))
        .withColumn("reason", regenerate_reason(
            F.col("unsupported"), F.col("overall"), F.col("answered"), F.col("issues")))
        .withColumn("regenerate", F.col("reason") != "")
    )

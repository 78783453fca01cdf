import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank, repeated, tied and very long texts, and clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    base = " ".join(f"token{i}" for i in range(120))
    rows = [
        (1, base), (2, base), (3, base.replace("token7 ", "other ")), (4, None), (5, ""), (6, " \n\t "), (7, "One"),
        (8, "one two"), (9, long), (10, long + " tail"), (11, "Ünï cödé 日本 😀\r\nsecond line ▁x"), (12, "A " * 500),
        (12, "A " * 500), (None, base), (14, "x" * 100_000), (15, "12 34 2024-01-02"),
    ]
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 0, "kept") for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, component_id string")

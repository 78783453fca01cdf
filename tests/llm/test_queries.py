"""Registered queries against their SQL, and the entry's contract."""

import pytest
from oracle import DATA, compare

from docweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    why, *_ = compare(spark, duck, name, QUERIES[name], ORACLES[name], f"{DATA}/sf0.001")
    assert not why, why


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names} and "pipeline" in names

"""Every registered query against its SQL on the smallest data."""

import pytest
from oracle import DATA, compare

from docweave.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    why, *_ = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), f"{DATA}/sf0.001")
    assert not why, why


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score", "rel_score"]

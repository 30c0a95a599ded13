"""Every query against its SQL on the smallest tables."""

import pytest
from helpers import oracle_rows, spark_rows

from glyphlake.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    want_names, want = oracle_rows(ORACLES[name], sf)
    assert names == want_names
    assert rows == want


def test_listing_covers_all_operations(spark, sf):
    found = QUERIES["content_ops_listing"](spark, sf)
    n = sum(r["n"] for r in QUERIES["content_operators"](spark, sf).collect())
    assert found.count() == n
    assert found.where("description = '(unknown operator)'").count() == 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert {"doc_id", "page", "text"} == set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())

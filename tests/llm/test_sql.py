"""Registered queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from conftest import SMALL
from oracle_compare import compare
from quire.llm.oracle import SQL


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, duck_small, key):
    r = compare(spark, key, SMALL, duck_small)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r

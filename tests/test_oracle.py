"""Every registered query against its DuckDB oracle on the smallest tables."""

import re

import pytest

import __spark_entry__ as E
from conftest import SMALL
from oracle_compare import compare

KEYS = sorted(k for k in E.queries() if k != "pipeline" and not re.match(r"op\d+_", k))
SQL_KEYS = [k for k in KEYS if k in E.oracle_sql()]
ROWS_ONLY = [k for k in KEYS if k not in E.oracle_sql()]


def test_every_query_has_sql_or_is_declared_rows_only():
    # the training-data queries are tested by brute force in tests/llm
    assert all(k == "pipeline" or re.match(r"op\d+_", k) for k in ROWS_ONLY)


@pytest.mark.parametrize("key", SQL_KEYS)
def test_query_matches_oracle(spark, duck_small, key):
    r = compare(spark, key, SMALL, duck_small)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    first = df.schema
    assert df.count() >= 0
    assert E.entry(spark).schema == first

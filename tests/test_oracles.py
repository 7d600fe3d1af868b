"""Every registered query with a SQL twin must equal DuckDB (sf0.001)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import compare, duck

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_is_registered_with_sql_or_is_rows_only():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 120


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], SQL[name], SF_SMALL, con)
    if not r["ok"]:
        pytest.fail(str(r))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 12
    assert set(df.columns) >= {"keep_ratio", "recovery_ratio", "accuracy", "token_reduction_pct"}

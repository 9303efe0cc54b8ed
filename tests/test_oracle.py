"""Every query with a SQL twin gives the same rows, names and types on DuckDB."""

import pytest

import __spark_entry__ as entry
import check_oracle as oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], sf) is None


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["attack_type", "n", "high", "medium", "low", "percentage"]
    assert df.count() == 8

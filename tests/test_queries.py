"""Every registered query with SQL gives the same values as DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as registered
from compare import connect, difference

ORACLES = registered.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert difference(registered.queries()[name](spark, sf_dir), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registered.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert registered.entry(spark).columns == ["label", "n"]

"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import difference, oracle_connection

ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = entry_points.queries()[name](spark, sf_dir)
    assert difference(df, con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert entry_points.queries()[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0

"""Every core query with SQL against DuckDB on the smallest tables."""

import pytest

from oracle import same
from stockpot.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    same(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_distinct_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.count()
    assert rows == df.distinct().count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

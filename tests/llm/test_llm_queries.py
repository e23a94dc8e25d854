import pytest

from oracle import same
from stockpot.llm import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()
#: The smallest tables need not hold a row of these.
MAYBE_NONE = {"p2_words"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    same(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_distinct_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.count()
    assert rows == df.distinct().count() and (rows > 0 or name in MAYBE_NONE)

import pytest
from compare import DATA, assert_same

from pagewright.queries.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, DATA), ORACLES[name])


#: The smallest tables have no page with a column of keys.
NO_ROWS = {"q_tabular_keys"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).limit(1).count() == (name not in NO_ROWS)


def test_entry_points():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())

"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect
from tests.conftest import SF_DIR

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_no_sql_without_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_is_the_flagship(spark):
    assert contract.entry(spark).columns == ["res", "basin_id", "severity", "model_count", "models", "agree"]

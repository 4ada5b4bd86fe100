"""Every registered query with SQL equals DuckDB on the smallest tables."""

import pytest

from aetherlog.plans.catalog import ORACLE, QUERIES
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, _, message = compare(spark, QUERIES[name], ORACLE.get(name), FOLDER, con)
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(QUERIES) <= e.queries().keys() and set(ORACLE) <= e.oracle_sql().keys() <= e.queries().keys()

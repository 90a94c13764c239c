"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import differences, duck

PATH = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(PATH)


def test_entry(spark):
    top = entry.entry(spark)
    assert set(top.columns) == {"label", "term", "weight", "rank"} and top.count() > 0


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, connection, name):
    assert differences(QUERIES[name](spark, PATH), SQL[name], connection) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, PATH).count() > 0

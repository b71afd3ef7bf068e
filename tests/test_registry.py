"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_point
from compare import connection, spark_rows, sql_rows
from registry.queries import QUERIES_BY_NAME

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES_BY_NAME.keys() <= entry_point.queries().keys()
    assert QUERIES_BY_NAME.keys() <= entry_point.oracle_sql().keys()


@pytest.mark.parametrize("name", list(QUERIES_BY_NAME))
def test_query(spark, con, name):
    assert spark_rows(entry_point.queries()[name](spark, SF_DIR)) == sql_rows(con, entry_point.oracle_sql()[name])


def test_entry(spark):
    ranking = entry_point.entry(spark)
    assert ranking.columns == ["query_id", "rank", "doc_id", "score"] and ranking.count() == 80

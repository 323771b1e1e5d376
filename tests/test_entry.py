"""Every registered query against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.duckdb_sql import SQL
from checks.spark_queries import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert all_queries().keys() == SQL.keys()
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name) == ""

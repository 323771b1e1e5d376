"""Queries against their SQL."""

import pytest

import __spark_entry__ as entry
from checks import compare
from logtally.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "all_queries", lambda: queries.QUERIES)
    monkeypatch.setattr(compare, "SQL", queries.SQL)
    assert compare.compare(spark, compare.connect(SF), SF, name) == ""


def test_registered():
    assert {"pipeline", *queries.QUERIES} <= entry.queries().keys()
    assert queries.SQL.keys() <= entry.oracle_sql().keys()

"""Registered queries against their SQL at the smallest scale; those of the optional folder have tests beside them."""

import pytest

import __spark_entry__ as entry
from gaugechecks.compare import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op") and n != "pipeline"])
def test_query(spark, sf, con, name):
    ok, note = compare(spark, con, sf, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 8

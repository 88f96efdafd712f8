"""Duplicate counts of nested rows against Spark's own distinct, and of odd values one by one."""
import datetime
import decimal
import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from sparkgauge.operators import duplicates

WHEN = datetime.datetime(2020, 2, 29, 23, 59, 59, 999_999)


def count(spark, values, schema):
    return duplicates.duplicate_count(spark.createDataFrame([(v,) for v in values], f"v {schema}").repartition(2)).first()["duplicate_count"]


@pytest.mark.parametrize("schema, values, repeated", [
    ("struct<t: timestamp>", [(WHEN,), (WHEN - datetime.timedelta(microseconds=1),), (WHEN,)], 1),
    ("array<double>", [[0.0], [-0.0], [float("nan")], [float("nan")], [None], []], 2),
    ("array<int>", [[1, None], [None, 1], [1], [], None, None], 1),
    ("array<array<int>>", [[[1], [2]], [[1, 2]], [[], [1, 2]], [[1, 2], []]], 0),
    ("struct<a: string, b: string>", [("x", None), (None, "x"), None, (None, None), ("x", None)], 1),
    ("map<string, double>", [{"a": 0.0, "b": None}, {"b": None, "a": -0.0}, {"a": 0.0}, {}, None], 1),
    ("array<map<string, int>>", [[{"a": 1}, {"b": 2}], [{"b": 2}, {"a": 1}], [{"a": 1}, {"b": 2}]], 1),
    ("decimal(30, 10)", [decimal.Decimal("1.0000000001"), decimal.Decimal("1.00000000010"), decimal.Decimal("1"), None], 1),
    ("float", [0.0, -0.0, float("nan"), float("nan"), None], 2),
    ("binary", [b"", b"\x00", None, b"\x00"], 1),
])
def test_values_one_by_one(spark, schema, values, repeated):
    assert count(spark, values, schema) == repeated


small = st.sampled_from
double = small([None, 0.0, -0.0, float("nan"), 1.5])
row = st.tuples(
    st.none() | st.tuples(small([None, WHEN, WHEN.replace(microsecond=1)]), st.none() | st.lists(double, max_size=2)),
    small([None, decimal.Decimal("0.000001"), decimal.Decimal("0")]), small([None, "", "x"]),
    st.none() | st.lists(st.none() | st.tuples(small([None, "x"]), st.none() | st.lists(small([None, 1, 2]), max_size=2)), max_size=2),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=40))
def test_agrees_with_distinct(spark, rows):
    df = spark.createDataFrame(rows, "a struct<t: timestamp, n: array<double>>, d decimal(20, 6), s string, x array<struct<p: string, q: array<int>>>")
    got = duplicates.duplicate_count(df).first()
    assert got["duplicate_count"] == len(rows) - df.distinct().count() == len(rows) - duplicates.drop_duplicates(df).count()
    assert not math.isnan(got["duplicate_share"])

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import quantiles as q

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def check(df, columns, pdf):
    got = q.quantile_values(df, PROBS, columns)
    for c in columns:
        want = np.quantile(pdf[c].dropna().to_numpy(dtype=float), PROBS)
        np.testing.assert_allclose(got[c], want, rtol=1e-12)


def test_against_numpy(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    columns = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]
    check(df, columns, df.select(*columns).toPandas())


@pytest.mark.parametrize("limit", [1, 50])
def test_small_gap_limit_recurses_to_the_same_answer(spark, sf, monkeypatch, limit):
    monkeypatch.setattr(q, "GAP_LIMIT", limit)
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    columns = ["l_quantity", "l_extendedprice"]
    check(df, columns, df.select(*columns).toPandas())


def test_one_value_filling_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(q, "GAP_LIMIT", 100)
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7.5)).otherwise(F.sqrt("id")).alias("x"))
    check(df, ["x"], df.toPandas())


def test_nulls_nan_and_tiny_columns(spark):
    rows = [(1.0, None, 3.0), (float("nan"), None, 3.0), (4.0, None, 3.0), (None, None, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = q.quantile_values(df, (0.25, 0.5))
    assert got["a"] == [1.75, 2.5]
    assert got["c"] == [3.0, 3.0]
    assert "b" not in got


def test_infinite_values_keep_their_place(spark):
    values = [float("-inf"), 1.0, 2.0, 3.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert q.quantile_values(df, (0.0, 0.25, 0.5, 0.75, 1.0))["x"] == values


def test_sketch_mode_is_close(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    exact = q.percentiles(df, ["l_extendedprice"]).first()
    rough = q.percentiles(df, ["l_extendedprice"], exact=False).first()
    assert abs(exact["p50"] - rough["p50"]) < 0.05 * exact["p50"]


def test_ranks_of_larger_tables_take_two_scans(spark, monkeypatch):
    """With more values than gaps used to hold, ranks are still read by the second scan, from whole Arrow batches."""
    monkeypatch.setattr(q, "_order_statistics", lambda *_: pytest.fail("more than two scans"))
    df = spark.range(6_000_000).select(F.when(F.col("id") % 7 > 0, F.xxhash64("id") % 1_000_003).alias("a"), (F.col("id") % 10).cast("double").alias("b"))
    probabilities = (0.05, 0.25, 0.5, 0.75, 0.95)
    got, pdf = q.quantile_values(df, probabilities), df.toPandas()
    for c in ("a", "b"):
        np.testing.assert_allclose(got[c], np.quantile(pdf[c].dropna().to_numpy(dtype=float), probabilities), rtol=1e-12)

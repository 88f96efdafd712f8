import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import cleaning
from sparkgauge.streaming.stateless import clean_stream


def values(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(0, 1.0, "b", 4), (1, None, "a", None), (2, 3.0, None, 4), (3, 8.0, "b", 7), (4, float("nan"), "a", 7)]
    return spark.createDataFrame(rows, "id int, x double, s string, k int")


@pytest.mark.parametrize("strategy, filled", [("mean", 4.0), ("median", 3.0), ("mode", 1.0), ("value", -1.0)])
def test_impute_number(gaps, strategy, filled):
    out = cleaning.impute(gaps, "x", strategy, -1.0)
    assert values(out, "x") == [1.0, filled, 3.0, 8.0, filled]


def test_impute_text_mode_tie_and_unknown_strategy(gaps):
    assert values(cleaning.impute(gaps, "s", "mode"), "s") == ["b", "a", "a", "b", "a"]
    assert values(cleaning.impute(gaps, "s", "nothing"), "s")[2] is None
    assert values(cleaning.impute(gaps, "s", "median"), "s")[2] is None
    assert values(cleaning.impute(gaps, "k", "mode"), "k") == [4, 4, 4, 7, 7]


def test_default_strategy_is_median(gaps):
    out = cleaning.apply_operations(gaps, [{"type": "impute_missing", "column": "x"}])
    assert values(out, "x")[1] == 3.0


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([1, 2, 3, 4, 100, None])], "id int, x double")
    assert values(cleaning.clip_outliers(df, "x"), "x") == [1.0, 2.0, 3.0, 4.0, 7.0, None]


def test_casts(spark):
    texts = ["1", " 2.5 ", "1e3", "1d", "0x10", "abc", "", None, "-.5", "inf", "NaN", "1_000"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    assert values(cleaning.cast_types(df, "s", "numeric"), "s") == [1.0, 2.5, 1000.0, None, None, None, None, None, -0.5, float("inf"), None, None]
    dates = ["2024-01-05", "2024-1-5 10:30", "01/02/2024", "2024/03/04", "5-Jan-2024", "2024", "15", "n/a", "2024-13-40", None]
    df = spark.createDataFrame(list(enumerate(dates)), "id int, s string")
    got = [v.date() if v else None for v in values(cleaning.cast_types(df, "s", "datetime"), "s")]
    day = dt.date
    assert got == [day(2024, 1, 5), day(2024, 1, 5), day(2024, 1, 2), day(2024, 3, 4), day(2024, 1, 5), None, None, None, None, None]
    assert values(cleaning.cast_types(df.select("id"), "id", "categorical"), "id") == [str(i) for i in range(10)]


def test_order_of_operations_matters(spark):
    rows = [(0, 1.0), (0, 1.0), (0, 1.0), (1, 5.0), (2, 9.0), (3, None)]
    df = spark.createDataFrame(rows, "id int, x double")
    fill, dedup = {"type": "impute_missing", "column": "x", "strategy": "median"}, {"type": "drop_duplicates"}
    assert values(cleaning.apply_operations(df, [dedup, fill]), "x") == [1.0, 5.0, 9.0, 5.0]
    assert values(cleaning.apply_operations(df, [fill, dedup]), "x") == [1.0, 5.0, 9.0, 1.0]


def test_second_step_on_a_column_sees_the_first(spark):
    df = spark.createDataFrame([(0, "1"), (1, "3"), (2, "x"), (3, "8")], "id int, s string")
    ops = [{"type": "cast_types", "column": "s", "target_type": "numeric"}, {"type": "impute_missing", "column": "s", "strategy": "mean"}]
    assert values(cleaning.apply_operations(df, ops), "s") == [1.0, 3.0, 4.0, 8.0]


def test_missing_columns_are_skipped(gaps):
    ops = [{"type": "drop_columns", "column": "nope", "columns": ["s", "gone"]}, {"type": "handle_outliers", "column": "nope"}, {"type": "other"}]
    assert cleaning.apply_operations(gaps, ops).columns == ["id", "x", "k"]


def test_dedup_and_fixed_clip_are_idempotent(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("id"))
    once = cleaning.drop_duplicates(df)
    assert once.count() == cleaning.drop_duplicates(once).count() == 10
    clipped = df.select(cleaning.clip(F.col("id"), 2.0, 7.0).alias("v"))
    assert clipped.exceptAll(clipped.select(cleaning.clip(F.col("v"), 2.0, 7.0).alias("v"))).count() == 0


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0)], "id int, `a.b c` double")
    assert values(cleaning.impute(df, "a.b c", "median"), "a.b c") == [2.0, 2.0]


def test_stream_takes_stateless_steps_only(spark, tmp_path):
    spark.createDataFrame([(0, "1", None), (1, "x", 2.0)], "id int, s string, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, s string, x double").parquet(str(tmp_path / "in"))
    ops = [{"type": "cast_types", "column": "s", "target_type": "numeric"}, {"type": "impute_missing", "column": "x", "strategy": "value", "fill_value": 0.0}]
    query = clean_stream(stream, ops).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("cleaned").orderBy("id").collect()] == [(0, 1.0, 0.0), (1, None, 2.0)]
    with pytest.raises(ValueError):
        clean_stream(stream, [{"type": "drop_duplicates"}])


def test_mode_fill_keeps_type_and_value(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, bytearray(b"ab"), [1, 2]), (big, bytearray(b"ab"), [1, 2]), (None, None, None)], "b bigint, x binary, a array<int>")
    for name, want in (("b", big), ("x", bytearray(b"ab")), ("a", [1, 2])):
        out = cleaning.impute(df, name, "mode")
        assert out.schema[name].dataType == df.schema[name].dataType and all(r[name] == want for r in out.collect())


def test_large_ids_keep_every_digit(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big + i,) for i in range(20)] + [(None,), (0,)], "v bigint")
    clipped = {r["v"] for r in cleaning.clip_outliers(df, "v").collect()}
    assert {big + i for i in range(20)} <= {int(v) for v in clipped if v is not None}
    filled = {int(r["v"]) for r in cleaning.impute(df, "v", "median").collect()}
    assert {big + i for i in range(20)} <= filled

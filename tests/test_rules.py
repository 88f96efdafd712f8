"""Rule fixtures: one small table per rule, at and beside each threshold."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import charts, counts, duplicates, frequencies
from sparkgauge.plans import findings, reliability, report, validation
from sparkgauge.plans.profile import profile_table
from sparkgauge.plans.recommendations import as_operations, cleaning_recommendations, model_targets, select_recommended_ops
from sparkgauge.plans.score import quality_score, score_facts
from sparkgauge.plans.semantics import schema_profile
from sparkgauge.session import small_frame


def codes(df):
    return {(r["code"], r["column_name"]) for r in validation.quality_warnings(df).collect()}


def critical(df, headers=None):
    row = validation.critical_checks(df, headers).first()
    return row["code"] if row else None


def types(df, exact=True):
    return {r["column_name"]: r["semantic_type"] for r in schema_profile(df, exact).collect()}


def test_critical_checks_in_order(spark):
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    assert critical(one) is None
    assert critical(one, []) == "NO_COLUMNS"
    assert critical(one, ["a", None]) == "BLANK_HEADERS"
    assert critical(one, ["a", "  "]) == "BLANK_HEADERS"
    assert critical(one, ["Unnamed: 0", "b"]) == "BLANK_HEADERS"
    assert critical(one, ["a", "a"]) == "DUPLICATE_HEADERS"
    assert critical(one, ["", "a", "a"]) == "BLANK_HEADERS"
    assert critical(one, ["a", "!!!"]) == "INVALID_HEADER_CHARACTERS"
    assert critical(one, ["größe", "数量"]) is None
    assert critical(one.limit(0)) == "EMPTY_DATASET"
    nothing = spark.createDataFrame([(None, None), (float("nan"), None)], "a double, b string")
    assert critical(nothing) == "ALL_NULL_DATASET"


def test_critical_messages(spark):
    one = spark.createDataFrame([(1,)], "a int")
    row = validation.critical_checks(one, ["b", "a", "b", "a"]).first()
    assert row["message"] == "The dataset contains duplicate column headers: a, b."
    row = validation.critical_checks(one, ["a", "😀", "--"]).first()
    assert row["message"].endswith("'😀', '--'.")
    assert row["recovery"].startswith("Replace emoji-only")


@pytest.mark.parametrize("rows, expected", [
    (1, {"VERY_SMALL_DATASET", "LOW_STATISTICAL_RELIABILITY", "ONE_ROW_DATASET"}),
    (4, {"VERY_SMALL_DATASET", "LOW_STATISTICAL_RELIABILITY"}),
    (5, {"LOW_STATISTICAL_RELIABILITY"}),
    (29, {"LOW_STATISTICAL_RELIABILITY"}),
    (30, set()),
])
def test_row_count_warnings(spark, rows, expected):
    df = spark.range(rows).select("id", (F.col("id") * 1.5).alias("b"))
    found = {c for c, _ in codes(df)}
    assert found - {"CONSTANT_COLUMN"} == expected


def test_high_outliers_needs_more_than_fifteen_percent(spark):
    df = spark.createDataFrame([(10.0,)] * 8 + [(1000.0,)] * 2, "x double")
    assert ("HIGH_OUTLIERS", "x") in codes(df)
    df = spark.createDataFrame([(10.0,)] * 17 + [(1000.0,)] * 3, "x double")
    assert ("HIGH_OUTLIERS", "x") not in codes(df)


def test_high_missingness_needs_more_than_ninety_percent(spark):
    at = spark.createDataFrame([(None, i) for i in range(18)] + [(1.0, 18), (2.0, 19)], "x double, i int")
    over = spark.createDataFrame([(None, i) for i in range(19)] + [(1.0, 19)], "x double, i int")
    assert ("HIGH_MISSINGNESS", "x") not in codes(at)
    assert ("HIGH_MISSINGNESS", "x") in codes(over)


def test_infinity_blank_constant_and_long_names(spark):
    name = "n" * 101
    df = spark.createDataFrame(
        [(float("inf"), " ", None, 1.0, 1), (float("-inf"), "a", None, 1.0, 2), (float("nan"), None, None, 1.0, 3)],
        f"x double, s string, e string, c double, `{name}` int",
    )
    found = codes(df)
    assert {("INFINITY_VALUES", "x"), ("EMPTY_STRING_VALUES", "s"), ("CONSTANT_COLUMN", "e"), ("CONSTANT_COLUMN", "c")} <= found
    assert ("LONG_COLUMN_NAME", name) in found
    assert ("CONSTANT_COLUMN", "x") in found  # nothing but infinities and NaN is an empty column here


def test_mixed_type_share_and_samples(spark):
    df = spark.createDataFrame([(str(i),) for i in range(6)] + [(w,) for w in ("d", "c", "b", "a")], "s string")
    row = validation.mixed_type(df).first()
    assert (row["invalid_count"], row["invalid_percentage"], row["invalid_values"]) == (4, 40.0, ["a", "b", "c", "d"])
    below = spark.createDataFrame([(str(i),) for i in range(5)] + [(w,) for w in "abcd"], "s string")
    assert validation.mixed_type(below).count() == 0
    pure = spark.createDataFrame([("1",), ("2.5",), ("1e3",)], "s string")
    assert validation.mixed_type(pure).count() == 0


def test_one_column(spark):
    assert ("ONE_COLUMN_DATASET", None) in codes(spark.range(40).toDF("a"))


@pytest.mark.parametrize("rows, level", [(0, "UNRELIABLE"), (1, "UNRELIABLE"), (2, "VERY_LIMITED"), (4, "VERY_LIMITED"), (5, "LIMITED"), (29, "LIMITED"), (30, "STANDARD")])
def test_tiers(spark, rows, level):
    row = reliability.reliability(small_frame(spark, [(rows,)], "row_count bigint")).first()
    assert row["level"] == level
    assert row["can_model"] == (rows >= 5)
    assert len(row["warnings"]) == {"UNRELIABLE": 4, "VERY_LIMITED": 4, "LIMITED": 3, "STANDARD": 0}[level]


@pytest.mark.parametrize("pair", [("0", "1"), ("0.0", "1.0"), ("False", "TRUE"), ("f", "T"), (" no", "Yes"), ("N", "y")])
def test_boolean_sets(spark, pair):
    df = spark.createDataFrame([(pair[i % 2],) for i in range(10)], "s string")
    assert types(df) == {"s": "boolean"} == types(df, exact=False)


def test_semantic_type_order(spark):
    long_text = "word " * 12
    rows = [(f"id{i}", f"{long_text}{i}", "ab"[i % 2], f"2024-01-{i + 1:02d}", i % 2, float(i), str(i * 37), True) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, note string, cat string, d string, flag int, x double, num string, b boolean")
    expected = {
        "id": "identifier", "note": "text", "cat": "categorical", "d": "datetime", "flag": "boolean", "x": "numeric", "num": "identifier", "b": "boolean",
    }
    assert types(df) == expected == types(df, exact=False)
    assert set(types(df.limit(0)).values()) == {"categorical"}


def test_digest_keeps_long_text_facts(spark):
    rows = [("a" * 70,), ("a" * 70,), ("b" * 100,), (None,)]
    row = frequencies.value_facts(spark.createDataFrame(rows, "s string")).first()
    assert (row["distinct_count"], row["null_count"], row["avg_length"]) == (2, 1, 80.0)


def test_duplicates_with_nulls_and_nan(spark):
    rows = [(1, None), (None, 1), (1, None), (None, 1), (2, 2), (2, 2), (2, 2)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert duplicates.duplicate_count(df).first()["duplicate_count"] == 4
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (0.0,), (-0.0,)], "x double")
    assert duplicates.duplicate_count(df).first()["duplicate_count"] == 2


def test_nested_maps_and_nulls_in_duplicates(spark):
    df = spark.createDataFrame([([{"a": 1, "b": 2}], ({"x": 1},), None, "p"), ([{"b": 2, "a": 1}], ({"x": 1},), None, "p"), ([{"a": 1}], ({"x": 1},), "p", None)],
                               "m array<map<string,int>>, s struct<k: map<string,int>>, a string, b string")
    assert duplicates.duplicate_count(df).first()["duplicate_count"] == 1
    assert duplicates.drop_duplicates(df).count() == 2 and duplicates.drop_duplicates(df).columns == df.columns
    df = spark.createDataFrame([([None, "a"],), (["a", None],), (["a"],), (None,)], "v array<string>")
    assert duplicates.duplicate_count(df).first()["duplicate_count"] == 0


def test_modes_in_their_own_type(spark):
    low, big = -(2**63), 9007199254740993
    df = spark.createDataFrame([(big, Decimal("90071992547409.01"), low), (big, Decimal("90071992547409.01"), low), (5, Decimal("90071992547409.02"), 1)],
                               "b bigint, d decimal(20,2), l bigint")
    got = {r["column_name"]: (r["mode_text"], r["mode_count"]) for r in frequencies.numeric_modes(df).collect()}
    assert got == {"b": (str(big), 2), "d": ("90071992547409.01", 2), "l": (str(low), 2)}
    facts = {r["column_name"]: r["distinct_count"] for r in frequencies.numeric_value_facts(df).collect()}
    assert facts == {"b": 2, "d": 2, "l": 2}


def test_long_texts_tie_by_their_whole_value_and_keep_their_type(spark):
    lead = "x" * 70
    df = spark.createDataFrame([(lead + "bbb",), (lead + "aazzz",)] * 2, "s string")
    rows = frequencies.top_values(df, k=1).collect()
    assert [(r["value"], r["count"]) for r in rows] == [(lead + "aazzz", 2)]
    pad = " " * 80
    df = spark.createDataFrame([("true" + pad, "2024-01-02" + pad), ("false" + pad, "2024-01-03" + pad)], "b string, d string")
    facts = {r["column_name"]: r for r in frequencies.value_facts(df).collect()}
    short = {r["column_name"]: r for r in frequencies.value_facts(df.selectExpr("trim(b) AS b", "trim(d) AS d")).collect()}
    assert facts["b"]["boolean_pair"] == short["b"]["boolean_pair"] and facts["b"]["boolean_pair"]
    assert facts["b"]["avg_length"] == short["b"]["avg_length"] + 80


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(3, -1.5), (1, 2.0), (3, -1.5), (1, 2.0)], "v int, w double")
    assert {r["column_name"]: r["mode"] for r in frequencies.numeric_modes(df).collect()} == {"v": 1.0, "w": -1.5}


def test_constant_and_empty(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None)], "a int, b string, c string")
    assert [r[0] for r in counts.constant_not_empty(df).select("column_name").collect()] == ["b"]
    assert [r[0] for r in counts.empty_columns(df).collect()] == ["c"]


def facts(spark, **values):
    base = {"row_count": 100, "column_count": 4, "missing_cells": 0, "duplicate_count": 0, "empty_columns": [], "constant_columns": [], "long_names": 0, "total_outliers": 0, "collinear_pairs": 0}
    base |= values
    schema = "row_count bigint, column_count bigint, missing_cells bigint, duplicate_count bigint, empty_columns array<string>, constant_columns array<string>, long_names bigint, total_outliers bigint, collinear_pairs bigint"
    return small_frame(spark, [tuple(base.values())], schema)


@pytest.mark.parametrize("values, score", [
    ({}, 100),
    ({"missing_cells": 40}, 95),           # 10 % missing: 5 points
    ({"missing_cells": 400}, 75),          # capped at 25
    ({"duplicate_count": 1}, 96),          # 3.5 points, truncated
    ({"duplicate_count": 90}, 85),         # capped at 15
    ({"empty_columns": ["a"]}, 92),
    ({"empty_columns": ["a", "b", "c"]}, 80),
    ({"constant_columns": ["a", "b"]}, 92),
    ({"constant_columns": list("abcd")}, 85),
    ({"total_outliers": 20}, 96),
    ({"total_outliers": 90}, 90),
    ({"collinear_pairs": 3}, 94),
    ({"collinear_pairs": 9}, 90),
    ({"row_count": 1}, 70),
    ({"row_count": 4}, 75),
    ({"row_count": 29}, 85),
    ({"missing_cells": 400, "duplicate_count": 99, "empty_columns": list("abc"), "constant_columns": list("defg"), "total_outliers": 99, "collinear_pairs": 9}, 10),
])
def test_score(spark, values, score):
    assert quality_score(facts(spark, **values)).first()["score"] == score


def test_score_components_and_reasons(spark):
    row = quality_score(facts(spark, missing_cells=40, duplicate_count=5, empty_columns=["a"], total_outliers=7, collinear_pairs=2, long_names=1)).first()
    assert (row["structure"], row["completeness"], row["consistency"], row["reliability"], row["readiness"]) == (87, 80, 85, 100, 100)
    assert row["reasons"][0] == "Deducted 5.0 points due to 10.0% total missingness in the dataset."
    assert row["reasons"][2] == "Deducted 8 points due to empty columns: a."
    assert row["status"] == "Needs Cleaning"
    assert row["score"] == 76


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 50), "x", "yes" if i % 2 else "no", None, 1000.0 if i == 7 else float(i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, gap double, same string, answer string, none string, total double")
    return df.union(df.limit(5))


def test_recommended_cleaning_does_not_lower_the_score(spark, messy):
    recommended = cleaning_recommendations(profile_table(messy))
    ops = as_operations(select_recommended_ops(recommended))
    assert [o["type"] for o in ops] == ["drop_duplicates", "drop_columns", "drop_columns", "impute_missing", "handle_outliers"]
    metrics = {r["metric"]: (r["before"], r["after"]) for r in report.before_after(messy, ops).collect()}
    assert metrics["row_count"] == (205.0, 200.0)
    assert metrics["missing_cells"][1] == 0.0
    assert metrics["score"][1] > metrics["score"][0]


def test_targets(spark, messy):
    p = profile_table(messy)
    assert [(r["column_name"], r["task"]) for r in model_targets(p.columns, p.totals).orderBy("column_ix").collect()] == [("total", "Regression")]
    small = profile_table(messy.limit(4))
    row = model_targets(small.columns, small.totals).first()
    assert row["task"].startswith("Data Collection") and "1) Collect additional observations." in row["reasoning"]
    plain = profile_table(messy.select("id", "gap"))
    assert model_targets(plain.columns, plain.totals).first()["task"] == "Clustering / Unsupervised Learning"


def test_findings_by_tier(spark, messy):
    found = [r["finding"] for r in findings.findings(profile_table(messy)).orderBy("place").collect()]
    assert found[0].startswith("High missingness in 'gap'") and len(found) <= 8
    tiny = [r["finding"] for r in findings.findings(profile_table(messy.limit(3))).orderBy("place").collect()]
    assert len(tiny) == 4 and tiny[1].startswith("Very limited")
    clean = spark.range(12).select((F.col("id") % 3).alias("a"))
    texts = [r["finding"] for r in findings.findings(profile_table(clean)).orderBy("place").collect()]
    assert any(t.startswith("Dataset structure") or t.startswith("Non-normal") for t in texts)


def test_summary_and_risks(spark, messy):
    p = profile_table(messy)
    text = findings.executive_summary(quality_score(score_facts(p))).first()["summary"]
    assert text.startswith("The dataset contains 205 records and 6 attributes.") and "duplicate rows detected" in text
    kinds = [(r["kind"], r["text"]) for r in findings.risks_opportunities(p).collect()]
    assert any(k == "risk" and "Duplicate rows" in t for k, t in kinds)
    tiny = findings.risks_opportunities(profile_table(messy.limit(1))).collect()
    assert sum(r["kind"] == "risk" for r in tiny) == 8


def test_column_profile_text(spark, messy):
    rows = {r["column_name"]: r for r in report.column_profiles(profile_table(messy)).collect()}
    assert rows["total"]["stats_summary"].startswith("Mean: ") and rows["total"]["outlier_count"] >= 1
    assert rows["answer"]["stats_summary"].startswith("Mode: 'no' (")
    assert rows["none"]["stats_summary"] == "N/A"


@pytest.mark.parametrize("days, length", [(60, 10), (61, 21), (730, 21), (731, 7)])
def test_time_bucket_by_span(spark, days, length):
    df = spark.range(101).select(
        F.timestamp_seconds(F.unix_timestamp(F.lit("2020-01-01 00:00:00")) + F.floor(F.col("id") * days * 864)).alias("ts"), F.col("id").cast("double").alias("v")
    )
    label = charts.time_bucket_mean(df, "ts", "v").first()["date"]
    assert len(label) == length


def test_short_series_stays_raw(spark):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.col("id").cast("double").alias("v"))
    assert charts.time_bucket_mean(df, "ts", "v", raw_points=100).count() == 100
    assert charts.time_bucket_mean(df, "ts", "v").count() < 20
    assert charts.time_bucket_mean(df, "ts", "v", unit="month").count() == 4
    assert charts.scatter_sample(df, "v", "v").count() == 100 and charts.scatter_sample(df, "v", "v", points=7).count() == 7


def test_flat_histogram_and_totals(spark):
    flat = charts.histogram(spark.createDataFrame([(3.0,)] * 7, "x double")).collect()
    assert [(r["label"], r["count"]) for r in flat] == [("2.5 - 3.5", 7)]
    df = spark.range(1000).select((F.col("id") % 37 / 10).alias("x"))
    rows = charts.histogram(df, ["x"]).collect()
    assert sum(r["count"] for r in rows) == 1000 and len(rows) == 15
    assert max(r["upper"] for r in rows) == 3.6


def test_profile_ignores_row_order_and_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    one = profile_table(df)
    two = profile_table(df.repartition(7).orderBy(F.rand(3)))
    for a, b in ((one.columns, two.columns), (one.top, two.top)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    pick = ["column_name", "n", "distinct_count", "median", "mode", "p5", "p95", "outliers_count"]
    assert sorted(map(str, one.numeric.select(pick).collect())) == sorted(map(str, two.numeric.select(pick).collect()))


def test_empty_table_profile(spark):
    df = spark.createDataFrame([], "a int, b string")
    p = profile_table(df)
    assert p.totals.first()["row_count"] == 0
    assert quality_score(score_facts(p)).first()["score"] == 70


def test_top_values_of_long_texts(spark):
    texts = ["b" * 200] * 3 + ["a" * 100] * 3 + ["short"] * 4 + ["c" * 65] + [None] * 9
    rows = frequencies.top_values(spark.createDataFrame([(t,) for t in texts], "s string"), k=3).orderBy("rank").collect()
    assert [(r["value"], r["count"], r["percentage"]) for r in rows] == [("short", 4, 20.0), ("a" * 100, 3, 15.0), ("b" * 200, 3, 15.0)]

"""Hypothesis tests: sums on Spark, tails over the few result rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge.functions.cells import finite_or_null
from sparkgauge.functions.normality import k_squared, shapiro_wilk
from sparkgauge.functions.tails import chi_p_value, f_p_value, t_p_value
from sparkgauge.operators.grouped import category_columns, category_pairs, crosstab, group_summaries, margins
from sparkgauge.operators.moments import column_moments
from sparkgauge.operators.shape import numeric_columns, numeric_long, other_columns
from sparkgauge.session import pin, small_frame

ALPHA = 0.05
SMALLEST_GROUP = 5
SMALLEST_SAMPLE = 8
SHAPIRO_LIMIT = 5_000

TEST_SCHEMA = (
    "test_type string, test_name string, variables array<string>, statistic double, df1 double, df2 double, "
    "p_value double, significant boolean, interpretation string, rule_order int"
)


def _order(names: Sequence[str], column: str) -> Column:
    """Position of a name in the table, to take the first k pairs in table order."""
    return F.array_position(F.lit(list(names)), F.col(column))


def _first(tests: DataFrame, order: Sequence[Column], most: int | None) -> DataFrame:
    """Number the tests in table order (a few rows per column pair) and keep the first ``most``."""
    ranked = tests.withColumn("rule_order", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    return ranked if most is None else ranked.filter(F.col("rule_order") <= most)


def normality_k2(df: DataFrame, columns: Sequence[str] | None = None, moments: DataFrame | None = None) -> DataFrame:
    """K-squared test, one row per column with a value; reason ``too_few`` below eight values."""
    facts = (moments if moments is not None else column_moments(df, columns)).filter(F.col("n") > 0)
    enough = F.col("n") >= SMALLEST_SAMPLE
    k2 = F.when(enough & (F.col("variance") > 0), k_squared(F.col("n"), F.col("skewness"), F.col("kurtosis")))
    tested = facts.select("column_name", "n", k2.alias("statistic")).withColumn("p_value", F.exp(-F.col("statistic") / 2))
    normal = F.when(enough, F.coalesce(F.col("p_value") >= ALPHA, F.lit(False)))
    return tested.select("*", normal.alias("is_normal"), F.when(~enough, "too_few").alias("reason"))


def normality_shapiro(df: DataFrame, columns: Sequence[str] | None = None, moments: DataFrame | None = None) -> DataFrame:
    """W test, one row per column with a value; reason ``too_few`` below eight and ``too_many`` above 5000 values.

    The test is defined between these bounds, so a group never holds more.
    """
    facts = pin(moments if moments is not None else column_moments(df, columns))
    chosen = facts.filter(F.col("n").between(SMALLEST_SAMPLE, SHAPIRO_LIMIT)).select("column_name")
    names = [r["column_name"] for r in chosen.collect()]
    schema = "column_name string, n bigint, statistic double, p_value double"

    def w_test(group: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(group["value"].to_numpy())
        return pd.DataFrame([(group["column_name"].iloc[0], len(group), w, p)], columns=["column_name", "n", "statistic", "p_value"])

    if names:
        present = numeric_long(df, names).filter(F.col("value").isNotNull())
        tested = present.groupBy("column_name").applyInPandas(w_test, schema)
    else:
        tested = small_frame(df.sparkSession, [], schema)
    rows = tested.select("*", (F.col("p_value") >= ALPHA).alias("is_normal"), F.lit(None).cast("string").alias("reason"))
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("statistic", "double"), ("p_value", "double"), ("is_normal", "boolean"))]
    reason = F.when(F.col("n") < SMALLEST_SAMPLE, "too_few").otherwise("too_many")
    outside = facts.filter((F.col("n") > 0) & ~F.col("n").between(SMALLEST_SAMPLE, SHAPIRO_LIMIT))
    return rows.unionByName(outside.select("column_name", F.col("n").cast("bigint").alias("n"), *nothing, reason.alias("reason")))


def normality(df: DataFrame, columns: Sequence[str] | None = None, moments: DataFrame | None = None) -> DataFrame:
    """One row per numeric column with a value, by the test that fits its size: W up to 5000 values, K-squared above."""
    facts = pin(moments if moments is not None else column_moments(df, columns))
    k2 = normality_k2(df, columns, facts.filter(F.col("n") > SHAPIRO_LIMIT)).withColumn("test_name", F.lit("D'Agostino K-squared"))
    w = normality_shapiro(df, columns, facts.filter(F.col("n") <= SHAPIRO_LIMIT))
    return k2.unionByName(w.withColumn("test_name", F.when(F.col("reason").isNull(), "Shapiro-Wilk")))


def welch_statistics(groups: DataFrame) -> DataFrame:
    """t and Welch-Satterthwaite degrees of freedom per (category, column); lower value first."""
    per_value = groups.filter(F.col("n") >= SMALLEST_GROUP)
    both = per_value.groupBy("category", "column_name").agg(
        F.sort_array(F.collect_list(F.struct("category_value", "n", "mean", "variance"))).alias("g")
    )
    pair = both.filter(F.size("g") == 2).select("category", "column_name", F.col("g")[0].alias("a"), F.col("g")[1].alias("b"))
    sa, sb = F.col("a.variance") / F.col("a.n"), F.col("b.variance") / F.col("b.n")
    freedom = (sa + sb) * (sa + sb) / (sa * sa / (F.col("a.n") - 1) + sb * sb / (F.col("b.n") - 1))
    apart = F.col("a.mean") - F.col("b.mean")
    # Without any variance the statistic is infinite for different means and undefined for equal ones.
    statistic = F.when(sa + sb > 0, apart / F.sqrt(sa + sb)).when(apart != 0, F.signum(apart) * F.lit(float("inf")))
    return pair.select(
        "category", "column_name",
        F.col("a.category_value").alias("value1"), F.col("b.category_value").alias("value2"),
        statistic.alias("statistic"), F.when(sa + sb > 0, freedom).otherwise(F.lit(1.0)).alias("df"),
    )


def _two_valued(df: DataFrame, categories: Sequence[str] | None) -> list[str]:
    return [c for c, k in category_columns(df, categories, 2).items() if k == 2]


def welch_t(df: DataFrame, categories: Sequence[str] | None = None, numerics: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    names = _two_valued(df, categories)
    nums = list(numerics) if numerics is not None else numeric_columns(df)
    if not names or not nums:
        return small_frame(df.sparkSession, [], TEST_SCHEMA)
    return _welch_rows(group_summaries(df, names, nums), names, nums, most)


def _welch_rows(groups: DataFrame, names: Sequence[str], nums: Sequence[str], most: int | None) -> DataFrame:
    stats = _first(welch_statistics(groups), [_order(names, "category"), _order(nums, "column_name")], most)
    tested = stats.withColumn("p_value", t_p_value(F.col("statistic"), F.col("df")))
    significant = F.coalesce(F.col("p_value") < ALPHA, F.lit(False))
    differs = F.format_string(
        "The mean of '%s' is significantly different between groups '%s' and '%s' (p < 0.05).",
        "column_name", "value1", "value2",
    )
    same = F.format_string(
        "No statistically significant difference in the mean of '%s' between groups '%s' and '%s'.",
        "column_name", "value1", "value2",
    )
    return tested.select(
        F.lit("T-Test").alias("test_type"),
        F.format_string("Independent Two-Sample T-Test (%s vs %s)", "category", "column_name").alias("test_name"),
        F.array("category", "column_name").alias("variables"),
        finite_or_null(F.col("statistic")).alias("statistic"), F.col("df").alias("df1"), F.lit(None).cast("double").alias("df2"), "p_value",
        significant.alias("significant"), F.when(significant, differs).otherwise(same).alias("interpretation"), "rule_order",
    )


def anova_statistics(groups: DataFrame) -> DataFrame:
    """F and its degrees of freedom per (category, column) from group sizes, means and variances."""
    usable = groups.filter(F.col("n") >= SMALLEST_GROUP)
    pair = Window.partitionBy("category", "column_name")
    grand = F.sum(F.col("n") * F.col("mean")).over(pair) / F.sum("n").over(pair)
    spread = usable.withColumn("grand", grand)
    n, off = F.col("n"), F.col("mean") - F.col("grand")
    sums = spread.groupBy("category", "column_name").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"),
        F.sum(n * off * off).alias("between"), F.sum((n - 1) * F.col("variance")).alias("within"),
    )
    df1, df2 = F.col("groups") - 1, F.col("total") - F.col("groups")
    ratio = F.when(F.col("within") > 0, (F.col("between") / df1) / (F.col("within") / df2)).when(F.col("between") > 0, F.lit(float("inf")))
    return sums.filter(F.col("groups") >= 3).select(
        "category", "column_name", ratio.alias("statistic"), df1.cast("double").alias("df1"), df2.cast("double").alias("df2")
    )


def anova(df: DataFrame, categories: Sequence[str] | None = None, numerics: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    names = [c for c, k in category_columns(df, categories).items() if k >= 3]
    nums = list(numerics) if numerics is not None else numeric_columns(df)
    if not names or not nums:
        return small_frame(df.sparkSession, [], TEST_SCHEMA)
    return _anova_rows(group_summaries(df, names, nums), names, nums, most)


def _anova_rows(groups: DataFrame, names: Sequence[str], nums: Sequence[str], most: int | None) -> DataFrame:
    stats = _first(anova_statistics(groups), [_order(names, "category"), _order(nums, "column_name")], most)
    tested = stats.withColumn("p_value", f_p_value(F.col("statistic"), F.col("df1"), F.col("df2")))
    significant = F.coalesce(F.col("p_value") < ALPHA, F.lit(False))
    differs = F.format_string(
        "There are statistically significant differences between the group means of '%s' across categories of '%s' (p < 0.05).",
        "column_name", "category",
    )
    same = F.format_string(
        "No significant differences were found between the group means of '%s' across categories of '%s'.",
        "column_name", "category",
    )
    return tested.select(
        F.lit("ANOVA").alias("test_type"),
        F.format_string("One-Way ANOVA (%s vs %s)", "category", "column_name").alias("test_name"),
        F.array("category", "column_name").alias("variables"),
        finite_or_null(F.col("statistic")).alias("statistic"), "df1", "df2", "p_value",
        significant.alias("significant"), F.when(significant, differs).otherwise(same).alias("interpretation"), "rule_order",
    )


def chi_square_statistics(table: DataFrame) -> DataFrame:
    """Chi-square per column pair from contingency cells, with Yates' correction at one degree of freedom.

    Unseen cells need no rows: without the correction the statistic is
    N * (sum of O^2 / (row * column) - 1), and in a two-by-two table every cell
    has the same distance between observed and expected count.
    """
    o, r, c, n = F.col("n"), F.col("row_total"), F.col("column_total"), F.col("total")
    gap = F.abs(o - r * c / n)
    sums = margins(table).groupBy("var1", "var2").agg(
        F.first("total").alias("total"),
        F.count_distinct("value1").alias("rows"), F.count_distinct("value2").alias("columns"),
        F.sum(o * o / (r * c)).alias("share"), F.max(gap).alias("gap"),
        F.min("row_total").alias("r_low"), F.max("row_total").alias("r_high"),
        F.min("column_total").alias("c_low"), F.max("column_total").alias("c_high"),
    )
    total = F.col("total")
    plain_chi = total * (F.col("share") - 1)
    near = F.greatest(F.col("gap") - F.lit(0.5), F.lit(0.0))
    # Two rows and two columns: the margins are the low and the high one of each side.
    weight = total * total * total / (F.col("r_low") * F.col("r_high").cast("double") * F.col("c_low") * F.col("c_high"))
    freedom = (F.col("rows") - 1) * (F.col("columns") - 1)
    return sums.filter((F.col("rows") >= 2) & (F.col("columns") >= 2)).select(
        "var1", "var2", F.when(freedom == 1, near * near * weight).otherwise(plain_chi).alias("statistic"), freedom.cast("double").alias("df")
    )


def chi_square(df: DataFrame, columns: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    names = list(category_columns(df, columns))
    if len(names) < 2:
        return small_frame(df.sparkSession, [], TEST_SCHEMA)
    return _chi_rows(crosstab(df, category_pairs(names)), names, most)


def _chi_rows(table: DataFrame, names: Sequence[str], most: int | None) -> DataFrame:
    stats = _first(chi_square_statistics(table), [_order(names, "var1"), _order(names, "var2")], most)
    tested = stats.withColumn("p_value", chi_p_value(F.col("statistic"), F.col("df")))
    significant = F.col("p_value") < ALPHA
    linked = F.format_string("There is a statistically significant association between '%s' and '%s' (p < 0.05).", "var1", "var2")
    free = F.format_string("No significant association was detected between '%s' and '%s' (independent).", "var1", "var2")
    return tested.select(
        F.lit("Chi-Square").alias("test_type"),
        F.format_string("Chi-Square Test of Independence (%s vs %s)", "var1", "var2").alias("test_name"),
        F.array("var1", "var2").alias("variables"),
        "statistic", F.col("df").alias("df1"), F.lit(None).cast("double").alias("df2"), "p_value",
        significant.alias("significant"), F.when(significant, linked).otherwise(free).alias("interpretation"), "rule_order",
    )


def hypothesis_tests(df: DataFrame, most: int | None = None, few: dict[str, int] | None = None) -> DataFrame:
    """Welch t, ANOVA and chi-square tests of the table, each kind in table order.

    The category columns (``few``: name to distinct count) are found once. The group
    statistics of the mean tests are pinned, so one scan feeds both; another makes the
    contingency tables.
    """
    if few is None:
        few = category_columns(df, other_columns(df))
    nums = numeric_columns(df)
    parts = []
    if few and nums:
        groups = pin(group_summaries(df, list(few), nums))
        two = [c for c, k in few.items() if k == 2]
        more = [c for c, k in few.items() if k >= 3]
        if two:
            parts.append(_welch_rows(groups.filter(F.col("category").isin(two)), two, nums, most))
        if more:
            parts.append(_anova_rows(groups.filter(F.col("category").isin(more)), more, nums, most))
    if len(few) > 1:
        parts.append(_chi_rows(crosstab(df, category_pairs(list(few))), list(few), most))
    tests = small_frame(df.sparkSession, [], TEST_SCHEMA)
    for part in parts:
        tests = tests.unionByName(part)
    return tests


def normality_as_tests(frame: DataFrame) -> DataFrame:
    """Normality rows in the layout of the other tests, named by the test that was used."""
    off = ~F.col("is_normal")
    text = F.when(off, F.lit("' is not normally distributed (p < 0.05).")).otherwise(F.lit("' is normally distributed (p >= 0.05)."))
    return frame.filter(F.col("test_name").isNotNull()).select(
        F.lit("Normality Test").alias("test_type"),
        F.format_string("%s: '%s'", "test_name", "column_name").alias("test_name"),
        F.array("column_name").alias("variables"),
        "statistic", F.lit(None).cast("double").alias("df1"), F.lit(None).cast("double").alias("df2"), "p_value",
        off.alias("significant"), F.concat(F.lit("'"), F.col("column_name"), text).alias("interpretation"),
        F.lit(None).cast("int").alias("rule_order"),
    )


def all_tests(df: DataFrame, most: int | None = None) -> DataFrame:
    return hypothesis_tests(df, most).unionByName(normality_as_tests(normality(df)))

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import tails
from sparkgauge.functions.normality import shapiro_wilk
from sparkgauge.operators import correlation, hypothesis
from sparkgauge.session import small_frame


@pytest.mark.parametrize("value, expected", [
    # Published upper 5 %, 1 % and 2.5 % points of the distributions.
    (tails.t_tail(2.228, 10), 0.05), (tails.t_tail(3.169, 10), 0.01), (tails.t_tail(12.706, 1), 0.05), (tails.t_tail(1.96, 1e9), 0.05),
    (tails.f_tail(3.326, 5, 10), 0.05), (tails.f_tail(4.103, 2, 10), 0.05), (tails.f_tail(2.866, 4, 20), 0.05),
    (tails.chi_tail(3.841, 1), 0.05), (tails.chi_tail(5.991, 2), 0.05), (tails.chi_tail(18.307, 10), 0.05), (tails.chi_tail(23.209, 10), 0.01),
])
def test_tails_against_tables(value, expected):
    assert value == pytest.approx(expected, rel=2e-3)


def test_tail_identities():
    for x in (0.01, 0.5, 3.0, 40.0):
        assert tails.chi_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert tails.chi_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert tails.f_tail(x * x, 1, 7) == pytest.approx(tails.t_tail(x, 7), rel=1e-10)
    assert tails.t_tail(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert tails.t_tail(2.0, 9.9e7) == pytest.approx(tails.t_tail(2.0, 1.1e8), rel=1e-6)


def test_shapiro_published_example():
    # Weights of 11 men, the worked example of Shapiro and Wilk (1965): W = 0.79, p below 0.01.
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float))
    assert w == pytest.approx(0.79, abs=0.005)
    assert p == pytest.approx(0.0067, abs=0.001)


def test_shapiro_on_normal_and_skewed_samples():
    rng = np.random.default_rng(5)
    assert shapiro_wilk(rng.normal(size=500))[1] > 0.05
    assert shapiro_wilk(rng.exponential(size=500))[1] < 1e-10
    assert shapiro_wilk(np.full(20, 3.0)) == (1.0, 1.0)


def test_normality_by_sample_size(spark):
    def column(n):
        return F.when(F.col("id") < n, F.rand(1))

    df = spark.range(6000).select(column(7).alias("few"), column(8).alias("eight"), column(5000).alias("most"), column(5001).alias("more"), F.lit(None).cast("double").alias("none"))
    rows = {r["column_name"]: r for r in hypothesis.normality(df).collect()}
    assert rows["few"]["reason"] == "too_few" and rows["few"]["p_value"] is None
    assert {c: rows[c]["test_name"] for c in ("eight", "most", "more")} == {"eight": "Shapiro-Wilk", "most": "Shapiro-Wilk", "more": "D'Agostino K-squared"}
    assert "none" not in rows


def two_by_two(spark, counts):
    rows = [(a, b) for (a, b), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


def test_chi_square_has_yates_correction(spark):
    df = two_by_two(spark, {("x", "p"): 10, ("x", "q"): 5, ("y", "p"): 3, ("y", "q"): 12})
    row = hypothesis.chi_square(df).first()
    assert row["statistic"] == pytest.approx(4.887, abs=5e-4) and row["df1"] == 1.0
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(row["statistic"] / 2)), rel=1e-9)


def test_yates_step_stops_at_the_distance(spark):
    df = two_by_two(spark, {("x", "p"): 5, ("x", "q"): 5, ("y", "p"): 5, ("y", "q"): 5})
    assert hypothesis.chi_square(df).first()["statistic"] == 0.0


def test_chi_square_counts_unseen_cells(spark):
    df = two_by_two(spark, {("x", "p"): 6, ("y", "q"): 5, ("z", "q"): 4})
    row = hypothesis.chi_square(df).first()
    assert (row["statistic"], row["df1"]) == (pytest.approx(15.0), 2.0)


def test_welch_and_anova_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), h) for g, h, m, n in (("a", "u", 0, 40), ("b", "v", 1, 60), ("a", "w", 2, 30)) for v in rng.normal(m, 1 + m, n)]
    df = spark.createDataFrame(rows, "g string, x double, h string")
    a, b = (np.array([x for g, x, _ in rows if g == k]) for k in "ab")
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    welch = hypothesis.welch_t(df).first()
    assert welch["statistic"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
    assert welch["df1"] == pytest.approx((va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))
    groups = [np.array([x for _, x, h in rows if h == k]) for k in "uvw"]
    everything = np.concatenate(groups)
    between = sum(len(g) * (g.mean() - everything.mean()) ** 2 for g in groups) / 2
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(everything) - 3)
    anova = hypothesis.anova(df).first()
    assert anova["statistic"] == pytest.approx(between / within) and (anova["df1"], anova["df2"]) == (2.0, 127.0)


def test_small_groups_are_left_out(spark):
    rows = [("a", float(i)) for i in range(9)] + [("b", float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert hypothesis.welch_t(df).count() == 0
    df = spark.createDataFrame([(f"g{i % 4}", float(i * i % 7)) for i in range(40)] + [("tiny", 1.0)], "g string, x double")
    assert hypothesis.anova(df).first()["df1"] == 3.0


def test_too_many_categories_are_not_tested(spark):
    df = spark.range(200).select((F.col("id") % 11).cast("string").alias("a"), (F.col("id") % 2).cast("string").alias("b"), F.rand(2).alias("x"))
    kinds = [r["test_type"] for r in hypothesis.hypothesis_tests(df).collect()]
    assert kinds == ["T-Test"]


def test_all_tests_unless_the_caller_says_how_many(spark):
    df = spark.range(300).select(*[(F.col("id") % 2).cast("string").alias("g")], *[F.rand(i).alias(f"x{i}") for i in range(7)])
    assert hypothesis.welch_t(df).count() == 7
    assert hypothesis.welch_t(df, most=5).count() == 5


def test_every_column_in_both_normality_operators(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 5, F.col("id") * 1.0).alias("few"), F.when(F.col("id") < 50, F.rand(1)).alias("some"), F.rand(2).alias("many"))
    k2 = {r["column_name"]: r["reason"] for r in hypothesis.normality_k2(df).collect()}
    w = {r["column_name"]: r["reason"] for r in hypothesis.normality_shapiro(df).collect()}
    assert k2 == {"few": "too_few", "some": None, "many": None} and w == {"few": "too_few", "some": None, "many": "too_many"}
    both = {r["column_name"]: r["test_name"] for r in hypothesis.normality(df).collect()}
    assert both == {"few": None, "some": "Shapiro-Wilk", "many": "D'Agostino K-squared"}


def test_correlation_is_pairwise_complete_and_centred(spark):
    rng = np.random.default_rng(4)
    x = 1e9 + rng.normal(size=400)
    y = x - 1e9 + rng.normal(size=400)
    rows = [(float(a), float(b) if i % 5 else None, 7.0) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, flat double")
    keep = np.array([i % 5 != 0 for i in range(400)])
    got = {(r["x"], r["y"]): r["r_pairwise"] for r in correlation.correlation_matrix(df).collect()}
    assert got[("x", "y")] == got[("y", "x")] == pytest.approx(np.corrcoef(x[keep], y[keep])[0, 1], abs=5e-4)
    assert ("flat", "flat") not in got and got[("x", "x")] == 1.0


def test_strong_pair_p_value_and_perfect_pair(spark):
    df = spark.range(20).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), (F.col("id") + F.col("id") % 3 * 4).alias("c"))
    rows = {(r["var1"], r["var2"]): r for r in correlation.strong_correlations(df).collect()}
    assert rows[("a", "b")]["coefficient"] == 1.0 and rows[("a", "b")]["p_value"] == 0.0
    assert {r["coefficient"] >= 0.7 for r in rows.values()} == {True}
    assert correlation.correlation_matrix(df.select("a")).count() == 0


def test_p_values_skip_missing(spark):
    df = small_frame(spark, [(1.0, 5.0), (None, 5.0)], "t double, df double")
    assert [r[0] is None for r in df.select(tails.t_p_value(F.col("t"), F.col("df"))).collect()] == [False, True]


def test_groups_without_variance(spark):
    rows = [("a", 1.1, 3.0)] * 7 + [("b", 2.2, 3.0)] * 7
    df = spark.createDataFrame(rows, "g string, apart double, equal double")
    got = {r["variables"][1]: r for r in hypothesis.welch_t(df).collect()}
    assert (got["apart"]["statistic"], got["apart"]["p_value"], got["apart"]["significant"]) == (None, 0.0, True)
    assert (got["equal"]["p_value"], got["equal"]["significant"]) == (None, False)

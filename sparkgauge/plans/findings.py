"""Findings, risks, opportunities and the executive summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge.functions.cells import plain
from sparkgauge.plans.profile import Profile
from sparkgauge.plans.reliability import by_tier, texts, tier
from sparkgauge.plans.texts import (
    FINDINGS_WITHOUT_ROWS,
    NO_FINDINGS,
    OPPORTUNITIES,
    RISKS,
    SUMMARY_MIDDLE,
    TIER_ACTIONS,
    TIER_WARNINGS,
    TIERS,
)

MISSING_SHOWN = 10
OUTLIERS_SHOWN = 5
OUTLIERS_RISKY = 8


def placed(frame: DataFrame, most: int | None, *order: str) -> DataFrame:
    """Rows of a small frame numbered in a given order; the first ``most`` of them, or all."""
    window = Window.partitionBy(F.lit(1)).orderBy(*order)
    numbered = frame.withColumn("place", F.row_number().over(window))
    return numbered if most is None else numbered.filter(F.col("place") <= most)


def _texts(frame: DataFrame, order: int, place: Column, text: Column) -> DataFrame:
    return frame.select(F.lit(order).alias("rule_order"), place.cast("int").alias("item_ix"), text.alias("finding"))


def _fixed(totals: DataFrame, order: int, table: dict) -> DataFrame:
    """Fixed texts by tier, one row each."""
    lists = {t[0]: table.get(t[0], ()) for t in TIERS}
    return totals.select(F.lit(order).alias("rule_order"), F.posexplode(texts(F.col("row_count"), lists)).alias("item_ix", "finding"))


def all_findings(profile: Profile, tested: bool = True) -> DataFrame:
    """Every finding with its rule and position; without ``tested`` those of rule 6, which reads the tests, are left out."""
    level = profile.totals.select(tier(F.col("row_count"))).scalar()
    rows = profile.totals.select("row_count").scalar()
    name = F.col("column_name")
    missing = F.col("null_count") / rows * 100
    shape = profile.normality.filter(~F.col("is_normal")).select("column_name")
    skewed = profile.numeric.join(F.broadcast(shape), "column_name")
    kind_order = F.when(F.col("test_type") == "T-Test", 1).when(F.col("test_type") == "ANOVA", 2).otherwise(3)
    found = [
        _texts(profile.columns.filter(missing > MISSING_SHOWN), 1, F.col("column_ix"), F.format_string(
            "High missingness in '%s': %s%% of values are missing. This requires imputation or exclusion to avoid biased estimates.", name, plain(missing, 1))),
        _texts(profile.strong, 2, F.col("pair_ix"), F.format_string(
            "Strong correlation between '%s' and '%s' (r = %s, p-value = %s, %s).", "var1", "var2", plain(F.col("coefficient"), 3), plain(F.col("p_value"), 4),
            F.when(F.col("significant"), "statistically significant").otherwise("non-significant"))),
        _texts(profile.collinear, 3, F.col("pair_ix"), F.format_string(
            "High multicollinearity warning: '%s' and '%s' exhibit a correlation coefficient of %s. Consider dropping one during feature selection.",
            name, "correlated_with", plain(F.col("coefficient"), 3))),
        _texts(profile.numeric.filter(F.col("outliers_pct") > OUTLIERS_SHOWN), 4, F.col("column_ix"), F.format_string(
            "Outliers detected in '%s': %d values (%s%%) lie outside the 1.5x IQR boundary. Standard deviation is %s.",
            name, "outliers_count", plain(F.col("outliers_pct"), 2), plain(F.col("std"), 2))),
        _texts(skewed, 5, F.col("column_ix"), F.format_string(
            "Non-normal distribution in '%s': The column shows a skewness of %s and kurtosis of %s, deviating significantly from normality (p < 0.05).",
            name, plain(F.col("skewness"), 2), plain(F.col("kurtosis"), 2))),
    ]
    if tested:
        found.append(_texts(profile.tests.filter("significant"), 6, kind_order * 1000 + F.col("rule_order"), F.format_string(
            "Hypothesis Test Result (%s): %s", "test_type", "interpretation")))
    grounded = found[0]
    for part in found[1:]:
        grounded = grounded.unionByName(part)
    grounded = grounded.filter(~level.isin(*FINDINGS_WITHOUT_ROWS))
    return grounded.unionByName(_fixed(profile.totals, 0, FINDINGS_WITHOUT_ROWS)).unionByName(_fixed(profile.totals, 9, NO_FINDINGS))


def findings(profile: Profile, most: int | None = None) -> DataFrame:
    """(place, rule_order, finding): all findings by rule and column position, or the first ``most``.

    The fixed texts of rule 9 stand in only when no other rule fired. Where the rules before
    the tests give ``most`` findings, no test is run.
    """
    before = None if most is None else all_findings(profile, tested=False)
    enough = before is not None and before.filter(F.col("rule_order") < 6).count() >= most
    every = before if enough else all_findings(profile)
    lowest = Window.partitionBy(F.lit(1))
    kept = every.withColumn("low", F.min("rule_order").over(lowest)).filter((F.col("rule_order") < 9) | (F.col("low") == 9))
    return placed(kept, most, "rule_order", "item_ix").select("place", "rule_order", "finding")


def risks_opportunities(profile: Profile) -> DataFrame:
    """(kind, item_ix, text) with kind risk or opportunity."""
    totals = profile.totals
    rows, level = F.col("row_count"), tier(F.col("row_count"))
    collinear = profile.collinear.agg(F.count(F.lit(1)).alias("n")).scalar()
    wild = profile.numeric.agg(F.count_if(F.col("outliers_pct") > OUTLIERS_RISKY).alias("n")).scalar()
    numeric = profile.numeric.agg(F.count(F.lit(1)).alias("n")).scalar()
    strong = profile.strong.agg(F.count(F.lit(1)).alias("n")).scalar()
    kind_order = F.when(F.col("test_type") == "T-Test", 1).when(F.col("test_type") == "ANOVA", 2).otherwise(3)
    hits = profile.tests.filter("significant").select(kind_order.alias("kind"), "rule_order", "test_name")
    example = hits.agg(F.min(F.struct("kind", "rule_order", "test_name")).getField("test_name").alias("t")).scalar()
    careful = F.concat(
        texts(rows, TIER_WARNINGS),
        F.transform(texts(rows, TIER_ACTIONS), lambda x: F.concat(F.lit("Recommended Action: "), x)),
    )
    seen = F.array_compact(F.array(
        F.when(F.col("missing_cells") > 0, RISKS["missing"]),
        F.when(F.col("duplicate_count") > 0, RISKS["duplicates"]),
        F.when(collinear > 0, RISKS["collinear"]),
        F.when(wild > 0, RISKS["outliers"]),
    ))
    risks = F.when(level != "STANDARD", careful).when(F.size(seen) == 0, F.array(F.lit(RISKS["none"]))).otherwise(seen)
    chances = F.array_compact(F.array(
        F.when(strong > 0, OPPORTUNITIES["correlated"]),
        F.when(example.isNotNull(), F.format_string(OPPORTUNITIES["associated"], example)),
        F.when(numeric >= 2, OPPORTUNITIES["numeric"]),
    ))
    opportunities = (
        F.when(level == "UNRELIABLE", F.array(F.lit(OPPORTUNITIES["UNRELIABLE"])))
        .when(level == "VERY_LIMITED", F.array(F.lit(OPPORTUNITIES["VERY_LIMITED"])))
        .when(F.size(chances) == 0, F.array(F.lit(OPPORTUNITIES["none"])))
        .otherwise(chances)
    )
    risk_rows = totals.select(F.lit("risk").alias("kind"), F.posexplode(risks).alias("item_ix", "text"))
    chance_rows = totals.select(F.lit("opportunity").alias("kind"), F.posexplode(opportunities).alias("item_ix", "text"))
    return risk_rows.unionByName(chance_rows)


def executive_summary(scores: DataFrame) -> DataFrame:
    """(score, summary) from the frame of :func:`sparkgauge.plans.score.quality_score`."""
    rows, level = F.col("row_count"), tier(F.col("row_count"))
    attributes = F.format_string("The dataset contains %d records and %d attributes. ", "row_count", "column_count")
    single = F.format_string("The dataset contains a single observation with %d attributes. ", "column_count")
    middle = by_tier(rows, [SUMMARY_MIDDLE.get(t[0], "") for t in TIERS])
    short = F.concat(
        F.when(level == "UNRELIABLE", single).otherwise(attributes), middle,
        F.format_string(" The data quality/structure score is %d/100.", "score"),
    )
    full = F.concat(
        attributes,
        F.format_string("A comprehensive data quality evaluation yielded a score of %d/100, indicating %s ", "score", F.lower("explanation")),
        F.when(F.col("missing_cells") > 0, F.format_string("A total of %d cells are missing values. ", "missing_cells")).otherwise(""),
        F.when(F.col("duplicate_count") > 0, F.format_string("There are %d duplicate rows detected. ", "duplicate_count")).otherwise(""),
    )
    return scores.select("score", F.when(level == "STANDARD", full).otherwise(short).alias("summary"))

"""Quality score, its components and the closing status, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.functions.cells import plain
from sparkgauge.plans.profile import Profile
from sparkgauge.plans.reliability import by_tier, tier
from sparkgauge.plans.texts import FINAL_STATUS, SCORE_LEVELS, TIER_EXPLANATION, TIER_REASON, TIERS

LOWEST = 10


def score_facts(profile: Profile) -> DataFrame:
    """The one-row frame the score is computed from."""
    outliers = profile.numeric.agg(F.coalesce(F.sum("outliers_count"), F.lit(0)).alias("n")).scalar()
    collinear = profile.collinear.agg(F.count(F.lit(1)).alias("n")).scalar()
    return profile.totals.select("*", outliers.alias("total_outliers"), collinear.alias("collinear_pairs"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def _steps(choices, value: Column) -> Column:
    chosen = F.lit(choices[-1][1])
    for bound, text in reversed(choices[:-1]):
        chosen = F.when(value >= bound, F.lit(text)).otherwise(chosen)
    return chosen


def final_status(score: Column) -> Column:
    return _steps(FINAL_STATUS, score)


def quality_score(facts: DataFrame) -> DataFrame:
    """Score, explanation, reasons and components for every row of facts."""
    rows = F.col("row_count")
    cells = rows * F.col("column_count")
    with_shares = facts.select(
        "*",
        _share(F.col("missing_cells"), cells).alias("missing_pct"),
        _share(F.col("duplicate_count"), rows).alias("duplicate_pct"),
        _share(F.col("total_outliers"), rows).alias("outlier_pct"),
        F.size("empty_columns").alias("empty_count"),
        F.size("constant_columns").alias("constant_count"),
    )
    missing, twice, wild = F.col("missing_pct"), F.col("duplicate_pct"), F.col("outlier_pct")
    empty, constant, pairs = F.col("empty_count"), F.col("constant_count"), F.col("collinear_pairs")
    zero = F.lit(0.0)
    cut_missing = F.least(F.lit(25.0), missing * 0.5)
    cut_twice = F.when(F.col("duplicate_count") > 0, F.least(F.lit(15.0), 3 + twice * 0.5)).otherwise(zero)
    cut_empty = F.least(F.lit(20), empty * 8)
    cut_constant = F.least(F.lit(15), constant * 4)
    cut_wild = F.when(F.col("total_outliers") > 0, F.least(F.lit(10.0), wild * 0.2)).otherwise(zero)
    cut_pairs = F.least(F.lit(10), pairs * 2)
    raw = F.lit(100.0) - cut_missing - cut_twice - cut_empty - cut_constant - cut_wild - cut_pairs
    score = F.greatest(F.lit(LOWEST), raw.cast("int"))
    capped = F.least(score, by_tier(rows, [t[6] for t in TIERS]))
    level = tier(rows)
    explanation = F.when(level == "STANDARD", _steps(SCORE_LEVELS, score)).otherwise(
        by_tier(rows, [TIER_EXPLANATION[t[0]] for t in TIERS])
    )
    reasons = F.array_compact(F.array(
        F.when(missing > 0, F.format_string("Deducted %s points due to %s%% total missingness in the dataset.", plain(cut_missing, 1), plain(missing, 1))),
        F.when(F.col("duplicate_count") > 0, F.format_string("Deducted %s points due to %d duplicate records (%s%%).", plain(cut_twice, 1), "duplicate_count", plain(twice, 1))),
        F.when(empty > 0, F.format_string("Deducted %d points due to empty columns: %s.", cut_empty, F.concat_ws(", ", "empty_columns"))),
        F.when(constant > 0, F.format_string("Deducted %d points due to constant columns offering zero variance: %s.", cut_constant, F.concat_ws(", ", "constant_columns"))),
        F.when(F.col("total_outliers") > 0, F.format_string("Deducted %s points due to presence of %d numerical outliers.", plain(cut_wild, 1), "total_outliers")),
        F.when(pairs > 0, F.format_string("Deducted %d points due to %d highly collinear feature pairs.", cut_pairs, pairs)),
        by_tier(rows, [F.lit(TIER_REASON.get(t[0])).cast("string") for t in TIERS]),
    ))

    def part(deducted: Column) -> Column:
        return F.greatest(F.lit(float(LOWEST)), F.lit(100.0) - deducted).cast("int")

    return with_shares.select(
        "row_count", "column_count", "missing_cells", "duplicate_count", "missing_pct", "duplicate_pct", "outlier_pct",
        capped.alias("score"), explanation.alias("explanation"), reasons.alias("reasons"),
        part(empty * 8 + constant * 4 + F.col("long_names") * 5).alias("structure"),
        part(missing * 1.5 + twice).alias("completeness"),
        part(wild + pairs * 4).alias("consistency"),
        by_tier(rows, [t[7] for t in TIERS]).alias("reliability"),
        by_tier(rows, [t[8] for t in TIERS]).alias("readiness"),
        F.round(F.greatest(F.lit(0.1), capped / 100), 2).alias("confidence"),
        final_status(capped).alias("status"),
    )

"""Report frames: column profiles, test list, before/after comparison and the JSON report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparkgauge.functions.cells import plain
from sparkgauge.operators.cleaning import Operation, apply_operations
from sparkgauge.operators.hypothesis import normality_as_tests
from sparkgauge.plans.findings import executive_summary, findings, risks_opportunities
from sparkgauge.plans.profile import Profile, profile_table
from sparkgauge.plans.recommendations import model_features, model_targets
from sparkgauge.plans.score import quality_score, score_facts
from sparkgauge.plans.texts import METHODOLOGY

def column_profiles(profile: Profile, top_shown: int | None = 5) -> DataFrame:
    """One row per column: schema facts, a line of statistics, outliers, five points of its distribution and ``top_shown`` top values (None: all of the profile's)."""
    top = (
        (profile.top if top_shown is None else profile.top.filter(F.col("rank") <= top_shown))
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count", "percentage"))).alias("categories"))
    )
    numbers = profile.numeric.select("column_name", "mean", "median", "std", "min", "max", "q25", "q75", "outliers_count", "outliers_pct")
    joined = profile.columns.join(F.broadcast(numbers), "column_name", "left").join(F.broadcast(top), "column_name", "left")
    is_number = (F.col("semantic_type") == "numeric") & F.col("mean").isNotNull()
    is_category = F.col("semantic_type").isin("categorical", "boolean") & F.col("categories").isNotNull()
    line = F.format_string(
        "Mean: %s | Median: %s | Std: %s | Min: %s | Max: %s",
        *[F.coalesce(plain(F.col(c), 2), F.lit("0.0")) for c in ("mean", "median", "std", "min", "max")],
    )
    first = F.get("categories", F.lit(0))
    share = F.format_string("Mode: '%s' (%s%%)", first.getField("value"), plain(first.getField("percentage"), 2))
    return joined.select(
        "column_ix", "column_name", "semantic_type", "data_type", "null_count",
        F.col("null_percentage").alias("null_pct"), F.col("unique_values").alias("unique_count"),
        F.when(is_number, line).when(is_category, share).otherwise(F.lit("N/A")).alias("stats_summary"),
        F.coalesce(F.when(is_number, F.col("outliers_count")), F.lit(0)).alias("outlier_count"),
        F.coalesce(F.when(is_number, F.col("outliers_pct")), F.lit(0.0)).alias("outlier_pct"),
        F.when(is_category, F.col("categories")).alias("top_categories"),
        F.when(is_number, F.array("min", "q25", "median", "q75", "max")).otherwise(F.array().cast("array<double>")).alias("histogram"),
    )


def report_tests(profile: Profile) -> DataFrame:
    return profile.tests.unionByName(normality_as_tests(profile.normality))


def before_after(df: DataFrame, operations: Sequence[Operation]) -> DataFrame:
    """(metric, before, after) for rows, columns, missing cells, duplicates and score."""
    cleaned = apply_operations(df, operations)
    sides = []
    for side, table in (("before", df), ("after", cleaned)):
        scores = quality_score(score_facts(profile_table(table)))
        metrics = ["row_count", "column_count", "missing_cells", "duplicate_count", "score"]
        wide = scores.select(*[F.col(m).cast("double").alias(m) for m in metrics])
        sides.append(wide.unpivot([], metrics, "metric", side))
    return reduce(lambda a, b: a.join(F.broadcast(b), "metric"), sides)


def _list(frame: DataFrame, order: Sequence[str], *columns: str) -> DataFrame:
    """A small frame as one array of structs in a given order."""
    keyed = F.struct(F.struct(*order).alias("k"), F.struct(*columns).alias("v"))
    return frame.agg(F.sort_array(F.collect_list(keyed)).getField("v").alias("items"))


def json_report(profile: Profile, filename: str, report_type: str = "technical", history: DataFrame | None = None) -> DataFrame:
    """One row with one JSON text of all results; every part is bounded by the column count."""
    scores = quality_score(score_facts(profile))
    tests = report_tests(profile).withColumn("kind", F.col("test_type"))
    notes = risks_opportunities(profile)
    targets = model_targets(profile.columns, profile.totals)
    parts = {
        "executive_summary": executive_summary(scores).select("summary"),
        "key_findings": _list(findings(profile), ["place"], "finding"),
        "risks": _list(notes.filter("kind = 'risk'"), ["item_ix"], "text"),
        "opportunities": _list(notes.filter("kind = 'opportunity'"), ["item_ix"], "text"),
        "column_profiles": _list(column_profiles(profile), ["column_ix"], "column_name", "semantic_type", "data_type", "null_count", "null_pct", "unique_count", "stats_summary", "outlier_count", "outlier_pct", "top_categories", "histogram"),
        "model_features": _list(model_features(profile.columns), ["column_ix"], "column_name", "semantic_type"),
        "hypothesis_tests": _list(tests, ["kind", "test_name"], "test_name", "test_type", "variables", "statistic", "p_value", "significant", "interpretation"),
        "model_recommendations": _list(targets, ["column_ix", "task"], "column_name", "task", "suggested_models", "reasoning"),
    }
    if history is not None:
        parts["cleaning_history"] = _list(history, ["run_ts"], "run_ts", "operations")
    meta = F.struct(
        F.lit(filename).alias("filename"), F.col("row_count").alias("rows"), F.col("column_count").alias("columns"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.lit(report_type).alias("report_type"),
    )
    quality = F.struct("score", "explanation", "reasons", F.struct("structure", "completeness", "consistency", "reliability", "readiness").alias("components"))
    body = F.struct(
        meta.alias("metadata"), quality.alias("quality"),
        *[part.scalar().alias(name) for name, part in parts.items()],
        F.lit(METHODOLOGY).alias("methodology"),
    )
    return scores.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))

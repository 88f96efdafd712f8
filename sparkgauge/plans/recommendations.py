"""Recommended cleaning operations and model targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparkgauge.functions.cells import contains_any, plain
from sparkgauge.plans.profile import Profile
from sparkgauge.plans.reliability import can_infer, texts
from sparkgauge.plans.reliability import by_tier
from sparkgauge.plans.texts import NO_MODEL, NO_TARGET, TARGET_MODELS, TARGET_WORDS, TIER_ACTIONS, TIER_EXPLANATION, TIERS

MODE_TYPES = ("categorical", "boolean", "identifier")


def _rows(frame: DataFrame, order: int, id_, type_: str, issue, advice, severity, strategy=None, column=None, position=None) -> DataFrame:
    none = F.lit(None).cast("string")
    name = column if column is not None else none
    return frame.select(
        F.lit(order).alias("rule_order"),
        (position if position is not None else F.lit(None).cast("int")).alias("column_ix"),
        id_.alias("id"), F.lit(type_).alias("type"), name.alias("column"),
        issue.alias("issue"), advice.alias("recommendation"), severity.alias("severity"),
        (strategy if strategy is not None else none).alias("default_strategy"),
    )


def cleaning_recommendations(profile: Profile) -> DataFrame:
    """(rule_order, column_ix, id, type, column, issue, recommendation, severity, default_strategy)."""
    totals, schema, name = profile.totals, profile.columns, F.col("column_name")
    place = {"column": name, "position": F.col("column_ix")}
    empty, constant = (totals.select(c).scalar() for c in ("empty_columns", "constant_columns"))
    tagged = schema.select(
        "*", F.array_contains(empty, name).alias("is_empty"), F.array_contains(constant, name).alias("is_constant")
    )
    strategy = F.when(F.col("semantic_type").isin(*MODE_TYPES), "mode").otherwise("median")
    gaps = tagged.filter(~F.col("is_empty") & ~F.col("is_constant") & (F.col("null_count") > 0))
    wild = profile.numeric.filter("outliers_count > 0")
    parts = [
        _rows(totals.filter("duplicate_count > 0"), 1, F.lit("drop_duplicates"), "drop_duplicates",
              F.format_string("The dataset contains %d duplicate rows.", "duplicate_count"),
              F.lit("Remove duplicate records to prevent skewed analysis."), F.lit("medium")),
        _rows(tagged.filter("is_empty"), 2, F.concat(F.lit("drop_empty_"), name), "drop_columns",
              F.format_string("Column '%s' is entirely empty (100%% missing).", name),
              F.format_string("Drop empty column '%s' from the dataset.", name), F.lit("high"), **place),
        _rows(tagged.filter("is_constant"), 3, F.concat(F.lit("drop_constant_"), name), "drop_columns",
              F.format_string("Column '%s' has a constant value across all records.", name),
              F.format_string("Drop constant column '%s' since it provides no variance for analysis.", name), F.lit("low"), **place),
        _rows(gaps, 4, F.concat(F.lit("impute_"), name), "impute_missing",
              F.format_string("Column '%s' has %d missing values (%s%%).", name, "null_count", plain(F.col("null_percentage"), 2)),
              F.format_string("Impute missing values using the %s value.", strategy),
              F.when(F.col("null_percentage") < 30, "medium").otherwise("high"), strategy, **place),
        _rows(wild, 5, F.concat(F.lit("handle_outliers_"), name), "handle_outliers",
              F.format_string("Column '%s' has %d outliers (%s%% of values).", name, "outliers_count", plain(F.col("outliers_pct"), 2)),
              F.lit("Clip outliers to the 1.5x IQR upper and lower bounds."),
              F.when(F.col("outliers_pct") < 5, "low").otherwise("medium"), **place),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def select_recommended_ops(recommendations: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """Chosen recommendations as operation rows; all of them by default."""
    chosen = recommendations if ids is None else recommendations.filter(F.col("id").isin(list(ids)))
    is_drop = F.col("type") == "drop_columns"
    return chosen.select(
        "rule_order", "column_ix", "type", "column",
        F.when(is_drop, F.array("column")).alias("columns"),
        F.when(F.col("type") == "impute_missing", F.col("default_strategy")).alias("strategy"),
    )


def as_operations(rows: DataFrame) -> list[dict]:
    """Operation dicts in rule and column order (a few per column)."""
    operations = []
    for r in rows.orderBy("rule_order", "column_ix").collect():
        op = {"type": r["type"], "column": r["column"]}
        if r["columns"] is not None:
            op["columns"] = list(r["columns"])
        if r["strategy"] is not None:
            op["strategy"] = r["strategy"]
        operations.append(op)
    return operations


def model_features(schema: DataFrame) -> DataFrame:
    return schema.filter(F.col("semantic_type").isin("numeric", "categorical")).select("column_ix", "column_name", "semantic_type")


def _models(task) -> object:
    chosen = F.array().cast("array<string>")
    for name, models in TARGET_MODELS.items():
        chosen = F.when(task == name, F.array(*[F.lit(m) for m in models]).cast("array<string>")).otherwise(chosen)
    return chosen


def model_targets(schema: DataFrame, totals: DataFrame) -> DataFrame:
    """(column_ix, column_name, task, suggested_models, reasoning).

    Target columns when the table is large enough to model; one row without a
    column when none is found or the table is too small.
    """
    name, kind = F.col("column_name"), F.col("semantic_type")
    task = F.when((kind == "numeric") & contains_any(name, TARGET_WORDS["Regression"]), "Regression").when(
        (kind == "categorical") & ((F.col("unique_values") == 2) | contains_any(name, TARGET_WORDS["Classification"])), "Classification"
    )
    found = schema.select("column_ix", "column_name", task.alias("task")).filter(F.col("task").isNotNull())
    rows = F.col("row_count")
    size = totals.select("row_count", can_infer(rows).alias("can_model"))
    able = size.select("can_model").scalar()
    listed = found.filter(able).select("column_ix", "column_name", "task", F.lit(None).cast("string").alias("reasoning"))
    count = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    steps = F.transform(texts(rows, TIER_ACTIONS), lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x))
    why = F.format_string(NO_MODEL, by_tier(rows, [TIER_EXPLANATION[t[0]] for t in TIERS]), F.concat_ws(" ", steps))
    other = size.filter(~F.col("can_model") | (count == 0)).select(
        F.lit(None).cast("int").alias("column_ix"), F.lit(None).cast("string").alias("column_name"),
        F.when(F.col("can_model"), "Clustering / Unsupervised Learning").otherwise("Data Collection / Sample Expansion Required").alias("task"),
        F.when(F.col("can_model"), F.lit(NO_TARGET)).otherwise(why).alias("reasoning"),
    )
    return listed.unionByName(other).select("column_ix", "column_name", "task", _models(F.col("task")).alias("suggested_models"), "reasoning")

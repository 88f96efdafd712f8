"""The numeric profile and the bundle of facts all rules read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from sparkgauge.operators.correlation import COLLINEAR, STRONG, correlated_pairs, multicollinearity, strong_correlations
from sparkgauge.operators.duplicates import duplicate_count
from sparkgauge.operators.frequencies import numeric_value_facts, top_values, value_facts
from sparkgauge.operators.grouped import MAX_CATEGORIES
from sparkgauge.operators.heavy import count_values
from sparkgauge.operators.hypothesis import hypothesis_tests, normality
from sparkgauge.operators.moments import column_moments
from sparkgauge.operators.outliers import iqr_outliers
from sparkgauge.operators.quantiles import quantile_values
from sparkgauge.operators.shape import column_list, numeric_columns, other_columns
from sparkgauge.plans.semantics import schema_profile
from sparkgauge.session import at_once, pin, small_frame

PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)
NUMERIC_SCHEMA = "column_name string, p5 double, q25 double, median double, q75 double, p95 double"
NO_NUMERIC_SCHEMA = (
    "column_name string, n bigint, outliers_count bigint, outliers_share double, outliers_pct double, mean double, median double, "
    "std double, min double, max double, skewness double, kurtosis double"
)
NO_NORMALITY_SCHEMA = "column_name string, n bigint, statistic double, p_value double, is_normal boolean, reason string, test_name string"
TOP_SCHEMA = "column_name string, rank int, value string, count bigint, percentage double"


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    quantiles: dict[str, list[float]] | None = None,
    moments: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """One row per numeric column with a value: counts, moments, mode, percentiles and outliers."""
    chosen = list(columns) if columns is not None else numeric_columns(df)
    if quantiles is None:
        quantiles, moments, facts = at_once(
            lambda: quantile_values(df, PROBABILITIES, chosen),
            lambda: pin(column_moments(df, chosen)),
            lambda: pin(numeric_value_facts(df, chosen)),
        )
    else:
        facts = facts if facts is not None else numeric_value_facts(df, chosen)
        moments = moments if moments is not None else column_moments(df, chosen)
    marks = small_frame(df.sparkSession, [(c, *v) for c, v in quantiles.items()], NUMERIC_SCHEMA)
    outliers = iqr_outliers(df, chosen, {c: [v[1], v[3]] for c, v in quantiles.items()})
    joined = (
        moments.join(F.broadcast(marks), "column_name")
        .join(outliers.select("column_name", "outliers_count", "outliers_share", "outliers_pct"), "column_name")
        .join(facts.select("column_name", "distinct_count", "mode"), "column_name")
    )
    return joined.select(
        "column_name", "row_count", "n", (F.col("row_count") - F.col("n")).alias("null_count"), "distinct_count",
        "mean", "median", "mode", "variance", "std", "min", "max", "skewness", "kurtosis",
        "p5", "q25", "q75", "p95", "outliers_count", "outliers_share", "outliers_pct",
    )


@dataclass
class Profile:
    """Everything the rules need, as small frames (a few rows per column or column pair).

    The hypothesis tests are worked out when they are first asked for, and then kept.
    """

    totals: DataFrame  # one row
    columns: DataFrame
    numeric: DataFrame
    top: DataFrame
    strong: DataFrame
    collinear: DataFrame
    normality: DataFrame
    run_tests: Callable[[], DataFrame]

    @cached_property
    def tests(self) -> DataFrame:
        return self.run_tests()


def table_totals(schema: DataFrame, duplicates: DataFrame, constants: Sequence[str], rows: int) -> DataFrame:
    """(row_count, column_count, missing_cells, duplicate_count, empty and constant columns) in one row."""
    name = F.col("column_name")
    empty = (F.col("null_count") == rows) & F.lit(rows > 0)
    constant = name.isin(list(constants)) if constants else F.lit(False)
    ordered = F.sort_array(F.collect_list(F.when(empty, F.struct("column_ix", "column_name"))))
    single = F.sort_array(F.collect_list(F.when(constant & ~empty, F.struct("column_ix", "column_name"))))
    counts = schema.agg(
        F.lit(rows).cast("bigint").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("missing_cells"),
        F.count_if(F.char_length(name) > 100).alias("long_names"),
        ordered.getField("column_name").alias("empty_columns"), single.getField("column_name").alias("constant_columns"),
    )
    return counts.select("*", F.lit(duplicates.first()["duplicate_count"]).cast("bigint").alias("duplicate_count"))


def profile_table(df: DataFrame, most_tests: int | None = None, exact: bool = True) -> Profile:
    """Profile a table of any size.

    Each statistic is one scan over the columns it needs, and independent ones
    run at the same time. What comes back is pinned, so that the rules on top of it do not read the table again.
    """
    spark = df.sparkSession
    nums, others = numeric_columns(df), other_columns(df)
    # One count of values feeds value facts, modes, top values and the choice of category columns.
    counted, numbers, duplicates, moments, quantiles = at_once(
        lambda: count_values(df, others),
        lambda: pin(numeric_value_facts(df, nums)) if nums else None,
        lambda: pin(duplicate_count(df)),
        lambda: pin(column_moments(df, nums)) if nums else None,
        lambda: quantile_values(df, PROBABILITIES, nums),
    )
    schema, top = at_once(
        lambda: pin(schema_profile(df, exact, value_facts(df, None, counted, numbers) if exact and df.columns else None)),
        lambda: pin(top_values(df, others, counted=counted)) if others else small_frame(spark, [], TOP_SCHEMA),
    )
    rows = duplicates.first()["row_count"]
    unique = {r["column_name"]: r["unique_values"] for r in schema.select("column_name", "unique_values").collect()}
    constants = [c for c, k in unique.items() if k == 1]
    few = {c: unique[c] for c in others if 2 <= unique[c] <= MAX_CATEGORIES}
    present = list(quantiles)
    if present:
        varying = moments.filter("variance > 0").select("column_name", "mean").collect()
        means = {r["column_name"]: r["mean"] for r in varying}
        medians = {c: [v[2]] for c, v in quantiles.items()}
        numeric, pairs, normal = at_once(
            lambda: pin(numeric_profile(df, present, quantiles, moments.filter(F.col("n") > 0), numbers)),
            lambda: pin(correlated_pairs(df, None, medians, {c: means[c] for c in nums if c in means}, min(STRONG, COLLINEAR))),
            lambda: pin(normality(df, present, moments)),
        )
    else:
        numeric = small_frame(spark, [], NO_NUMERIC_SCHEMA)
        pairs = correlated_pairs(df, [], {}, {})
        normal = small_frame(spark, [], NO_NORMALITY_SCHEMA)
    order = column_list(df).select("column_ix", "column_name")
    return Profile(
        totals=pin(table_totals(schema, duplicates, constants, rows)),
        columns=schema,
        numeric=pin(numeric.join(F.broadcast(order), "column_name")),
        top=top,
        strong=pin(strong_correlations(df, pairs=pairs)),
        collinear=pin(multicollinearity(df, pairs=pairs)),
        normality=pin(normal.join(F.broadcast(order), "column_name")),
        run_tests=lambda: pin(hypothesis_tests(df, most_tests, few if exact else None)),
    )

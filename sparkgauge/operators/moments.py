"""Mean, spread, extremes and shape of every numeric column in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.functions.cells import finite_or_null
from sparkgauge.operators.shape import numeric_columns, numeric_long


def shape_or_zero(c: Column, n: Column) -> Column:
    """Skewness and kurtosis read 0 below three values and where they are not finite."""
    return F.coalesce(F.when(n >= 3, finite_or_null(c)), F.lit(0.0))


def column_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column; columns without a value are kept with n = 0.

    Variance and standard deviation are the sample ones, skewness and excess
    kurtosis the population ones.
    """
    chosen = list(columns) if columns is not None else numeric_columns(df)
    v = F.col("value")
    sums = (
        numeric_long(df, chosen)
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.var_samp(v).alias("variance"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.skewness(v).alias("skewness"),
            F.kurtosis(v).alias("kurtosis"),
        )
    )
    n = F.col("n")
    # A single repeated value has no spread; running sums can leave a trace of rounding.
    flat = F.col("min") == F.col("max")
    variance = F.when(flat & (n > 1), F.lit(0.0)).otherwise(finite_or_null(F.col("variance")))
    return sums.select(
        "column_name",
        "row_count",
        "n",
        finite_or_null(F.col("mean")).alias("mean"),
        variance.alias("variance"),
        F.sqrt(variance).alias("std"),
        finite_or_null(F.col("min")).alias("min"),
        finite_or_null(F.col("max")).alias("max"),
        F.when(flat, F.lit(0.0)).otherwise(shape_or_zero(F.col("skewness"), n)).alias("skewness"),
        F.when(flat, F.lit(0.0)).otherwise(shape_or_zero(F.col("kurtosis"), n)).alias("kurtosis"),
    )

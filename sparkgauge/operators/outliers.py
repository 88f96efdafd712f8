"""Outlier fences from the quartiles and what lies outside them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkgauge.operators.quantiles import quantile_values
from sparkgauge.operators.shape import as_double, fields, numeric_columns
from sparkgauge.session import small_frame

REACH = 1.5
FENCE_SCHEMA = "column_name string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double"


def fence_values(quartiles: dict[str, list[float]]) -> dict[str, tuple[float, float]]:
    return {c: (q1 - REACH * (q3 - q1), q3 + REACH * (q3 - q1)) for c, (q1, q3) in quartiles.items()}


def fences(df: DataFrame, columns: Sequence[str] | None = None, quartiles: dict[str, list[float]] | None = None) -> DataFrame:
    if quartiles is None:
        quartiles = quantile_values(df, (0.25, 0.75), columns)
    bounds = fence_values(quartiles)
    rows = [(c, q1, q3, q3 - q1, *bounds[c]) for c, (q1, q3) in quartiles.items()]
    return small_frame(df.sparkSession, rows, FENCE_SCHEMA)


def beyond_fences(df: DataFrame, columns: Sequence[str] | None = None, quartiles: dict[str, list[float]] | None = None) -> DataFrame:
    """Per column: values under and over the fence, counted by whole Arrow batches in one scan; a row for each column and task meets."""
    chosen = list(columns) if columns is not None else numeric_columns(df)
    bounds = fences(df, chosen, quartiles)
    ends = {r["column_name"]: (r["lower_bound"], r["upper_bound"]) for r in bounds.collect()}
    names = [c for c in chosen if c in ends]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(names), 3), np.int64)
        for batch in batches:
            for i, (name, column) in enumerate(zip(names, batch.columns)):
                values, (low, high) = column.drop_null().to_numpy(zero_copy_only=False), ends[name]
                # A bound that is no number (infinite quartiles) is above all values.
                seen[i] += (len(values), len(values) if np.isnan(low) else (values < low).sum(), (values > high).sum())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(x) for x in seen.T]], ["column_name", "n", "below_count", "above_count"])

    schema = "column_name string, n bigint, below_count bigint, above_count bigint"
    if not names:
        return bounds.join(small_frame(df.sparkSession, [], schema), "column_name").select(*bounds.columns, "n", "below_count", "above_count")
    wide = df.select(*[as_double(f).alias(f"v{i}") for i, f in enumerate(fields(df, names))])
    counted = wide.mapInArrow(count, schema).groupBy("column_name").agg(*[F.sum(c).alias(c) for c in ("n", "below_count", "above_count")])
    return counted.filter("n > 0").join(F.broadcast(bounds), "column_name").select(*bounds.columns, "n", "below_count", "above_count")


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, quartiles: dict[str, list[float]] | None = None) -> DataFrame:
    count = F.col("below_count") + F.col("above_count")
    return beyond_fences(df, columns, quartiles).select(
        "column_name",
        "n",
        "q1",
        "q3",
        "lower_bound",
        "upper_bound",
        count.alias("outliers_count"),
        (count / F.col("n") * 100).alias("outliers_share"),
        F.round(count / F.col("n") * 100, 2).alias("outliers_pct"),
    )


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value lies outside the fence of its column."""
    bounds = fence_values(quantile_values(df, (0.25, 0.75), [column]))
    if column not in bounds:
        return df.limit(0)
    low, high = bounds[column]
    value = as_double(fields(df, [column])[0])
    return df.filter((value < low) | (value > high))

"""Counts per table and per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from sparkgauge.functions.cells import col_of, has_letter_or_digit, is_blank, is_infinite, to_number
from sparkgauge.operators.shape import (
    FRACTIONAL,
    as_text,
    fields,
    infinities_to_nulls,
    long_form,
    nans_to_nulls,
    numeric_columns,
    numeric_long,
    string_columns,
    text_long,
)
from sparkgauge.session import small_frame


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, row_count, null_count, null_percentage) in one scan.

    The wide aggregate holds one counter per column, so it stays compiled; its
    single row is then turned to one row per column.
    """
    clean = nans_to_nulls(df)
    present = clean.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(col_of(c)).alias(c) for c in clean.columns],
    )
    long = present.unpivot([col_of("__rows")], [col_of(c) for c in clean.columns], "column_name", "present")
    nulls = F.col("__rows") - F.col("present")
    return long.select(
        "column_name",
        F.col("__rows").alias("row_count"),
        nulls.alias("null_count"),
        F.when(F.col("__rows") > 0, nulls / F.col("__rows") * 100).otherwise(F.lit(0.0)).alias("null_percentage"),
    )


def empty_columns(df: DataFrame) -> DataFrame:
    counts = null_counts(df)
    return counts.filter((F.col("row_count") > 0) & (F.col("null_count") == F.col("row_count"))).select("column_name")


def extremes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, low, high) as text; equal ends mean a constant column.

    Ends are compared in the column's own type before they are shown as text.
    """
    chosen = [f for f in fields(df, columns) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    clean = nans_to_nulls(df)
    wide = clean.agg(
        *[F.min(col_of(f.name)).alias(f"lo{i}") for i, f in enumerate(chosen)],
        *[F.max(col_of(f.name)).alias(f"hi{i}") for i, f in enumerate(chosen)],
    )
    cells = []
    for i, f in enumerate(chosen):
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        text = as_text(T.StructField(f"lo{i}", f.dataType))
        cells.append(F.struct(F.lit(f.name).alias("column_name"), text.alias("value"), (low == high).alias("same")))
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct non-null value, and that value."""
    return extremes(df).filter("same").select("column_name", F.col("value").alias("constant_value"))


def constant_not_empty(df: DataFrame) -> DataFrame:
    """Constant columns that are not empty columns."""
    return constant_columns(df).join(F.broadcast(empty_columns(df)), "column_name", "left_anti")


def infinite_counts(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)]
    if not floats:
        return small_frame(df.sparkSession, [], "column_name string, row_count bigint, infinity_count bigint")
    return (
        numeric_long(df, floats)
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("row_count"), F.count_if(is_infinite(F.col("value"))).alias("infinity_count"))
    )


def text_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per string column: present, blank and numeric-looking values and the mean length."""
    chosen = columns if columns is not None else string_columns(df)
    value = F.col("value")
    return (
        text_long(df, chosen)
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count(value).alias("present"),
            F.count_if(is_blank(value)).alias("blank_count"),
            F.count(to_number(value)).alias("numeric_count"),
            F.avg(F.char_length(value)).alias("avg_length"),
        )
    )


def blank_string_counts(df: DataFrame) -> DataFrame:
    return text_facts(df).select("column_name", "row_count", "blank_count")


def avg_string_length(df: DataFrame) -> DataFrame:
    return text_facts(df).select("column_name", "avg_length")


def all_null_table(df: DataFrame) -> DataFrame:
    """One row: whether the table has rows and every cell is null."""
    facts = null_counts(df).agg(
        F.max("row_count").alias("row_count"), F.sum(F.col("row_count") - F.col("null_count")).alias("present_cells")
    )
    return facts.select("row_count", "present_cells", ((F.col("row_count") > 0) & (F.col("present_cells") == 0)).alias("all_null"))


def letterless_values(df: DataFrame, column: str) -> DataFrame:
    """How many values of a text column hold no letter and no digit of any script."""
    c = col_of(column)
    return df.agg(F.count(c).alias("present"), F.count_if(~has_letter_or_digit(c)).alias("letterless"))


def validation_copy(df: DataFrame) -> DataFrame:
    """NaN and infinities both as null: what validation measures run on."""
    return infinities_to_nulls(nans_to_nulls(df))



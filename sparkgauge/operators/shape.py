"""Column families and the long form (column_name, value) most statistics run on.

The long form keeps one set of aggregates for all columns. A wide ``agg`` with
several moments per column grows past what whole-stage code generation compiles
and falls back to interpretation; the grouped long form stays compiled, is
combined before the shuffle and moves one row per column and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkgauge.functions.cells import col_of, nan_to_null
from sparkgauge.session import small_frame

FRACTIONAL = (T.DoubleType, T.FloatType)
DATETIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def fields(df: DataFrame, columns: Sequence[str] | None = None) -> list[T.StructField]:
    by_name = {f.name: f for f in df.schema.fields}
    return [by_name[c] for c in (columns if columns is not None else df.columns)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def select_by_type(df: DataFrame, numeric: bool) -> DataFrame:
    names = numeric_columns(df) if numeric else other_columns(df)
    return df.select(*[col_of(c) for c in names])


def nans_to_nulls(df: DataFrame) -> DataFrame:
    """One missing marker: NaN in fractional columns becomes null."""
    return df.select(
        *[
            nan_to_null(col_of(f.name)).alias(f.name) if isinstance(f.dataType, FRACTIONAL) else col_of(f.name)
            for f in df.schema.fields
        ]
    )


def infinities_to_nulls(df: DataFrame) -> DataFrame:
    """The validator's copy: infinite values count as missing."""
    from sparkgauge.functions.cells import inf_to_null

    return df.select(
        *[
            inf_to_null(col_of(f.name)).alias(f.name) if isinstance(f.dataType, FRACTIONAL) else col_of(f.name)
            for f in df.schema.fields
        ]
    )


def as_double(field: T.StructField) -> Column:
    c = col_of(field.name)
    if isinstance(field.dataType, FRACTIONAL):
        return nan_to_null(c.cast("double"))
    return c.cast("double")


def as_text(field: T.StructField) -> Column:
    c = col_of(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(field.dataType, FRACTIONAL):
        return nan_to_null(c).cast("string")
    return c.cast("string")


def long_form(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Unpivot the given expressions to (column_name, value)."""
    narrow = df.select(*[c.alias(name) for name, c in values.items()])
    names = [col_of(name) for name in values]
    return narrow.unpivot([], names, "column_name", "value")


def numeric_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = columns if columns is not None else numeric_columns(df)
    return long_form(df, {f.name: as_double(f) for f in fields(df, chosen)})


def text_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = columns if columns is not None else other_columns(df)
    return long_form(df, {f.name: as_text(f) for f in fields(df, chosen)})


def column_list(df: DataFrame) -> DataFrame:
    """(column_ix, column_name, data_type) in table order."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return small_frame(df.sparkSession, rows, "column_ix int, column_name string, data_type string")

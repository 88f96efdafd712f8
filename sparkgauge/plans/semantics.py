"""Semantic type of every column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from sparkgauge.functions.cells import boolean_mask, is_datetime_text
from sparkgauge.operators.counts import null_counts
from sparkgauge.operators.frequencies import distinct_counts, value_facts
from sparkgauge.operators.shape import DATETIMES, column_list, numeric_long, text_long
from sparkgauge.session import small_frame

TEXT_LENGTH = 50
IDENTIFIER_RATIO = 0.90


def _families(df: DataFrame) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {"numeric": [], "boolean": [], "datetime": [], "text": []}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            groups["numeric"].append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            groups["boolean"].append(f.name)
        elif isinstance(f.dataType, DATETIMES):
            groups["datetime"].append(f.name)
        else:
            groups["text"].append(f.name)
    return groups


def _sketched_facts(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """The same facts without shuffling distinct values: sketched counts, tests on every row."""
    counts = distinct_counts(df, exact=False).drop("row_count").join(null_counts(df).drop("null_percentage"), "column_name")
    v = F.col("value")
    parts = []
    if groups["text"]:
        parts.append(text_long(df, groups["text"]).groupBy("column_name").agg(
            F.avg(F.char_length(v)).alias("avg_length"), is_datetime_text(v).alias("all_dates"),
            (F.coalesce(F.bit_and(F.when(v.isNotNull(), boolean_mask(v))), F.lit(0)) != 0).alias("boolean_pair"),
        ))
    if groups["numeric"]:
        pair = F.coalesce((F.min(v) == 0) & (F.max(v) == 1), F.lit(False))
        parts.append(numeric_long(df, groups["numeric"]).groupBy("column_name").agg(
            F.lit(None).cast("double").alias("avg_length"), F.lit(False).alias("all_dates"), pair.alias("boolean_pair")
        ))
    tests = parts[0] if parts else small_frame(df.sparkSession, [], "column_name string, avg_length double, all_dates boolean, boolean_pair boolean")
    for part in parts[1:]:
        tests = tests.unionByName(part)
    return counts.join(tests, "column_name", "left")


def schema_profile(df: DataFrame, exact: bool = True, facts: DataFrame | None = None) -> DataFrame:
    """(column_ix, column_name, data_type, semantic_type, unique_values, null_count, null_percentage); ``facts`` are the value facts if there already."""
    groups = _families(df)
    name = F.col("column_name")

    def within(family: str):
        return name.isin(groups[family]) if groups[family] else F.lit(False)

    unique, rows = F.coalesce("distinct_count", F.lit(0)), F.coalesce("row_count", F.lit(0))
    kind = (
        F.when(rows == 0, "categorical")
        .when(within("datetime") | F.coalesce("all_dates", F.lit(False)), "datetime")
        .when(within("boolean") | ((unique == 2) & F.coalesce("boolean_pair", F.lit(False))), "boolean")
        .when(within("numeric"), "numeric")
        .when(F.coalesce("avg_length", F.lit(0.0)) > TEXT_LENGTH, "text")
        .when(unique / rows > IDENTIFIER_RATIO, "identifier")
        .otherwise("categorical")
    )
    if facts is None:
        facts = value_facts(df) if exact else _sketched_facts(df, groups)
    joined = column_list(df).join(facts, "column_name", "left")
    return joined.select(
        "column_ix", "column_name", "data_type", kind.alias("semantic_type"),
        unique.alias("unique_values"),
        F.coalesce("null_count", F.lit(0)).alias("null_count"),
        F.round(F.coalesce(F.col("null_count") / rows * 100, F.lit(0.0)), 2).alias("null_percentage"),
    )

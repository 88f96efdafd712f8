"""Value frequencies: distinct counts, modes and most frequent values.

Numbers are counted in their own type by one (column, value, n) aggregate for each type,
which distinct counts and modes share. Texts and all else go through the sketches of
``heavy``: one scan, and no value in a shuffle but those of columns with very many, as hashes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkgauge.functions.cells import nan_to_null
from sparkgauge.operators import heavy
from sparkgauge.operators.shape import FRACTIONAL, as_double, as_text, col_of, fields, long_form, numeric_columns, other_columns
from sparkgauge.session import at_once, pin, small_frame


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(column_name, row_count, distinct_count) of non-null values.

    ``exact=False`` reads a mergeable sketch of fixed size per column and counts nothing in full.
    """
    chosen = list(columns) if columns is not None else df.columns
    if exact:
        numbers, counted = _counts(df, chosen)
        parts = [] if numbers is None else [numbers.select("column_name", "row_count", "distinct_count").filter("row_count > 0")]
        if counted is not None:
            sizes = small_frame(df.sparkSession, [(c, t["rows"]) for c, t in counted.totals.items() if t["rows"]], "column_name string, row_count bigint")
            found = sizes.join(F.broadcast(heavy.distinct(counted)), "column_name", "left")
            parts.append(found.select("column_name", "row_count", F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count")))
        return reduce(DataFrame.unionByName, parts)
    values = {f.name: nan_to_null(col_of(f.name)).cast("string") if isinstance(f.dataType, FRACTIONAL) else as_text(f) for f in fields(df, chosen)}
    return long_form(df, values).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col("value"), 14)).alias("distinct_count"))


def _counts(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame | None, heavy.Counted | None]:
    """The numeric value facts and the counted values of the other columns, worked out at the same time."""
    nums, others = ([c for c in names(df) if c in set(columns)] for names in (numeric_columns, other_columns))
    if nums and others:
        return tuple(at_once(lambda: pin(numeric_value_facts(df, nums)), lambda: heavy.count_values(df, others)))
    return numeric_value_facts(df, nums) if nums else None, heavy.count_values(df, others) if others else None


def value_facts(df: DataFrame, columns: Sequence[str] | None = None, counted: heavy.Counted | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """All value facts of the columns.

    (column_name, row_count, null_count, distinct_count, avg_length, all_dates, boolean_pair).
    ``counted`` and ``numbers`` are those of ``heavy.count_values`` and ``numeric_value_facts`` if they are there already.
    """
    if numbers is None and counted is None:
        numbers, counted = _counts(df, columns if columns is not None else df.columns)
    parts = []
    if numbers is not None:
        parts.append(numbers.select("column_name", "row_count", "null_count", "distinct_count", F.lit(None).cast("double").alias("avg_length"),
                                    F.lit(False).alias("all_dates"), "boolean_pair").filter("row_count > 0"))
    if counted is not None:
        parts.append(heavy.text_facts(counted))
    return reduce(DataFrame.unionByName, parts)


def unique_ratio(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    ratio = F.col("distinct_count") / F.col("row_count")
    return distinct_counts(df, columns, exact).select(
        "column_name",
        "distinct_count",
        "row_count",
        ratio.alias("unique_ratio"),
        F.round(ratio * 100, 1).alias("unique_percentage"),
    )


def numeric_value_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, row_count, null_count, distinct_count, boolean_pair, mode, mode_text, mode_count); the smallest value wins a tie.

    Values are counted and compared in their own type: integers as bigint, decimals in
    their scale. ``mode`` is the mode as a double, ``mode_text`` the exact value; both are null without a value.
    """
    chosen = list(columns) if columns is not None else numeric_columns(df)
    kinds: dict[str, list[T.StructField]] = {}
    for f in fields(df, chosen):
        own = f.dataType.simpleString() if isinstance(f.dataType, T.DecimalType) else "bigint" if isinstance(f.dataType, T.IntegralType) else "double"
        kinds.setdefault(own, []).append(f)
    parts = []
    for kind, group in kinds.items():
        long = long_form(df, {f.name: as_double(f) if kind == "double" else col_of(f.name).cast(kind) for f in group})
        freq = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        v, n, times = F.col("value"), F.col("n"), F.col("times")
        # Values with equal counts become one row first, by sums and extremes of fixed width, which need no sort.
        alike = freq.groupBy("column_name", n, v.isNull().alias("missing")).agg(F.count(F.lit(1)).alias("times"), F.min(v).alias("low"), F.max(v).alias("high"))
        # Greatest count first, then the smallest value; only the count is negated.
        best = F.min(F.when(~F.col("missing"), F.struct((-n).alias("fewer"), F.col("low").alias("value")))).alias("best")
        facts = alike.groupBy("column_name").agg(
            F.sum(n * times).alias("row_count"), F.coalesce(F.sum(F.when(F.col("missing"), n)), F.lit(0)).alias("null_count"),
            F.coalesce(F.sum(F.when(~F.col("missing"), times)), F.lit(0)).alias("distinct_count"),
            F.coalesce((F.min("low") == 0) & (F.max("high") == 1), F.lit(False)).alias("boolean_pair"), best)
        mode = F.col("best.value")
        parts.append(facts.select("column_name", "row_count", "null_count", "distinct_count", "boolean_pair", (mode.cast("double") + F.lit(0.0)).alias("mode"),
                                  mode.cast("string").alias("mode_text"), (-F.col("best.fewer")).alias("mode_count")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def numeric_modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return numeric_value_facts(df, columns).filter("mode_count is not null").select("column_name", "mode", "mode_text", "mode_count")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. Spark cuts each map partition to k rows before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10, counted: heavy.Counted | None = None) -> DataFrame:
    """(column_name, rank, value, count, percentage of all rows); ties in ascending value order (see ``heavy``)."""
    return heavy.top_values(df, list(columns) if columns is not None else other_columns(df), k, counted)


def text_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return top_values(df, columns, 1).select("column_name", F.col("value").alias("mode"), "count")

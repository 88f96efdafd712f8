"""Statistics per category: group sizes, means, variances and contingency counts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge.operators import heavy
from sparkgauge.operators.joint import joint_counts, joint_moments
from sparkgauge.operators.shape import as_double, as_text, fields, numeric_columns, other_columns
from sparkgauge.session import small_frame

MAX_CATEGORIES = 10


def category_columns(df: DataFrame, columns: Sequence[str] | None = None, most: int = MAX_CATEGORIES) -> dict[str, int]:
    """Non-numeric columns with 2 to ``most`` values, and their distinct counts; one scan, in which no value is shuffled."""
    chosen = list(columns) if columns is not None else other_columns(df)
    sizes = heavy.count_values(df, chosen).sizes()
    return {c: sizes[c] for c in chosen if 2 <= sizes.get(c, 0) <= most}


def group_summaries(df: DataFrame, categories: Sequence[str], numerics: Sequence[str] | None = None) -> DataFrame:
    """(category, category_value, column_name, n, mean, variance) for all pairs in one scan.

    A task sends one row per group and numeric column on, however the rows spread over the groups.
    """
    nums = list(numerics) if numerics is not None else numeric_columns(df)
    schema = "category string, category_value string, column_name string, n bigint, mean double, variance double"
    if not categories or not nums:
        return small_frame(df.sparkSession, [], schema)
    narrow = df.select(
        *[as_text(f).alias(f"g{i}") for i, f in enumerate(fields(df, categories))],
        *[as_double(f).alias(f"n{i}") for i, f in enumerate(fields(df, nums))],
    )
    found = joint_moments(narrow, len(nums))
    return found.select(_named(categories, "category_ix").alias("category"), "category_value", _named(nums, "column_ix").alias("column_name"), "n", "mean", "variance")


def crosstab(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(var1, var2, value1, value2, n): contingency counts of column pairs, null pairs dropped, all pairs in one scan."""
    if not pairs:
        return small_frame(df.sparkSession, [], "var1 string, var2 string, value1 string, value2 string, n bigint")
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    narrow = df.select(*[as_text(f).alias(f"c{i}") for i, f in enumerate(fields(df, names))])
    found = joint_counts(narrow, [(names.index(a), names.index(b)) for a, b in pairs])
    return found.select(_named([a for a, _ in pairs], "pair_ix").alias("var1"), _named([b for _, b in pairs], "pair_ix").alias("var2"), "value1", "value2", "n")


def _named(names: Sequence[str], place: str) -> Column:
    return F.get(F.lit(list(names)), F.col(place))


def margins(table: DataFrame) -> DataFrame:
    """Contingency cells with row, column and table totals (a few cells per column pair)."""
    pair = ["var1", "var2"]
    n = F.col("n")
    return table.select(
        "*",
        F.sum(n).over(Window.partitionBy(*pair, "value1")).alias("row_total"),
        F.sum(n).over(Window.partitionBy(*pair, "value2")).alias("column_total"),
        F.sum(n).over(Window.partitionBy(*pair)).alias("total"),
    )


def category_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(names, 2))

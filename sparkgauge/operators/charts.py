"""Chart series as long frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from sparkgauge.functions.cells import col_of, finite_or_null, one_decimal, period_label, sqrt_bins, to_timestamp
from sparkgauge.operators.frequencies import distinct_counts, top_values
from sparkgauge.operators.shape import as_double, fields, long_form, numeric_columns
from sparkgauge.session import pin, small_frame

ROUGHLY_FEW = 100
SCATTER_SEED = 42
MONTHS_FROM_DAYS = 730
WEEKS_FROM_DAYS = 60


def _few_distinct(long_columns: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts of the columns a sketch does not put far above any bin count."""
    rough = distinct_counts(long_columns, names, exact=False).filter(F.col("distinct_count") <= ROUGHLY_FEW)
    few = [r["column_name"] for r in rough.select("column_name").collect()]
    if not few:
        return {}
    return {r["column_name"]: r["distinct_count"] for r in distinct_counts(long_columns, few).collect()}


def histogram(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, bin, lower, upper, label, count) with equal-width bins, empty ones included.

    The last bin is closed. A value that the division puts one bin off is moved
    by comparing it with the bin edges themselves.
    """
    chosen = list(columns) if columns is not None else numeric_columns(df)
    finite = df.select(*[finite_or_null(as_double(f)).alias(f.name) for f in fields(df, chosen)])
    distinct = _few_distinct(finite, chosen)
    v = F.col("value")
    long = long_form(finite, {c: col_of(c) for c in chosen}).filter(v.isNotNull())
    known = small_frame(
        df.sparkSession, [(c, distinct.get(c)) for c in chosen], "column_name string, distinct_count bigint"
    )
    ends = long.groupBy("column_name").agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    layout = ends.join(F.broadcast(known), "column_name").select(
        "column_name",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        sqrt_bins(F.col("n"), F.col("distinct_count")).alias("bins"),
    )
    layout = pin(layout)
    lo, hi, bins = F.col("lo"), F.col("hi"), F.col("bins")
    step = (hi - lo) / bins

    def edge(i):
        return F.when(i == bins, hi).otherwise(lo + i * step)

    first = F.least(F.floor((v - lo) / (hi - lo) * bins).cast("int"), bins - 1)
    placed = long.join(F.broadcast(layout), "column_name").withColumn("first", first)
    at = F.col("first")
    shift = F.when(v < edge(at), -1).when((at < bins - 1) & (v >= edge(at + 1)), 1).otherwise(0)
    counted = placed.groupBy("column_name", (at + shift).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = layout.select("*", F.explode(F.sequence(F.lit(0), bins - 1)).alias("bin"))
    lower, upper = edge(F.col("bin")), edge(F.col("bin") + 1)
    return every.join(F.broadcast(counted), ["column_name", "bin"], "left").select(
        "column_name", "bin", lower.alias("lower"), upper.alias("upper"),
        F.concat_ws(" - ", one_decimal(lower), one_decimal(upper)).alias("label"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def _as_moment(df: DataFrame, column: str):
    c = col_of(column)
    kind = fields(df, [column])[0].dataType
    return to_timestamp(c) if isinstance(kind, T.StringType) else c


def time_unit(days: int) -> str:
    """Bucket size for a span of days."""
    if days > MONTHS_FROM_DAYS:
        return "month"
    return "week" if days > WEEKS_FROM_DAYS else "day"


def time_bucket_mean(df: DataFrame, date_column: str, value_column: str, raw_points: int = 0, unit: str | None = None) -> DataFrame:
    """(date, value): mean per month, week or day, as ``unit`` says or else by the span of the dates.

    A series of at most ``raw_points`` points (default: none) comes as it is, in date order.
    """
    from sparkgauge.functions.cells import day_span

    value = as_double(fields(df, [value_column])[0])
    points = df.select(_as_moment(df, date_column).alias("ts"), value.alias("v")).na.drop()
    size = points.agg(F.count(F.lit(1)).alias("n"), day_span(F.col("ts")).alias("days")).first()
    unit = unit or time_unit(size["days"] or 0)
    if size["n"] <= raw_points:
        series = points.select("ts", F.date_format("ts", "yyyy-MM-dd").alias("date"), finite_or_null(F.col("v")).alias("value"))
        return series.filter(F.col("value").isNotNull()).orderBy("ts", "value").select("date", "value")
    means = points.groupBy(period_label(F.col("ts"), unit).alias("date")).agg(finite_or_null(F.avg("v")).alias("value"))
    return means.filter(F.col("value").isNotNull()).orderBy("date")


def scatter_sample(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), points: int | None = None, seed: int = SCATTER_SEED
) -> DataFrame:
    """(x, y) of all complete rows, or of a sample of ``points`` in the order of a hash of keys and seed.

    For the sample each task keeps its own first points, so no task sees more than that many
    rows of another. ``keys`` should tell rows apart; without them the values do.
    """
    chosen = fields(df, [x, y])
    named = [col_of(k).cast("string") for k in (keys or (x, y))]
    rows = df.select(
        *[finite_or_null(as_double(f)).alias(n) for f, n in zip(chosen, ("x", "y"))],
        F.md5(F.concat_ws("|", *named, F.lit(str(seed)))).alias("place"),
    ).na.drop(subset=["x", "y"])
    return (rows if points is None else rows.orderBy("place", "x", "y").limit(points)).select("x", "y")


def bars(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    return top_values(df, columns, k).select("column_name", "rank", F.col("value").alias("category"), "count")

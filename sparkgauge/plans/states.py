"""Profile states of the parts of a table, which merge to the profile of the whole.

A part (a day, a cleaned partition) is scanned once. Its state has a row for each column:
counts, the first four moments, extremes, sketches of distinct values (HLL) and of
quantiles (KLL), and the counts of its most frequent values with what they may miss. States
are of bounded size whatever the part's. The store keeps all states ever written and the
latest one of each part and column counts, so a new part or one written anew costs its own
scan only, and no other is read again.

Counts, extremes and, to rounding, moments of merged parts are those of the whole; distinct
counts and quantiles are estimates with the sketches' error; a frequent value's count is exact
where nothing was missed, and otherwise lies between ``count`` and ``count_at_most``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkgauge.functions.cells import finite_or_null
from sparkgauge.operators import heavy
from sparkgauge.operators.frequencies import top_per_group
from sparkgauge.operators.shape import as_double, as_text, column_list, fields, long_form, numeric_columns, other_columns
from sparkgauge.session import small_frame

HLL_BITS, KLL_SIZE = 14, 800
#: Values whose counts a state holds for each column.
TOP_HELD = 1 << 11
POWERS = ("n", "mean", "m2", "m3", "m4")


def _moments(v: Column) -> list[Column]:
    """n, mean and the sums of second, third and fourth powers of distances from it."""
    n, m2 = F.count(v), F.var_pop(v) * F.count(v)
    spread = m2 > 0
    return [n.cast("double").alias("n"), F.avg(v).alias("mean"), F.coalesce(m2, F.lit(0.0)).alias("m2"),
            F.coalesce(F.when(spread, F.skewness(v) * F.pow(m2, 1.5) / F.sqrt(n)), F.lit(0.0)).alias("m3"),
            F.coalesce(F.when(spread, (F.kurtosis(v) + 3) * m2 * m2 / n), F.lit(0.0)).alias("m4")]


def profile_state(df: DataFrame, part: str) -> DataFrame:
    """The state of one part: a row for each column."""
    spark, nums, others = df.sparkSession, numeric_columns(df), other_columns(df)
    values = {f.name: as_text(f) for f in fields(df)}
    v = F.col("value")
    counts = long_form(df, values).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(v.isNull()).alias("null_count"), F.hll_sketch_agg(v, HLL_BITS).alias("distinct"))
    state = column_list(df).join(counts, "column_name", "left")
    if nums:
        numbers = long_form(df, {f.name: finite_or_null(as_double(f)) for f in fields(df, nums)}).groupBy("column_name").agg(
            *_moments(v), F.min(v).alias("min"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, F.lit(KLL_SIZE)).alias("quantiles"))
    else:
        numbers = small_frame(spark, [], "column_name string, n double, mean double, m2 double, m3 double, m4 double, min double, max double, quantiles binary")
    counted = heavy.count_values(df, others)
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "key")
    placed = counted.counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP_HELD + 1)
    held = F.col("place") <= TOP_HELD
    top = placed.groupBy("column_name").agg(
        F.collect_list(F.when(held, F.struct("key", F.col("n").alias("count")))).alias("top"), F.coalesce(F.max(F.when(~held, F.col("n"))), F.lit(0)).alias("dropped"))
    missed = small_frame(spark, [(c, t["missed"]) for c, t in counted.totals.items()], "column_name string, missed bigint")
    told = state.join(numbers, "column_name", "left").join(F.broadcast(top), "column_name", "left").join(F.broadcast(missed), "column_name", "left")
    return told.select(
        F.lit(part).alias("part"), F.current_timestamp().alias("run_ts"), "column_ix", "column_name", "data_type",
        F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("null_count", F.lit(0)).alias("null_count"), "distinct",
        *POWERS, "min", "max", "quantiles", F.coalesce("top", F.array().cast("array<struct<key: string, count: bigint>>")).alias("top"),
        (F.coalesce("missed", F.lit(0)) + F.coalesce("dropped", F.lit(0))).alias("missed"))


def append_state(state: DataFrame, path: str) -> str:
    state.write.mode("append").parquet(path)
    return path


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each part and column."""
    return top_per_group(spark.read.option("mergeSchema", "true").parquet(path), ["part", "column_name"], [F.desc("run_ts")], 1).drop("rank")


def _together(a: Column, b: Column) -> Column:
    """The moments of two parts together."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    share = apart / n
    m2 = a["m2"] + b["m2"] + apart * share * a["n"] * b["n"]
    m3 = a["m3"] + b["m3"] + apart * share * share * a["n"] * b["n"] * (a["n"] - b["n"]) + 3 * share * (a["n"] * b["m2"] - b["n"] * a["m2"])
    m4 = (a["m4"] + b["m4"] + apart * share * share * share * a["n"] * b["n"] * (a["n"] * a["n"] - a["n"] * b["n"] + b["n"] * b["n"])
          + 6 * share * share * (a["n"] * a["n"] * b["m2"] + b["n"] * b["n"] * a["m2"]) + 4 * share * (a["n"] * b["m3"] - b["n"] * a["m3"]))
    both = F.struct(n.alias("n"), (a["mean"] + share * b["n"]).alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def merged_profile(states: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column: the profile of all parts together. A group holds one state for each part."""
    state = F.struct(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in POWERS])
    start = F.struct(*[F.lit(0.0).alias(c) for c in POWERS])
    whole = states.groupBy("column_name").agg(
        F.min("column_ix").alias("column_ix"), F.max_by("data_type", "part").alias("data_type"), F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_estimate"), F.aggregate(F.array_sort(F.collect_list(state)), start, _together).alias("s"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    n, m2, flat = F.col("s.n"), F.col("s.m2"), F.col("min") == F.col("max")
    some = n > 0
    shape = lambda c: F.when(some, F.when(flat | (n < 3) | (m2 <= 0), F.lit(0.0)).otherwise(c))
    quantile = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(p)) for p in probabilities])
    return whole.select(
        "column_ix", "column_name", "data_type", "row_count", "null_count", "distinct_estimate", F.when(some, F.col("s.mean")).alias("mean"),
        F.when(n > 1, F.when(flat, F.lit(0.0)).otherwise(m2 / (n - 1))).alias("variance"), "min", "max",
        shape(F.sqrt(n) * F.col("s.m3") / F.pow(m2, 1.5)).alias("skewness"), shape(n * F.col("s.m4") / (m2 * m2) - 3).alias("kurtosis"),
        F.when(some, quantile).alias("quantile_estimates"))


def merged_top(states: DataFrame, k: int = 10) -> DataFrame:
    """(column_name, rank, key, count, count_at_most): the first k keys of each column by the counts of all parts."""
    missed = states.groupBy("column_name").agg(F.sum("missed").alias("missed"))
    keys = states.select("column_name", F.inline("top")).groupBy("column_name", "key").agg(F.sum("count").alias("count"))
    first = top_per_group(keys, ["column_name"], [F.desc("count"), F.asc("key")], k)
    return first.join(F.broadcast(missed), "column_name").select("column_name", "rank", "key", "count", (F.col("count") + F.col("missed")).alias("count_at_most"))

"""Table access, the derived dirty table and SQL fragments shared by the queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with gaps, outliers, blanks, mixed text, a constant, an empty column and duplicates."""
    line = table(spark, sf, "lineitem")
    rows = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_partkey") % 97 == 0, F.col("l_extendedprice") * 50).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_suppkey") % 10 == 0, "").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_suppkey") % 7 == 0, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("mixed"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.lit("x").alias("const"),
        F.lit(None).cast("string").alias("empty"),
        F.col("l_orderkey").alias("__order"),
    )
    return rows.unionAll(rows.filter(F.col("__order") % 50 == 0)).drop("__order")


_DIRTY_ROWS = """SELECT l_orderkey * 10 + l_linenumber AS k,
  CASE WHEN l_linenumber <> 3 THEN l_quantity END AS qty,
  CASE WHEN l_partkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS price,
  CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE l_returnflag END AS flag,
  CASE WHEN l_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS mixed,
  strftime(l_shipdate, '%Y-%m-%d') AS day, 'x' AS const, CAST(NULL AS VARCHAR) AS empty
  FROM lineitem"""
DIRTY = f"dirty AS ({_DIRTY_ROWS} UNION ALL {_DIRTY_ROWS} WHERE l_orderkey % 50 = 0)"
DIRTY_COLUMNS = ("k", "qty", "price", "flag", "mixed", "day", "const", "empty")
DIRTY_NUMBERS = ("k", "qty", "price")
DIRTY_TEXTS = ("flag", "mixed", "day", "const", "empty")


def charged(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a derived charge, which correlates with the price."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf, "lineitem").withColumn("charge", charge)


CHARGED = "charged AS (SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"


def special(spark: SparkSession, sf: str) -> DataFrame:
    """events with NaN, infinities and nulls put into the value."""
    e = table(spark, sf, "events")
    odd = (
        F.when(F.col("event_id") % 11 == 0, float("nan"))
        .when(F.col("event_id") % 13 == 0, float("inf"))
        .when(F.col("event_id") % 17 == 0, float("-inf"))
        .when(F.col("event_id") % 19 == 0, None)
        .otherwise(F.col("value"))
    )
    return e.select("event_id", "ts", "event_type", odd.alias("value"))


SPECIAL = """special AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE
  WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 17 = 0 THEN '-Infinity'::DOUBLE
  WHEN event_id % 19 = 0 THEN NULL ELSE value END AS value FROM events)"""


def long_sql(source: str, columns: Sequence[str], kind: str = "DOUBLE") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS {kind}) AS value FROM {source}" for c in columns)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """The frame with some columns rounded, for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def quartiles_sql(source: str, columns: Sequence[str]) -> str:
    """(column_name, q1, q2, q3, lo, hi) per column."""
    one = "SELECT '{c}' AS column_name, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {s}"
    inner = " UNION ALL ".join(one.format(c=c, s=source) for c in columns)
    return f"SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ({inner}) AS q"

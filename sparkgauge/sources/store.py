"""Result store and cleaning history: append-only tables, latest entry by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkgauge.operators.cleaning import Operation
from sparkgauge.operators.frequencies import top_per_group
from sparkgauge.session import small_frame

OPERATION_SCHEMA = "array<struct<type string, column string, columns array<string>, strategy string, fill_value string, target_type string>>"


def append_runs(runs: DataFrame, path: str) -> str:
    """Add run rows (dataset_id, run_ts, ...) to the store."""
    runs.write.mode("append").parquet(path)
    return path


def all_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def latest_run(runs: DataFrame, key: str = "dataset_id", order: Sequence[Column] | None = None) -> DataFrame:
    """The current entry per dataset; Spark keeps one candidate per map task before the shuffle."""
    by = list(order) if order is not None else [F.desc("run_ts")]
    return top_per_group(runs, [key], by, 1).drop("rank")


def get_run(runs: DataFrame, dataset_id: str) -> DataFrame:
    return latest_run(runs.filter(F.col("dataset_id") == dataset_id))


def history_rows(spark: SparkSession, dataset_id: str, operations: Sequence[Operation]) -> DataFrame:
    """One cleaning run: dataset, time and the operations it applied."""
    names = ("type", "column", "columns", "strategy", "fill_value", "target_type")
    ops = [{n: str(op[n]) if n == "fill_value" and op.get(n) is not None else op.get(n) for n in names} for op in operations]
    row = small_frame(spark, [(dataset_id, ops)], f"dataset_id string, operations {OPERATION_SCHEMA}")
    return row.withColumn("run_ts", F.current_timestamp())


def append_history(spark: SparkSession, path: str, dataset_id: str, operations: Sequence[Operation]) -> str:
    history_rows(spark, dataset_id, operations).write.mode("append").parquet(path)
    return path

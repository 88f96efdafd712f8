"""Tables and reports out. Every write goes to a path of its own; inputs are never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from sparkgauge.operators.shape import as_text, fields


def write_csv(df: DataFrame, path: str, **options: str) -> str:
    """CSV files with quotes inside cells doubled."""
    df.write.options(**{"header": "true", "quote": '"', "escape": '"', **options}).csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def write_json_report(report: DataFrame, path: str) -> str:
    """The one-row JSON report as a text file."""
    report.write.text(path)
    return path


def write_observed(df: DataFrame, path: str, format: str = "parquet", **options: str) -> dict[str, int]:
    """Write a table and return its rows, cells without a value and rows without any, gathered while it is written.

    The numbers are aggregates of the write's own tasks; the table is not read a second time.
    """
    present = [as_text(f).isNotNull() for f in fields(df)]
    filled = sum((p.cast("bigint") for p in present), F.lit(0).cast("bigint"))
    watched = Observation()
    seen = df.observe(watched, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.lit(len(present)) - filled), F.lit(0)).alias("missing_cells"),
                      F.count_if(filled == 0).alias("empty_rows"))
    seen.write.format(format).options(**options).save(path)
    return {k: int(v) for k, v in watched.get.items()}

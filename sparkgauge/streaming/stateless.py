"""Cleaning of a streaming table with the operations that look at one row at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sparkgauge.operators.cleaning import Operation, apply_operations, is_stateless


def clean_stream(df: DataFrame, operations: Sequence[Operation]) -> DataFrame:
    """Drop columns, cast types and fill fixed values; others need the whole table and are refused."""
    refused = sorted({str(op["type"]) for op in operations if not is_stateless(op)})
    if refused:
        raise ValueError(f"these operations need the whole table: {', '.join(refused)}")
    return apply_operations(df, operations)

"""Cleaning operations, folded in order into one DataFrame plan.

An operation is a dict ``{type, column, columns?, strategy?, fill_value?, target_type?}``.
Statistics of one step are taken from the table as the step before left it.
Steps that touch different columns and keep all rows do not influence each
other, so they share one statistics pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkgauge.functions.cells import to_number, to_text, to_timestamp
from sparkgauge.operators.duplicates import drop_duplicates
from sparkgauge.operators.frequencies import numeric_modes, text_modes
from sparkgauge.operators.outliers import fence_values
from sparkgauge.operators.quantiles import quantile_values
from sparkgauge.operators.shape import as_double, col_of, fields, long_form
from sparkgauge.session import cut_lineage

Operation = Mapping[str, object]
NUMERIC_STRATEGIES = ("mean", "median")


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the named columns that exist."""
    gone = set(names)
    return df.select(*[col_of(c) for c in df.columns if c not in gone])


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col_of(c) for c in df.columns])


def _strategy(op: Operation) -> str:
    return str(op.get("strategy", "median"))


def _means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    if not columns:
        return {}
    long = long_form(df, {f.name: as_double(f) for f in fields(df, columns)})
    return {r["column_name"]: r["m"] for r in long.groupBy("column_name").agg(F.avg("value").alias("m")).collect()}


def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Mode per column as a literal of the column's type; the smallest value wins a tie.

    Binary and array values are taken from the column itself; maps and structs have no
    literal and stay unfilled.
    """
    chosen = fields(df, columns)
    own = [f.name for f in chosen if isinstance(f.dataType, (T.BinaryType, T.ArrayType))]
    numeric = [f.name for f in chosen if isinstance(f.dataType, T.NumericType)]
    nested = (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
    other = [f.name for f in chosen if not isinstance(f.dataType, (T.NumericType, *nested))]
    found: dict[str, object] = {}
    if numeric:
        found |= {r["column_name"]: r["mode_text"] for r in numeric_modes(df, numeric).collect()}
    if other:
        found |= {r["column_name"]: r["mode"] for r in text_modes(df, other).collect()}
    for name in own:
        counted = df.select(col_of(name).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        first = counted.orderBy(F.desc("n"), "v").first()
        found[name] = None if first is None else bytes(first["v"]) if isinstance(first["v"], bytearray) else first["v"]
    kinds = {f.name: f.dataType for f in chosen}
    return {c: F.lit(v).cast(kinds[c]) for c, v in found.items() if v is not None}


def _needs(df: DataFrame, batch: Sequence[Operation], kind: str) -> list[str]:
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    if kind == "quartiles":
        return [str(op["column"]) for op in batch if op["type"] == "handle_outliers" and op["column"] in numeric]
    wanted = [str(op["column"]) for op in batch if op["type"] == "impute_missing" and _strategy(op) == kind]
    return [c for c in wanted if kind not in NUMERIC_STRATEGIES or c in numeric]


def exact(kind: T.DataType) -> bool:
    """Whether a double can't hold all values of a numeric type."""
    return isinstance(kind, (T.LongType, T.DecimalType))


def fill_literal(value: float, kind: T.DataType) -> Column:
    """A statistic as a literal that leaves the other values of the column as they are.

    Where a double can't hold the column's values it takes the column's own type if it fits, else
    a decimal; other columns get a double.
    """
    if not exact(kind):
        return F.lit(value)
    text = F.lit(repr(Decimal(value).quantize(Decimal(1)) if value == int(value) else round(Decimal(repr(value)), 9)).split("'")[1])
    if isinstance(kind, T.LongType) and value == int(value):
        return text.cast("bigint")
    return text.cast("decimal(38,9)")


def clip(c: Column, low: float, high: float, kind: T.DataType | None = None) -> Column:
    """Bound a value on both sides; nulls stay null. Values inside the bounds keep every digit."""
    if kind is None or not exact(kind):
        return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
    bounds = [fill_literal(x, kind) for x in (low, high)]
    return F.when(c < bounds[0], bounds[0]).when(c > bounds[1], bounds[1]).otherwise(c)


def cast_column(c: Column, field: T.StructField, target_type: str) -> Column:
    if target_type == "numeric":
        return c if isinstance(field.dataType, T.NumericType) else to_number(c.cast("string"))
    if target_type == "categorical":
        return to_text(c)
    if target_type == "datetime":
        moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
        return c.cast("timestamp") if isinstance(field.dataType, moments) else to_timestamp(c.cast("string"))
    return c


def _apply_batch(df: DataFrame, batch: Sequence[Operation]) -> DataFrame:
    quartile_columns, median_columns = _needs(df, batch, "quartiles"), _needs(df, batch, "median")
    means = _means(df, _needs(df, batch, "mean"))
    modes = _modes(df, _needs(df, batch, "mode"))
    quantiles = quantile_values(df, (0.25, 0.5, 0.75), [*quartile_columns, *median_columns])
    bounds = fence_values({c: [quantiles[c][0], quantiles[c][2]] for c in quartile_columns if c in quantiles})
    kinds = {f.name: f for f in df.schema.fields}
    new: dict[str, Column] = {}
    gone: list[str] = []
    for op in batch:
        kind, column = op["type"], op.get("column")
        if kind == "drop_columns":
            gone += list(op.get("columns") or []) + ([str(column)] if column else [])
            continue
        name = str(column)
        c = col_of(name)
        if kind == "impute_missing":
            field = kinds[name]
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                c = F.when(~F.isnan(c), c)
            strategy = _strategy(op)
            if strategy == "mean" and means.get(name) is not None:
                new[name] = F.coalesce(c, fill_literal(means[name], kinds[name].dataType))
            elif strategy == "median" and name in quantiles:
                new[name] = F.coalesce(c, fill_literal(quantiles[name][1], kinds[name].dataType))
            elif strategy == "mode" and name in modes:
                new[name] = F.coalesce(c, modes[name])
            elif strategy == "value" and op.get("fill_value") is not None:
                new[name] = F.coalesce(c, F.lit(op["fill_value"]))
        elif kind == "handle_outliers" and name in bounds:
            new[name] = clip(c, *bounds[name], kinds[name].dataType)
        elif kind == "cast_types":
            new[name] = cast_column(c, kinds[name], str(op.get("target_type")))
    return drop_columns(_replace(df, new) if new else df, gone)


def _touched(op: Operation) -> set[str]:
    names = set(op.get("columns") or []) if op["type"] == "drop_columns" else set()
    return {str(n) for n in names} | ({str(op["column"])} if op.get("column") else set())


def is_stateless(op: Operation) -> bool:
    """Whether an operation needs no statistic and no other row."""
    if op["type"] == "impute_missing":
        return _strategy(op) == "value"
    return op["type"] in ("drop_columns", "cast_types")


def apply_operations(df: DataFrame, operations: Sequence[Operation]) -> DataFrame:
    """Apply the operations in order; those on missing columns are skipped.

    After deduplication the table is checkpointed when a later step reads
    statistics from it, so the whole-row shuffle runs once.
    """
    pending = [op for op in operations if op.get("type")]
    while pending:
        if pending[0]["type"] == "drop_duplicates":
            df = drop_duplicates(df)
            pending = pending[1:]
            if any(not is_stateless(op) for op in pending):
                df = cut_lineage(df)
            continue
        batch: list[Operation] = []
        touched: set[str] = set()
        while pending and pending[0]["type"] != "drop_duplicates" and not (_touched(pending[0]) & touched):
            op, pending = pending[0], pending[1:]
            touched |= _touched(op)
            if op["type"] == "drop_columns" or op.get("column") in df.columns:
                batch.append(op)
        df = _apply_batch(df, batch)
    return df


def impute(df: DataFrame, column: str, strategy: str = "median", fill_value: object = None) -> DataFrame:
    return apply_operations(df, [{"type": "impute_missing", "column": column, "strategy": strategy, "fill_value": fill_value}])


def clip_outliers(df: DataFrame, column: str) -> DataFrame:
    return apply_operations(df, [{"type": "handle_outliers", "column": column}])


def cast_types(df: DataFrame, column: str, target_type: str) -> DataFrame:
    return apply_operations(df, [{"type": "cast_types", "column": column, "target_type": target_type}])

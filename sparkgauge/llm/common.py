"""Helpers shared by the operators: columns added batch by batch, stored steps and joins on keys with hot values."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Used only in local mode with no ``spark.checkpoint.dir``, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/sparkgauge"
#: Rows and bytes of text of an Arrow batch handed to a column function at once; a longer text is alone.
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20
#: A key with at least one in so many rows is hot; there are at most so many hot keys.
HOT_SHARE = 1000

ColumnFunction = Callable[..., Sequence[pa.Array]]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_FOLDER
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: no later loss of an executor repeats what made it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def add_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[tuple[str, str]],
                make: Callable[[], ColumnFunction], keep: Sequence[str] | None = None) -> DataFrame:
    """Add columns computed from ``inputs`` on Arrow slices.

    ``make`` runs once in each task and returns the function from input arrays to
    output arrays. ``keep`` names the input columns that stay (default: all); one
    that has the name of a new column is replaced.
    """
    new = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields]
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    # An input that stays is handed over once.
    place = {f.name: i for i, f in enumerate(kept)}
    others = [n for n in dict.fromkeys(inputs) if n not in place]
    place |= {n: len(kept) + i for i, n in enumerate(others)}
    source = df.select(*[column(n).alias(f"c{i}") for n, i in place.items()])
    at, n_kept = [place[n] for n in inputs], len(kept)
    schema = T.StructType([*kept, *new])
    types = [f.dataType for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        function, arrow = make(), [to_arrow_type(t) for t in types]
        for batch in batches:
            for part in slices(batch, at):
                made = function(*[part.column(i) for i in at])
                made = [a if isinstance(a, pa.Array) and a.type == t else _as(a, t) for a, t in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *made], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, columns: Iterable[int]) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``SLICE_ROWS`` rows and, but for single rows, ``SLICE_BYTES`` bytes in these columns."""
    size = np.zeros(batch.num_rows + 1, np.int64)
    for i in columns:
        if pa.types.is_string(batch.column(i).type) or pa.types.is_binary(batch.column(i).type):
            size[1:] += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    before, at = np.cumsum(size), 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(before, before[at] + SLICE_BYTES, "right")) - 1
        stop = min(at + SLICE_ROWS, max(at + 1, fits))
        yield batch.slice(at, stop - at)
        at = stop


def _as(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that hold at least one in ``HOT_SHARE`` rows: at most ``HOT_SHARE`` rows, whatever the size of the table."""
    counts = df.filter(column(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("hot_n"))
    total = df.agg(F.count(F.lit(1)).alias("hot_total"))
    return counts.join(F.broadcast(total), F.col("hot_n") * HOT_SHARE >= F.col("hot_total")).select(key)


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join of many ``rows`` with at most one row of ``facts`` for each key, hot keys by broadcast.

    ``hot`` is a stored frame of at most ``HOT_SHARE`` keys, so the broadcast side has
    that many rows at most; the shuffle then sees no key with a larger share.
    """
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
    few = facts.join(F.broadcast(hot), key, "left_semi")
    often = marked.filter("is_hot").drop("is_hot").join(F.broadcast(few), key, "left")
    seldom = marked.filter("is_hot is null").drop("is_hot").join(facts, key, "left")
    return often.unionByName(seldom)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))

"""Session helpers: small pinned frames, lineage cuts and scratch folders."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

PIN_LIMIT = 100_000
#: Used only in local mode with no ``spark.checkpoint.dir``, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/sparkgauge"


def build_session(app: str = "sparkgauge", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where it is unset, a fixed one in local mode and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if is_local(spark):
        return LOCAL_FOLDER
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables written between steps."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def small_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A frame of a few driver-side rows as a local relation.

    Spark knows its size and its values: it broadcasts it without a job and
    folds projections over it while planning.
    """
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = list(zip(*[tuple(r) for r in rows])) if rows else [()] * len(target.fields)
    arrow = to_arrow_schema(target)
    arrays = [pa.array(_plain(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), target)


def _plain(values):
    """Rows inside values as dicts, which is how Arrow takes structs."""
    if isinstance(values, T.Row):
        return {k: _plain(v) for k, v in values.asDict().items()}
    if isinstance(values, (list, tuple)):
        return [_plain(v) for v in values]
    return values


def at_once(*actions: Callable[[], object]) -> list:
    """Run independent Spark actions from parallel threads; their jobs share the cores."""
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(actions)) as pool:
        return [f.result() for f in [pool.submit(wrap(a)) for a in actions]]


def pin(df: DataFrame) -> DataFrame:
    """Fix a frame whose size follows the column count, so later rules do not rescan.

    Such frames hold a few rows per column. One that turns out larger than
    ``PIN_LIMIT`` is checkpointed instead of passing through the driver.
    """
    rows = df.limit(PIN_LIMIT + 1).collect()
    if len(rows) > PIN_LIMIT:
        return cut_lineage(df)
    return small_frame(df.sparkSession, rows, df.schema)

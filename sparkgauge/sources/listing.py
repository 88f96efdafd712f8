"""Files below a path, listed by tasks: level after level, each folder by the task that holds it.

The driver never has a list of files or folders. Empty files are listed like any other,
which a scan leaves out; names that Spark's readers skip are skipped here too. Storage
that this reader does not know is listed by Spark's own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkgauge.session import cut_lineage, small_frame

SCHEMA = "path string, length bigint, folder boolean"
#: Rows sent on at once.
ROWS = 10_000


def _known(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it and what stands before that path in results."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path), "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path.removesuffix(inner.strip("/")) if path.rstrip("/").endswith(inner.strip("/")) else path.split("://")[0] + "://"


def is_skipped(name: str) -> bool:
    """Names that readers leave out: hidden ones, marks of jobs and unfinished copies; partition folders may begin with an underscore."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(folders: DataFrame) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, bool]] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.bool_()))], ["path", "length", "folder"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner, lead = _known(path)
                for info in system.get_file_info(fs.FileSelector(inner)):
                    if not is_skipped(info.base_name):
                        rows.append((lead + info.path, info.size or 0, info.type == fs.FileType.Directory))
                    if len(rows) >= ROWS:
                        yield out()
                        rows.clear()
        yield out()

    return folders.select("path").mapInArrow(walk, SCHEMA)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder, or of one file. A path that does not exist raises FileNotFoundError."""
    system, inner, lead = _known(path)
    top = system.get_file_info(inner)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if top.type == fs.FileType.File:
        return small_frame(spark, [(lead + top.path, top.size or 0)], "path string, length bigint")
    level, files = small_frame(spark, [(lead + top.path,)], "path string"), None
    while True:
        found = cut_lineage(_listed(level))
        part = found.filter("not folder").select("path", "length")
        files = part if files is None else files.unionByName(part)
        level = found.filter("folder")
        if level.isEmpty():
            return files
        # Folders are dealt anew, however many of them one folder had.
        level = level.repartition(spark.sparkContext.defaultParallelism, F.col("path"))

"""CSV records of files that are read by many tasks, though their quoted cells hold line breaks.

A file split begins at a line, but whether that line begins a record is decided by all
quotes before it. A first scan works out for each split, from its lines alone, how it ends
if it begins outside a quoted cell and how if it begins inside one. These small functions
are put together along each file (a split either keeps the state, turns it round, or sets
it whatever it was), which gives the state that each split begins in. A second scan joins
lines to records from the first true boundary on; what is left at the edges of splits, at
most two pieces for each, is put together afterwards. Records are parsed by Spark.

A quote opens a cell only at the cell's start; inside, two quotes stand for one. Lines end
with a line feed, before which a carriage return is dropped at a record's end, and inside
cells too if the file's first line has one. Lines without a character between records are
no records. The first record of each file is its header.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkgauge.session import cut_lineage

WHOLE, HEAD, TAIL = 0, 1, 2


def ends_open(line: str, is_open: bool, separator: str = ",") -> bool:
    """Whether a quoted cell is open at the end of the line, from whether one was at its start."""
    at, size = 0, len(line)
    while True:
        if is_open:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            is_open = False
        elif at < size and line[at] == '"':
            is_open, at = True, at + 1
            continue
        at = line.find(separator, at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, start, from, to): stretches of a batch that belong to one split."""
    files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes = files.indices.to_numpy()
    edges = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
    names = files.dictionary.to_pylist()
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield names[codes[a]], int(starts[a]), a, b


def split_ends(lines: DataFrame) -> DataFrame:
    """(file, start, if_closed, if_open, returns): how each split ends, and whether its first line ends with a carriage return."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[bool]] = {}
        returns: dict[tuple[str, int], bool] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            quoted = pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False)
            for file, start, a, b in _stretches(batch):
                if (file, start) not in ends:
                    ends[file, start], returns[file, start] = [False, True], batch.column(2)[a].as_py().endswith("\r")
                state = ends[file, start]
                for line in batch.column(2).slice(a, b - a).filter(pa.array(quoted[a:b])).to_pylist():
                    state[:] = [ends_open(line, s) for s in state] if state[0] != state[1] else [ends_open(line, state[0])] * 2
        keys = list(ends)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int64()),
                                          pa.array([ends[k][0] for k in keys], pa.bool_()), pa.array([ends[k][1] for k in keys], pa.bool_()),
                                          pa.array([returns[k] for k in keys], pa.bool_())], ["file", "start", "if_closed", "if_open", "returns"])

    return lines.mapInArrow(scan, "file string, start bigint, if_closed boolean, if_open boolean, returns boolean")


def open_starts(ends: DataFrame) -> DataFrame:
    """(file, start) of the splits that begin inside a quoted cell. A row for each split, so windows over a file are short."""
    along = Window.partitionBy("file").orderBy("start")
    turns = ends.withColumn("turns", F.sum(F.when(F.col("if_closed") & ~F.col("if_open"), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # The last split before that ends the same way whatever it began with, and the turns since then.
    fixed = F.when(F.col("if_closed") == F.col("if_open"), F.struct(F.col("if_closed").cast("int").alias("state"), "turns"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    known = turns.withColumn("known", F.last(fixed, ignorenulls=True).over(before)).withColumn("turned", F.coalesce(F.last("turns").over(before), F.lit(0)))
    state = F.coalesce("known.state", F.lit(0)) + F.col("turned") - F.coalesce("known.turns", F.lit(0))
    return known.filter(state % 2 == 1).select("file", "start")


def _pieces(lines: DataFrame) -> DataFrame:
    """(file, start, kind, first, record) of lines with ``opened``, whether their split begins inside a cell."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, is_open, head, first, held = None, False, False, False, []
        rows: list[tuple[str, int, int, bool, str]] = []

        def tail() -> None:
            if held:
                rows.append((*split, HEAD if head else TAIL, first, "\n".join(held)))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "kind", "first", "record"])

        for batch in batches:
            if not batch.num_rows:
                continue
            quoted = pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).tolist()
            for file, start, a, b in _stretches(batch):
                if (file, start) != split:
                    tail()
                    split, is_open, held = (file, start), batch.column(3)[a].as_py(), []
                    head, first = is_open, start == 0
                for line, has_quote in zip(batch.column(2).slice(a, b - a).to_pylist(), quoted[a:b]):
                    if has_quote:
                        is_open = ends_open(line, is_open)
                    if is_open:
                        held.append(line)
                        continue
                    line = line.removesuffix("\r")
                    if held or head:
                        held.append(line)
                        rows.append((file, start, HEAD if head else WHOLE, first, "\n".join(held)))
                    elif line:
                        rows.append((file, start, WHOLE, first, line))
                    else:
                        continue
                    held, head, first = [], False, False
            yield out()
            rows.clear()
        tail()
        yield out()

    return lines.mapInArrow(join, "file string, start bigint, kind int, first boolean, record string")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record): the records of all files but their headers, as text."""
    lines = _lines(spark, path)
    ends = cut_lineage(split_ends(lines))
    opened = open_starts(ends).withColumn("opened", F.lit(True))
    returns = ends.filter("start = 0 and returns").select("file", "returns")
    # One row for each split that begins inside a cell, and for each file with carriage returns.
    marked = lines.join(F.broadcast(opened), ["file", "start"], "left").select("file", "start", "value", F.coalesce("opened", F.lit(False)).alias("opened"))
    pieces = _pieces(marked)
    whole = pieces.filter((F.col("kind") == WHOLE) & ~F.col("first")).select("file", "record")
    edges = pieces.filter(F.col("kind") != WHOLE)
    number = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", "kind"))
    chains = edges.withColumn("chain", number).groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(F.struct("start", "record"))).getField("record").alias("parts"), F.max("first").alias("first"))
    found = whole.unionByName(chains.filter(~F.col("first")).select("file", F.array_join("parts", "\n").alias("record"))).join(F.broadcast(returns), "file", "left")
    return found.select(F.when(F.col("returns"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record")).alias("record"))

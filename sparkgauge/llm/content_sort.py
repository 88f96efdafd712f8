"""Exact duplicates by a content sort.

Texts are equal when their UTF-8 bytes are the same once the white space of ``WHITE`` is
deleted. Rows are range-partitioned by sampled splitters over the normalised content:
its first ``HEAD`` bytes, then its SHA-256, then the order in which rows of a group are
preferred (more code points first, smaller id first, null ids last). The splitters hold
no whole text, so the driver's share does not grow with the length of texts, and since
the preference is part of the key, a group of any size is cut over several partitions.
Each partition is sorted externally by the same key with the whole content in it, so
equal texts lie side by side; each row is compared with its neighbour in full, batch by
batch, and a run of equal rows gets a number. Runs that go on over the edge of a
partition are tied together by comparing the last text of one partition with the first
of the next (one row for each partition). The first row of a run is the one that stays.

Null texts count as empty; empty and blank texts are equal to each other. Rows that
repeat in full are separate rows, of which one stays; which of them is of no account,
since they differ at most in columns that are no part of the key. An empty table gives
no rows. Other columns come along, except those named like an output, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sparkgauge.llm.common import column, join_by_key, stored

#: Deleted before texts are compared: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"
HEAD = 32
#: Bytes of text that a partition of the sort holds, about.
PART_BYTES = 128 << 20
#: Rows handed to Python objects at once.
SLICE = 256
OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def _content(docs: DataFrame, text: str, doc_id: str, names: Sequence[str]) -> DataFrame:
    """The columns ``names`` as k0, k1, ...; id, chars, and head, digest and normalised bytes of the text."""
    filled = F.coalesce(column(text), F.lit(""))
    source = docs.select(*[column(n).alias(f"k{i}") for i, n in enumerate(names)], column(doc_id).alias("id"),
                         F.length(filled).alias("chars"), filled.cast("binary").alias("raw"))
    kept = source.schema.fields[:-1]
    schema = T.StructType([*kept, *[T.StructField(n, T.BinaryType()) for n in ("head", "digest", "body")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                bodies = [normalised(t.as_py()) for t in part.column(len(kept))]
                made = [[b[:HEAD] for b in bodies], [hashlib.sha256(b).digest() for b in bodies], bodies]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(m, pa.binary()) for m in made]], schema.names)

    return source.mapInArrow(run, schema)


def _runs(sorted_rows: DataFrame) -> DataFrame:
    """Number the runs of equal bodies in each sorted partition; the first and last row carry their text in ``edge_text``."""
    kept = [f for f in sorted_rows.schema.fields if f.name not in ("head", "digest", "body")]
    added = [("sha", "string"), ("part", "long"), ("run", "long"), ("starts", "boolean"), ("edge", "int"), ("edge_text", "binary")]
    schema = T.StructType([*kept, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, before = -1, None
        waiting = None

        def out(state: tuple, last: bool) -> pa.RecordBatch:
            batch, starts, runs = state
            n = batch.num_rows
            edge = np.zeros(n, np.int32)
            edge[0] += runs[0] == 0 and bool(starts[0])
            edge[n - 1] += 2 * last
            bodies = batch.column(batch.schema.get_field_index("body"))
            texts = pa.array([bodies[i].as_py() if e else None for i, e in enumerate(edge.tolist())], pa.binary())
            shas = pa.array([d.as_py().hex() for d in batch.column(batch.schema.get_field_index("digest"))], pa.string())
            return pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], shas, pa.array(np.full(n, part), pa.int64()),
                 pa.array(runs), pa.array(starts), pa.array(edge), texts], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            bodies = batch.column(batch.schema.get_field_index("body"))
            starts = np.ones(batch.num_rows, bool)
            starts[0] = before is None or bodies[0].as_py() != before
            if batch.num_rows > 1:
                starts[1:] = ~pc.equal(bodies.slice(1), bodies.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            runs = number + np.cumsum(starts, dtype=np.int64)
            number, before = int(runs[-1]), bodies[batch.num_rows - 1].as_py()
            if waiting:
                yield out(waiting, False)
            waiting = batch, starts, runs
        if waiting:
            yield out(waiting, True)

    return sorted_rows.mapInArrow(run, schema)


def _continued(rows: DataFrame) -> DataFrame:
    """(part, to_part, to_run): the run that the first run of ``part`` goes on with, where it does; at most one row for each partition."""
    tails = rows.filter("edge >= 2").select("part", "run", F.col("edge_text").alias("tail"))
    heads = rows.filter("edge % 2 = 1").select(F.col("part").alias("next"), F.col("edge_text").alias("head"))
    chain = tails.select("part", "run", F.lead("part").over(Window.orderBy("part")).alias("next"))
    met = tails.drop("run").join(chain.select("part", "next"), "part").join(heads, "next").filter("tail = head").select(F.col("next").alias("part"), F.lit(True).alias("met"))
    told = stored(chain.drop("next").join(met, "part", "left").withColumn("met", F.coalesce("met", F.lit(False))), "edges")
    # A partition that is one run and goes on with the one before has no run of its own to tie others to.
    own = F.when(~(F.col("met") & (F.col("run") == 0)), F.struct("part", "run"))
    root = F.last(own, ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return stored(told.withColumn("root", root).filter("met").select("part", F.col("root.part").alias("to_part"), F.col("root.run").alias("to_run")), "ties")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] | None = None) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text).

    ``keep`` names the input columns that come along (default: all but the text).
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUTPUT and (keep is not None or c != text)]
    size = docs.agg(F.sum(F.octet_length(column(text)).cast("long")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)

    content = _content(docs, text, doc_id, names)
    preferred = [F.col("chars").desc(), F.col("id").asc_nulls_last()]
    ranged = content.repartitionByRange(parts, "head", "digest", *preferred)
    rows = stored(_runs(ranged.sortWithinPartitions("head", "digest", "body", *preferred)), "runs")

    tied = rows.drop("edge", "edge_text").join(F.broadcast(_continued(rows).withColumn("run", F.lit(0).cast("long"))), ["part", "run"], "left")
    root = F.shiftleft(F.coalesce("to_part", "part"), 40).bitwiseOR(F.coalesce("to_run", "run"))
    placed = tied.select(*[f"k{i}" for i in range(len(names))], "id", "sha", root.alias("root"),
                         (F.col("starts") & F.col("to_part").isNull()).alias("kept"))
    facts = stored(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("kept"), F.struct("id"))).alias("keeper")).filter("n > 1"), "groups")
    total = facts.agg(F.sum("n").alias("total"))
    hot = stored(facts.join(F.broadcast(total), F.col("n") * 1000 >= F.col("total")).select("root"), "hot-groups")
    found = join_by_key(placed, facts, "root", hot)
    single = F.col("n").isNull()
    return found.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], F.when(single, F.col("id")).otherwise(F.col("keeper.id")).alias("keep_id"),
                        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), "kept", F.col("sha").alias("text_sha256"))

"""Shards of near equal bytes by a histogram sort, in DataFrame operations only.

Rows are ordered by three 64-bit hashes: that of the text, that of the id, and that of a
number of their own, so equal texts lie side by side and rows that repeat in full still
have an order. To cut the order into shards, exact bytes below 4096 evenly spaced probes
are counted over all partitions; around each target the probes are then spaced 4096 times
closer, and so on, until a probe lies within the tolerance of the target or one row is left
between two probes. Then the rows are exchanged once, in cells of the order that are
numbered from the histogram. There is a cell for every ``CELL_BYTES`` of text, so no task
holds a shard, whatever the size of the table. Copies stay together unless their group
would push a shard beyond the tolerance; a text with more than one in a thousand rows is
dealt into as many cells as its share of the rows is due.

Null texts have no bytes (size 1 for the row itself). Rows that repeat, in full or without
an id, are kept, get slots of their own and are cut apart like any others. The rows are
first stored with their numbers, so that all later steps see the same ones. An empty table
gives no rows. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge.llm.common import HOT_SHARE, column, stored

LEAST = -(1 << 63)
PROBE_BITS = 12
#: Bytes of text in a cell, about, and the least number of cells as a power of two.
CELL_BYTES, LEAST_CELL_BITS = 64 << 20, 12
KEYS = ("__text_hash", "__id_hash", "__row_hash")
LEVELS = [*range(64 - PROBE_BITS, 0, -PROBE_BITS), 0]


@dataclass
class Target:
    """A wanted cut: bytes still to pass below it inside the stretch of the order that holds it."""
    bytes: int
    prefix: int | None = None


def _refine(rows: DataFrame, key: str, targets: dict[int, int], tolerance: float) -> tuple[dict[int, int | None], dict[int, tuple[int, int, int]]]:
    """Cut points on one 64-bit key.

    ``targets``: bytes below each cut. Returns cuts that were found as the first key
    above (None: the end), and the cuts inside the rows of one key as (key, bytes
    below within that key, bytes of the key).
    """
    done: dict[int, int | None] = {}
    inside: dict[int, tuple[int, int, int]] = {}
    left = {i: Target(t) for i, t in targets.items()}
    unsigned = F.col(key).bitwiseXOR(F.lit(LEAST))
    above: Column | None = None
    for shift in LEVELS:
        if not left:
            break
        part = rows if above is None else rows.filter(above.isin(sorted({t.prefix for t in left.values()})))
        probe = F.shiftrightunsigned(unsigned, shift) if shift else unsigned
        counted = part.groupBy(probe.alias("probe"), (above if above is not None else F.lit(0)).alias("above")).agg(
            F.sum("size").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        counted.sort(key=lambda r: r["low"])
        for i, target in list(left.items()):
            below = 0
            bins = [r for r in counted if target.prefix is None or r["above"] == target.prefix]
            for nth, r in enumerate(bins):
                if below + r["bytes"] > target.bytes or nth + 1 == len(bins):
                    over = below + r["bytes"] - target.bytes
                    if min(target.bytes - below, abs(over)) <= tolerance:
                        after = bins[nth + 1]["low"] if nth + 1 < len(bins) else r["high"] + 1 if r["high"] < -LEAST - 1 else None
                        done[i] = r["low"] if target.bytes - below <= abs(over) else after
                        del left[i]
                    elif r["low"] == r["high"]:
                        inside[i] = (r["low"], target.bytes - below, r["bytes"])
                        del left[i]
                    else:
                        left[i] = Target(target.bytes - below, r["probe"])
                    break
                below += r["bytes"]
        above = probe
    return done, inside


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.005) -> list[tuple[int, ...] | None]:
    """Least (text_hash, id_hash, row_hash) of each shard but the first; None: the shard is empty.

    ``keys`` has those columns and ``size``. The tolerance is a share of a shard's bytes.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    if not total:
        return [None] * (shards - 1)
    cuts: dict[int, tuple[int, ...] | None] = {}
    # Groups of rows that agree in the keys so far, with the cuts that lie inside each.
    inside: dict[tuple[int, ...], dict[int, int]] = {(): {j: total * j // shards for j in range(1, shards)}}
    for level, key in enumerate(KEYS):
        deeper: dict[tuple[int, ...], dict[int, int]] = {}
        for known, targets in inside.items():
            group = keys
            for name, value in zip(KEYS, known):
                group = group.filter(F.col(name) == value)
            found, within = _refine(group, key, targets, slack)
            for j, k in found.items():
                cuts[j] = _padded(*known, k) if k is not None else _after(known)
            for j, (k, below, size) in within.items():
                if level + 1 < len(KEYS):
                    deeper.setdefault((*known, k), {})[j] = below
                else:  # one row: to the nearer side
                    cuts[j] = (*known, k) if 2 * below <= size else _after((*known, k))
        inside = deeper
    return [cuts[j] for j in range(1, shards)]


def _padded(*keys: int) -> tuple[int, ...]:
    return (*keys, *[LEAST] * (len(KEYS) - len(keys)))


def _after(keys: tuple[int, ...]) -> tuple[int, ...] | None:
    """The least key above all that begin with these; None if there is none."""
    while keys and keys[-1] == -LEAST - 1:
        keys = keys[:-1]
    return _padded(*keys[:-1], keys[-1] + 1) if keys else None


def _beyond(cut: tuple[int, ...]) -> Column:
    """Whether a row's keys are at or above the cut."""
    test = F.lit(True)
    for name, value in reversed(list(zip(KEYS, cut))):
        test = (F.col(name) > value) | (F.col(name) == value) & test
    return test


def histogram_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", tolerance: float = 0.005) -> DataFrame:
    """All rows with ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard), exchanged once."""
    body = F.coalesce(column(text), F.lit(""))
    rows = stored(docs.withColumns({
        "__text_hash": F.xxhash64(body), "__id_hash": F.xxhash64(column(doc_id)), "__row_hash": F.xxhash64(F.monotonically_increasing_id()),
        "size": (F.octet_length(body) + 1).cast("long"),
    }), "shard-rows")
    keys = rows.select(*KEYS, "size")
    shard = F.lit(0)
    for cut in splitters(keys, shards, tolerance):
        if cut is not None:
            shard = shard + _beyond(cut).cast("int")
    sums = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    bits = max(LEAST_CELL_BITS, math.ceil(math.log2(max(1, (sums["bytes"] or 0) / CELL_BYTES))))
    # At most HOT_SHARE texts; each is due its share of the cells.
    counts = keys.groupBy("__text_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_SHARE >= sums["rows"])
    hot = stored(counts.select("__text_hash", F.ceil(F.col("n") / sums["rows"] * (1 << bits)).cast("long").alias("__parts")), "hot-texts")

    def celled(table: DataFrame) -> DataFrame:
        part = F.when(F.col("__parts").isNotNull(), 1 + F.pmod(F.xxhash64("__id_hash", "__row_hash"), F.col("__parts"))).otherwise(0)
        cell = F.shiftrightunsigned(F.col("__text_hash").bitwiseXOR(F.lit(LEAST)), 64 - bits)
        return table.join(F.broadcast(hot), "__text_hash", "left").withColumns({"shard": shard, "__cell": cell, "__part": part}).drop("__parts")

    # A row for each cell, two where a cut or a hot text lies in it, and the parts of hot texts: as many again.
    cells = celled(keys).groupBy("shard", "__cell", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__cell", "__part").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(cells.withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "shard-cells")
    place = Window.partitionBy("shard", "__cell", "__part").orderBy(*KEYS)
    # If the cells are too many to broadcast, the join shuffles by what the window needs anyway.
    dealt = celled(rows).join(first, ["shard", "__cell", "__part"])
    return dealt.withColumn("slot", F.col("__first") + F.row_number().over(place) - 1).drop("__cell", "__part", "__first", *KEYS)

"""Exact quantiles of every numeric column, with bounded state per task.

The built-in exact ``percentile`` keeps every distinct value of a column in one
final task. Here a mergeable sketch only proposes cut points; full counts
between the cuts then tell, exactly, which cut or which gap holds each rank.
Most ranks of discrete columns fall on a cut and are done. The others are read
from their gap, which is small; a gap that still holds too many values is
cut again by a sketch of its own. Nothing is sorted but the values of one gap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge.operators.shape import as_double, fields, numeric_columns, numeric_long
from sparkgauge.session import small_frame

SKETCH_SIZE = 4096
RANK_SLACK = 0.001
#: Values that one task orders. Ranks of tables of up to a hundred times as many rows (five of them a column) are read in two scans.
GAP_LIMIT = 2_500_000
SALTS = 256


@dataclass
class _Target:
    """One wanted order statistic: the ``rank``-th smallest value (from 0) of a column."""

    column: str
    rank: int
    value: float | None = None
    above: float = -math.inf  # the answer is above this value ...
    below: float = math.inf  # ... and below this one
    skipped: int = 0  # values at or under ``above``

    @property
    def gap(self) -> tuple[str, float, float]:
        return (self.column, self.above, self.below)


def _gap_rows(long: DataFrame, gaps: list[tuple[str, float, float]]) -> DataFrame:
    """Rows of the long frame inside the gaps, tagged with the gap number.

    Gaps of one column never overlap, so a row meets at most one of them. There
    are at most two gaps per column and probability, which bounds the broadcast.
    """
    by_column: dict[str, list[tuple[float, float, int]]] = {}
    for number, (column, low, high) in enumerate(gaps):
        by_column.setdefault(column, []).append((low, high, number))
    frame = small_frame(
        long.sparkSession,
        [(c, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for c, v in by_column.items()],
        "column_name string, lows array<double>, highs array<double>, numbers array<int>",
    )
    tagged = long.filter(F.col("value").isNotNull()).join(F.broadcast(frame), "column_name")
    number = F.lit(None).cast("int")
    for i in range(max(len(v) for v in by_column.values())):
        inside = (F.col("value") > F.get("lows", F.lit(i))) & (F.col("value") < F.get("highs", F.lit(i)))
        number = F.when(inside, F.get("numbers", F.lit(i))).otherwise(number)
    return tagged.select("column_name", "value", number.alias("gap")).filter(F.col("gap").isNotNull())


def _sketch(rows: DataFrame, key: str) -> DataFrame:
    """A sketch per key, merged in two steps so no task meets one sketch per input split."""
    value = F.col("value")
    local = rows.groupBy(key, (F.spark_partition_id() % SALTS).alias("salt")).agg(
        F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE)).alias("sketch"), F.count(value).alias("n")
    )
    return local.groupBy(key).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def _around(positions: Sequence[float]) -> list[float]:
    """Relative ranks to ask a sketch for: both ends, and both sides of each position."""
    sides = {min(max(p + side, 0.0), 1.0) for p in positions for side in (-RANK_SLACK, RANK_SLACK)}
    return sorted(sides | {0.0, 1.0})


def _gap_cuts(sketches: DataFrame, positions: dict[int, list[float]]) -> dict[int, list[float]]:
    cuts = F.lit(None).cast("array<double>")
    for gap, p in positions.items():
        asked = F.kll_sketch_get_quantile_double("sketch", F.lit(_around(p)))
        cuts = F.when(F.col("gap") == gap, asked).otherwise(cuts)
    cuts = sketches.select("gap", cuts.alias("cuts"))
    return {row["gap"]: sorted(set(row["cuts"])) for row in cuts.collect()}


def _place(cuts: int) -> Column:
    """Interval number of a value: 2i+1 is the i-th cut itself, 2i the open gap before it."""
    place = F.lit(0)
    for i in range(cuts):
        cut = F.get("cuts", F.lit(i))
        place = place + F.when(F.col("value") > cut, 2).when(F.col("value") == cut, 1).otherwise(0)
    return place.alias("place")


def _interval_counts(rows: DataFrame, key: str, cuts: dict) -> dict:
    """Exact number of values on each cut and between neighbouring cuts."""
    width = max(len(c) for c in cuts.values())
    kind = rows.schema[key].dataType.simpleString()
    frame = small_frame(rows.sparkSession, list(cuts.items()), f"{key} {kind}, cuts array<double>")
    counted = rows.join(F.broadcast(frame), key).groupBy(key, _place(width)).agg(F.count(F.lit(1)).alias("n"))
    result: dict = {k: {} for k in cuts}
    for row in counted.collect():
        result[row[key]][row["place"]] = row["n"]
    return result


def _placed(df: DataFrame, cuts: dict[str, list[float]], near: dict[str, list[bool]]) -> DataFrame:
    """(column_name, place, kept, n): each task's counts of places, and the values themselves at places that are ``near``.

    Whole Arrow batches are looked up in the sorted cuts, as columns and not as rows of the long form.
    """
    names = list(cuts)
    points, wanted = [np.array(cuts[c]) for c in names], [np.array(near[c]) for c in names]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(w), np.int64) for w in wanted]
        for batch in batches:
            found = []
            for i, (column, at, keep) in enumerate(zip(batch.columns, points, wanted)):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                places = np.searchsorted(at, values, "left") + np.searchsorted(at, values, "right")
                kept = keep[places]
                counts[i] += np.bincount(places[~kept], minlength=len(keep))
                found.append((np.full(kept.sum(), i, np.int32), places[kept].astype(np.int32), values[kept]))
            ix, place, value = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(ix), pa.array(place), pa.array(value), pa.array(np.ones(len(ix), np.int64))], ["ix", "place", "kept", "n"])
        some = [(i, p, int(n)) for i, held in enumerate(counts) for p, n in enumerate(held) if n]
        ix, place, n = zip(*some) if some else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ix, pa.int32()), pa.array(place, pa.int32()), pa.nulls(len(ix), pa.float64()), pa.array(n, pa.int64())], ["ix", "place", "kept", "n"])

    wide = df.select(*[as_double(f).alias(f"v{i}") for i, f in enumerate(fields(df, names))])
    placed = wide.mapInArrow(look_up, "ix int, place int, kept double, n bigint")
    return placed.groupBy(F.get(F.lit(names), F.col("ix")).alias("column_name"), "place", "kept").agg(F.sum("n").alias("n"))


def _read_at_once(df: DataFrame, targets: list[_Target], cuts: dict[str, list[float]], asked: dict[str, list[float]]) -> None:
    """Counts of all intervals and the values of the gaps around the asked ranks in one scan.

    Only for columns whose gaps together hold at most ``GAP_LIMIT`` values, as
    their size and the sketch's slack tell beforehand. A rank the sketch put in
    another gap stays open.
    """
    nears = {}
    for column, points in cuts.items():
        near = nears[column] = [False] * (2 * len(points) + 1)
        for low, high in zip(asked[column][::2], asked[column][1::2]):
            for place in range(2 * points.index(low) + 1, 2 * points.index(high) + 1):
                near[place] = near[place] or place % 2 == 0
    freq = _placed(df, cuts, nears)
    order = Window.partitionBy("column_name").orderBy("place", "kept").rowsBetween(Window.unboundedPreceding, 0)
    ranked = freq.withColumn("upto", F.sum("n").over(order))
    wanted = small_frame(
        df.sparkSession, sorted({(t.column, t.rank) for t in targets}), "column_name string, rank bigint"
    )
    hits = ranked.join(F.broadcast(wanted), "column_name").filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    )
    by_key = {(t.column, t.rank): t for t in targets}
    for row in hits.select("column_name", "rank", "place", "kept").collect():
        target = by_key[(row["column_name"], row["rank"])]
        target.value = cuts[target.column][row["place"] // 2] if row["place"] % 2 else row["kept"]


def _narrow(targets: list[_Target], cuts: list[float], counts: dict[int, int], skipped: int, outer: tuple[float, float]) -> None:
    """Move every target of one key to the cut or gap that holds its rank."""
    for target in targets:
        before = skipped
        for place in range(2 * len(cuts) + 1):
            here = counts.get(place, 0)
            if target.rank < before + here:
                if place % 2:
                    target.value = cuts[place // 2]
                else:
                    target.above = cuts[place // 2 - 1] if place else outer[0]
                    target.below = cuts[place // 2] if place // 2 < len(cuts) else outer[1]
                    target.skipped = before
                break
            before += here


def _read_gaps(long: DataFrame, gaps: list[tuple[str, float, float]], targets: list[_Target]) -> None:
    """Order statistics inside gaps whose size is known to be at most ``GAP_LIMIT``."""
    number = {gap: i for i, gap in enumerate(gaps)}
    freq = _gap_rows(long, gaps).groupBy("gap", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("gap").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    wanted = small_frame(
        long.sparkSession, sorted({(number[t.gap], t.rank - t.skipped) for t in targets}), "gap int, place bigint"
    )
    ranked = freq.withColumn("upto", upto)
    hits = ranked.join(F.broadcast(wanted), "gap").filter(
        (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))
    )
    found = {(r["gap"], r["place"]): r["value"] for r in hits.select("gap", "place", "value").collect()}
    for t in targets:
        t.value = found[(number[t.gap], t.rank - t.skipped)]


def _settle(targets: list[_Target], cuts: list[float], counts: dict[int, int], skipped: int, outer: tuple[float, float]) -> dict:
    """Narrow the targets of one key; sizes of the gaps that are still open."""
    _narrow(targets, cuts, counts, skipped, outer)
    place_of = {below: 2 * i for i, below in enumerate(cuts)}
    return {t.gap: counts.get(place_of.get(t.below, 2 * len(cuts)), 0) for t in targets if t.value is None}


def _order_statistics(long: DataFrame, targets: list[_Target], cuts: dict[str, list[float]]) -> None:
    present = long.filter(F.col("value").isNotNull())
    counts = _interval_counts(present, "column_name", cuts)
    size: dict[tuple, int] = {}
    for column in cuts:
        group = [t for t in targets if t.column == column]
        size.update(_settle(group, cuts[column], counts[column], 0, (-math.inf, math.inf)))
    while True:
        still_open = [t for t in targets if t.value is None]
        wide = sorted({t.gap for t in still_open if size[t.gap] > GAP_LIMIT})
        if not wide:
            break
        rows = _gap_rows(long, wide).select("gap", "value")
        inside = {i: [t for t in still_open if t.gap == gap] for i, gap in enumerate(wide)}
        positions = {
            i: [(t.rank - t.skipped) / (size[wide[i]] - 1) for t in group] for i, group in inside.items()
        }
        gap_cuts = _gap_cuts(_sketch(rows, "gap"), positions)
        gap_counts = _interval_counts(rows, "gap", gap_cuts)
        for i, group in inside.items():
            size.update(_settle(group, gap_cuts[i], gap_counts[i], group[0].skipped, wide[i][1:]))
    left = [t for t in targets if t.value is None]
    if left:
        _read_gaps(long, sorted({t.gap for t in left}), left)


def quantile_values(df: DataFrame, probabilities: Sequence[float], columns: Sequence[str] | None = None) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation; columns without a value are left out."""
    chosen = list(columns) if columns is not None else numeric_columns(df)
    if not chosen:
        return {}
    long = numeric_long(df, chosen)
    asked = F.lit(_around(probabilities))
    sketched = _sketch(long.filter(F.col("value").isNotNull()), "column_name").select(
        "column_name", "n", F.kll_sketch_get_quantile_double("sketch", asked).alias("cuts")
    )
    first = sketched.collect()
    sizes = {r["column_name"]: r["n"] for r in first}
    cuts = {r["column_name"]: sorted(set(r["cuts"])) for r in first}
    targets: dict[tuple[str, int], _Target] = {}
    for column, n in sizes.items():
        for p in probabilities:
            position = (n - 1) * p
            for rank in (math.floor(position), math.ceil(position)):
                targets.setdefault((column, rank), _Target(column, rank))
    slack = 2 * RANK_SLACK * len(probabilities)
    small = {c for c, n in sizes.items() if n * slack <= GAP_LIMIT}
    if small:
        by_rank = dict(zip(_around(probabilities), range(len(_around(probabilities)))))
        ends = [min(max(p + side, 0.0), 1.0) for p in probabilities for side in (-RANK_SLACK, RANK_SLACK)]
        raw = {r["column_name"]: r["cuts"] for r in first}
        asked = {c: [raw[c][by_rank[e]] for e in ends] for c in small}
        group = [t for t in targets.values() if t.column in small]
        _read_at_once(df, group, {c: cuts[c] for c in small}, asked)
    left = [t for t in targets.values() if t.value is None]
    if left:
        _order_statistics(long, left, {c: cuts[c] for c in {t.column for t in left}})
    result: dict[str, list[float]] = {}
    for column, n in sizes.items():
        values = []
        for p in probabilities:
            position = (n - 1) * p
            low = targets[(column, math.floor(position))].value
            high = targets[(column, math.ceil(position))].value
            values.append(low if low == high else low + (high - low) * (position - math.floor(position)))
        result[column] = values
    return result


def percentiles(
    df: DataFrame, columns: Sequence[str] | None = None, probabilities: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), exact: bool = True
) -> DataFrame:
    """One row per column with fields p5, p25 ... for the given probabilities."""
    names = [f"p{round(p * 100, 4):g}".replace(".", "_") for p in probabilities]
    spark = df.sparkSession
    schema = "column_name string, " + ", ".join(f"{n} double" for n in names)
    if exact:
        values = quantile_values(df, probabilities, columns)
        return small_frame(spark, [(c, *v) for c, v in values.items()], schema)
    chosen = list(columns) if columns is not None else numeric_columns(df)
    sketches = _sketch(numeric_long(df, chosen).filter(F.col("value").isNotNull()), "column_name")
    return sketches.select(
        "column_name",
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in zip(names, probabilities)],
    )

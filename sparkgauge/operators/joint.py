"""Counts and sums over category columns in one scan, without a row for each pair of columns.

Each task codes the values of every category column by a dictionary that grows as it
reads. Columns are gathered into blocks while the number of their combinations stays
below ``BLOCK_CELLS``, so a row is counted once for its combination in each block (or
each two blocks), not once for each pair of columns. What the task has counted is folded
into column pairs, or into single columns, when it ends or when new values change the
combinations; it then sends on a few rows for each pair (or each group), which Spark adds
up. A task holds at most ``HELD_VALUES`` values; with more it sends on what it has and
starts anew, so columns with very many values cost rows, not memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_CELLS = 128
#: Combinations of two blocks that are counted in a dense table.
DENSE_CELLS = 1 << 16
HELD_VALUES = 100_000


class Codes:
    """Dictionary codes of several columns in one task; 0 stands for null."""

    def __init__(self, columns: int):
        self.known: list[dict[str, int]] = [{} for _ in range(columns)]
        self.values: list[list[str | None]] = [[None] for _ in range(columns)]

    @property
    def sizes(self) -> list[int]:
        return [len(v) for v in self.values]

    def held(self) -> int:
        return sum(self.sizes)

    def encode(self, columns: Sequence[pa.Array]) -> list[np.ndarray]:
        made = []
        for known, values, column in zip(self.known, self.values, columns):
            coded = column.dictionary_encode()
            here = np.zeros(len(coded.dictionary) + 1, np.int64)  # last place: null
            for i, value in enumerate(coded.dictionary.to_pylist()):
                code = known.get(value)
                if code is None:
                    code = known[value] = len(values)
                    values.append(value)
                here[i] = code
            made.append(here[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)])
        return made


class Blocks:
    """Columns gathered into blocks of at most ``BLOCK_CELLS`` combinations (a column with more values is a block itself)."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes, self.columns, self.cells = list(sizes), [], []
        self.place: list[tuple[int, int]] = []  # block and stride of each column
        for i, size in enumerate(sizes):
            if not self.cells or self.cells[-1] * size > BLOCK_CELLS:
                self.columns.append([])
                self.cells.append(1)
            self.place.append((len(self.cells) - 1, self.cells[-1]))
            self.columns[-1].append(i)
            self.cells[-1] *= size

    def cell(self, block: int, codes: Sequence[np.ndarray]) -> np.ndarray:
        return sum(codes[i] * self.place[i][1] for i in self.columns[block])

    def code(self, column: int, cells: np.ndarray) -> np.ndarray:
        """The column's code in each cell of its block."""
        return cells // self.place[column][1] % self.sizes[column]


class PairCounter:
    """How often values of two columns meet, for many pairs of columns."""

    def __init__(self, columns: int, pairs: Sequence[tuple[int, int]]):
        self.pairs, self.codes, self.blocks = list(pairs), Codes(columns), None

    def _start(self) -> None:
        self.blocks = Blocks(self.codes.sizes)
        place = self.blocks.place
        self.met: dict[tuple[int, int], list[int]] = {}
        for p, (a, b) in enumerate(self.pairs):
            key = (min(place[a][0], place[b][0]), max(place[a][0], place[b][0]))
            self.met.setdefault(key, []).append(p)
        self.dense = {key: np.zeros(self._cells(key), np.int64) for key in self.met if self._cells(key) <= DENSE_CELLS}
        self.sparse: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {key: [] for key in self.met if key not in self.dense}

    def _cells(self, key: tuple[int, int]) -> int:
        cells = self.blocks.cells
        return cells[key[0]] if key[0] == key[1] else cells[key[0]] * cells[key[1]]

    def add(self, columns: Sequence[pa.Array]) -> Iterator[pa.RecordBatch]:
        """Count a batch; yields what was counted before if the combinations change."""
        codes = self.codes.encode(columns)
        if self.blocks is None or self.blocks.sizes != self.codes.sizes:
            yield from self.flush()
            self._start()
        cell = {b: self.blocks.cell(b, codes) for b in {b for key in self.met for b in key}}
        for key in self.met:
            joint = cell[key[0]] if key[0] == key[1] else cell[key[0]] * self.blocks.cells[key[1]] + cell[key[1]]
            if key in self.dense:
                self.dense[key] += np.bincount(joint, minlength=len(self.dense[key]))
            else:
                self.sparse[key].append(np.unique(joint, return_counts=True))
                if sum(len(k) for k, _ in self.sparse[key]) > HELD_VALUES:
                    yield from self.flush()
                    self._start()
        if self.codes.held() > HELD_VALUES:
            yield from self.flush()
            self.codes, self.blocks = Codes(len(self.codes.values)), None

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Counts of each pair, folded from the blocks: pair_ix, value1, value2, n."""
        if self.blocks is None:
            return
        values = [pa.array(v, pa.string()) for v in self.codes.values]
        for key, pairs in self.met.items():
            if key in self.dense:
                joint = np.flatnonzero(self.dense[key])
                n = self.dense[key][joint]
            elif self.sparse[key]:
                joint, n = (np.concatenate(x) for x in zip(*self.sparse[key]))
            else:
                continue
            split = self.blocks.cells[key[1]]
            cells = {key[0]: joint, key[1]: joint} if key[0] == key[1] else {key[0]: joint // split, key[1]: joint % split}
            for p in pairs:
                one, two = (self.blocks.code(c, cells[self.blocks.place[c][0]]) for c in self.pairs[p])
                there = (one > 0) & (two > 0)
                width = self.blocks.sizes[self.pairs[p][1]]
                both, back = np.unique(one[there] * width + two[there], return_inverse=True)
                if len(both):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(both), p, np.int32)), values[self.pairs[p][0]].take(pa.array(both // width)),
                         values[self.pairs[p][1]].take(pa.array(both % width)), pa.array(np.bincount(back, n[there]).astype(np.int64))],
                        ["pair_ix", "value1", "value2", "n"])
        self.blocks = None


def joint_counts(columns: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(pair_ix, value1, value2, n) for pairs of the frame's columns (texts), rows with a null in the pair left out."""
    width = len(columns.columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PairCounter(width, pairs)
        for batch in batches:
            if batch.num_rows:
                yield from counter.add(batch.columns)
        yield from counter.flush()

    counted = columns.mapInArrow(count, "pair_ix int, value1 string, value2 string, n bigint")
    return counted.groupBy("pair_ix", "value1", "value2").agg(F.sum("n").alias("n"))


class GroupSummer:
    """n, mean, sum of squared distances from it, least and largest value of numeric columns in the groups of category columns.

    Distances are taken from each group's own mean in the batch and merged, so no digits cancel.
    """

    def __init__(self, categories: int, numerics: int):
        self.codes, self.blocks, self.numerics = Codes(categories), None, numerics

    def _start(self) -> None:
        self.blocks = Blocks(self.codes.sizes)
        shapes = [(cells, self.numerics) for cells in self.blocks.cells]
        self.states = [[np.zeros(s), np.zeros(s), np.zeros(s), np.full(s, np.inf), np.full(s, -np.inf)] for s in shapes]

    def add(self, categories: Sequence[pa.Array], numbers: Sequence[pa.Array]) -> Iterator[pa.RecordBatch]:
        codes = self.codes.encode(categories)
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in numbers])
        seen = ~np.isnan(x)
        if self.blocks is None or self.blocks.sizes != self.codes.sizes:
            yield from self.flush()
            self._start()
        filled, low, high = np.where(seen, x, 0.0), np.where(seen, x, np.inf), np.where(seen, x, -np.inf)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            for block, (n, mean, m2, lo, hi) in enumerate(self.states):
                cell = self.blocks.cell(block, codes)
                order = np.argsort(cell, kind="stable")
                cell, there, value = cell[order], seen[order], filled[order]
                starts = np.concatenate([[True], cell[1:] != cell[:-1]])
                first, group = np.flatnonzero(starts), np.cumsum(starts) - 1
                at = cell[first]
                here = np.add.reduceat(there.astype(float), first, axis=0)
                centre = np.where(here > 0, np.add.reduceat(value, first, axis=0) / here, 0.0)
                off = np.where(there, value - centre[group], 0.0)
                n[at], mean[at], m2[at] = _merged((n[at], mean[at], m2[at]), (here, centre, np.add.reduceat(off * off, first, axis=0)))
                lo[at] = np.minimum(lo[at], np.minimum.reduceat(low[order], first, axis=0))
                hi[at] = np.maximum(hi[at], np.maximum.reduceat(high[order], first, axis=0))
        if self.codes.held() > HELD_VALUES:
            yield from self.flush()
            self.codes, self.blocks = Codes(len(self.codes.values)), None

    def flush(self) -> Iterator[pa.RecordBatch]:
        """category_ix, category_value, column_ix, n, mean, m2, lo, hi of each group with values."""
        if self.blocks is None:
            return
        for c, values in enumerate(self.codes.values):
            block = self.blocks.place[c][0]
            code = self.blocks.code(c, np.arange(self.blocks.cells[block]))
            part = self.states[block]
            n, mean, m2, lo, hi = [np.zeros((len(values), self.numerics)) for _ in range(5)]
            lo[:], hi[:] = np.inf, -np.inf
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                np.add.at(n, code, part[0])
                np.add.at(mean, code, np.where(part[0] > 0, part[0] * part[1], 0.0))
                mean = np.where(n > 0, mean / n, 0.0)
                apart = part[1] - mean[code]
                np.add.at(m2, code, np.where(part[0] > 0, part[2] + part[0] * apart * apart, 0.0))
                np.minimum.at(lo, code, part[3])
                np.maximum.at(hi, code, part[4])
            row, column = np.nonzero(n[1:])  # code 0 is null
            row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), c, np.int32)), pa.array(values, pa.string()).take(pa.array(row)), pa.array(column.astype(np.int32)),
                 pa.array(n[row, column].astype(np.int64)), *[pa.array(s[row, column]) for s in (mean, m2, lo, hi)]],
                ["category_ix", "category_value", "column_ix", "n", "mean", "m2", "lo", "hi"])
        self.blocks = None


def _merged(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """n, mean and squared distances of two parts together, element by element."""
    (n1, mean1, m1), (n2, mean2, m2) = one, two
    n, apart = n1 + n2, mean2 - mean1
    moved = np.where(np.isfinite(apart), mean1 + apart * n2 / n, (n1 * mean1 + n2 * mean2) / n)
    mean = np.where(n1 == 0, mean2, np.where(n2 == 0, mean1, moved))
    return n, mean, np.where(n1 == 0, m2, np.where(n2 == 0, m1, m1 + m2 + apart * apart * n1 * n2 / n))


def merged_moments(n: str, mean: str, m2: str) -> Column:
    """(n, mean, m2) of several parts together: an aggregate over their states, one for each task."""
    state = F.struct(F.col(n).cast("double").alias("n"), F.col(mean).alias("mean"), F.col(m2).alias("m2"))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        total = a["n"] + b["n"]
        apart = F.when(a["n"] > 0, b["mean"] - a["mean"]).otherwise(F.lit(0.0))
        finite = ~F.isnan(apart) & (F.abs(apart) < float("inf"))
        moved = F.when(a["n"] == 0, b["mean"]).when(finite, a["mean"] + apart * b["n"] / total).otherwise((a["n"] * a["mean"] + b["n"] * b["mean"]) / total)
        return F.struct(total.alias("n"), moved.alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / total).alias("m2"))

    return F.aggregate(F.array_sort(F.collect_list(state)), start, merge)


def joint_moments(categories: DataFrame, numerics: int) -> DataFrame:
    """(category_ix, category_value, column_ix, n, mean, variance) of a frame of texts followed by ``numerics`` doubles."""
    width = len(categories.columns) - numerics

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summer = GroupSummer(width, numerics)
        for batch in batches:
            if batch.num_rows:
                yield from summer.add(batch.columns[:width], batch.columns[width:])
        yield from summer.flush()

    states = categories.mapInArrow(add_up, "category_ix int, category_value string, column_ix int, n bigint, mean double, m2 double, lo double, hi double")
    both = states.groupBy("category_ix", "category_value", "column_ix").agg(merged_moments("n", "mean", "m2").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    n = F.col("s.n")
    # One repeated value has no variance, whatever the sums round to.
    variance = F.when(n > 1, F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise(F.col("s.m2") / (n - 1)))
    return both.select("category_ix", "category_value", "column_ix", n.cast("bigint").alias("n"), F.col("s.mean").alias("mean"), variance.alias("variance"))

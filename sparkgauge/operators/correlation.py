"""Pearson correlation of all numeric column pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.functions.cells import finite_or_null
from sparkgauge.functions.tails import t_p_value
from sparkgauge.operators.quantiles import quantile_values
from sparkgauge.operators.shape import as_double, fields, numeric_columns, numeric_long
from sparkgauge.session import small_frame

STRONG = 0.7
COLLINEAR = 0.8
ALPHA = 0.05


def column_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(names, 2))


def column_centres(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    """Means of the numeric columns that vary and have a finite variance, in table order."""
    chosen = list(columns) if columns is not None else numeric_columns(df)
    if not chosen:
        return {}
    v = F.col("value")
    ends = numeric_long(df, chosen).groupBy("column_name").agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("m"), F.var_samp(v).alias("s")
    )
    varying = ends.filter((F.col("lo") < F.col("hi")) & finite_or_null(F.col("s")).isNotNull())
    found = {r["column_name"]: r["m"] for r in varying.select("column_name", "m").collect()}
    return {c: found[c] for c in chosen if c in found}


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Columns whose sums with as many others a task holds at once: six tables of this size squared.
TILE = 256


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The six sums of every column of ``x`` with every column of ``y``, over rows where both are present."""
    seen_x, seen_y = ~np.isnan(x), ~np.isnan(y)
    x, y, here_x, here_y = np.where(seen_x, x, 0.0), np.where(seen_y, y, 0.0), seen_x.astype(float), seen_y.astype(float)
    return np.stack([here_x.T @ here_y, x.T @ here_y, here_x.T @ y, (x * x).T @ here_y, here_x.T @ (y * y), x.T @ y])


def _centred(df: DataFrame, values: dict[str, Column], centres: dict[str, float], places: Sequence[int]) -> DataFrame:
    names = list(values)
    return df.select(*[(values[names[i]] - F.lit(centres[names[i]])).alias(f"v{i}") for i in places])


def _pair_sums(df: DataFrame, values: dict[str, Column], centres: dict[str, float]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of each pair of a few columns, over rows where both values are present.

    Every task adds its Arrow batches up with matrix products and sends one row
    per pair on, so the row count crosses no shuffle and m columns cost one
    pass instead of m * (m - 1) / 2 aggregates. Values are taken from the column
    centre, which keeps the sums of squares free of cancellation.
    """
    first, second = np.triu_indices(len(values), k=1)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            sums = _products(x, x)
            total = sums if total is None else total + sums
        if total is not None:
            columns = [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *[pa.array(s[first, second]) for s in total]]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *SUMS])

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    return _centred(df, values, centres, range(len(values))).mapInArrow(add_up, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def _coefficient(n, sx, sy, sxx, syy, sxy):
    """r from the sums; NaN where it is not defined."""
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = np.clip((sxy - sx * sy / n) / np.sqrt(vx * vy), -1.0, 1.0)
        return np.where((n > 1) & (vx > 0) & (vy > 0), r, np.nan)


def _tiled(df: DataFrame, values: dict[str, Column], centres: dict[str, float], least: float | None) -> DataFrame:
    """(i, j, n, r) of the pairs of very many columns, those with |r| of at least ``least`` if it is given.

    Columns are cut into tiles. Each two tiles are a scan of their own columns, whose tasks hold the sums of that one
    tile of pairs; they send on a row for each column of the first, with its sums to all of the second. Rows are
    added up and turned into coefficients where they meet, and only pairs that are asked for become rows.
    """
    width = len(values)
    tiles = [range(at, min(at + TILE, width)) for at in range(0, width, TILE)]

    def sums_of(one: range, two: range):
        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                part = _products(x[:, :len(one)], x if one == two else x[:, len(one):])
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(one.start, one.stop, dtype=np.int32)), pa.array(np.full(len(one), two.start, np.int32)),
                                                  pa.array([np.ascontiguousarray(total[:, k]).tobytes() for k in range(len(one))], pa.binary())], ["i", "other", "sums"])

        return _centred(df, values, centres, one if one == two else [*one, *two]).mapInArrow(add_up, "i int, other int, sums binary")

    parts = [sums_of(one, two) for k, one in enumerate(tiles) for two in tiles[k:]]

    def finish(groups: pa.Table) -> pa.Table:
        i, other = groups.column("i")[0].as_py(), groups.column("other")[0].as_py()
        total = sum(np.frombuffer(s.as_py()).reshape(6, -1) for s in groups.column("sums"))
        j = np.arange(other, other + total.shape[1])
        r = _coefficient(*total)
        kept = j > i if least is None else (j > i) & (np.abs(r) >= least)
        return pa.table({"i": pa.array(np.full(kept.sum(), i, np.int32)), "j": pa.array(j[kept].astype(np.int32)), "n": pa.array(total[0][kept]),
                         "r": pa.array(r[kept], mask=np.isnan(r[kept]))})

    return reduce(DataFrame.unionByName, parts).groupBy("i", "other").applyInArrow(finish, "i int, j int, n double, r double").select("i", "j", "n", "r")


def pair_correlations(df: DataFrame, values: dict[str, Column], centres: dict[str, float], r_name: str, least: float | None = None) -> DataFrame:
    """(pair_ix, var1, var2, n, r) over rows where both values are present; with ``least`` only pairs with such an |r|."""
    width = len(values)
    if width > TILE:
        found = _tiled(df, values, centres, least)
    else:
        n, sx, sy, sxx, syy, sxy = (F.col(s) for s in SUMS)
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = F.when((n > 1) & (vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (sxy - sx * sy / n) / F.sqrt(vx * vy))))
        found = _pair_sums(df, values, centres).select("i", "j", "n", r.alias("r"))
        if least is not None:
            found = found.filter(F.abs("r") >= least)
    names, i, j = F.lit(list(values)), F.col("i").cast("bigint"), F.col("j").cast("bigint")
    place = (i * (2 * width - i - 1) / 2).cast("bigint") + j - i - 1
    return found.select(place.cast("int").alias("pair_ix"), F.get(names, F.col("i")).alias("var1"), F.get(names, F.col("j")).alias("var2"), F.col("n").cast("bigint").alias("n"), F.col("r").alias(r_name))


def _no_pairs(df: DataFrame, schema: str) -> DataFrame:
    return small_frame(df.sparkSession, [], schema)


def pair_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric column pairs in table order with the rows where both are present."""
    chosen = list(columns) if columns is not None else numeric_columns(df)
    values = {f.name: as_double(f) for f in fields(df, chosen)}
    found = pair_correlations(df, values, {c: 0.0 for c in chosen}, "r")
    return found.select("pair_ix", "var1", "var2", F.col("n").alias("complete_rows"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x, y, r_pairwise): the full matrix in long form, three decimals, diagonal included."""
    centres = column_centres(df, columns)
    names = list(centres)
    if len(names) < 2:
        return _no_pairs(df, "x string, y string, r_pairwise double")
    r = pair_correlations(df, {f.name: as_double(f) for f in fields(df, names)}, centres, "r")
    cells = F.array(
        F.struct(F.col("var1").alias("x"), F.col("var2").alias("y"), F.round("r", 3).alias("r_pairwise")),
        F.struct(F.col("var2").alias("x"), F.col("var1").alias("y"), F.round("r", 3).alias("r_pairwise")),
    )
    diagonal = small_frame(df.sparkSession, [(c, c, 1.0) for c in names], "x string, y string, r_pairwise double")
    return r.select(F.inline(cells)).unionByName(diagonal)


def heatmap(matrix: DataFrame) -> DataFrame:
    """Chart cells of a correlation matrix; missing values show as 0."""
    r = F.col("r_pairwise")
    shown = F.coalesce(F.when(~F.isnan(r) & ~r.isin(float("inf"), float("-inf")), r), F.lit(0.0))
    return matrix.select("x", "y", shown.alias("value"))


def median_filled(df: DataFrame, columns: Sequence[str], medians: dict[str, list[float]] | None = None) -> dict[str, Column]:
    """Each column as double with its nulls replaced by its median."""
    if medians is None:
        medians = quantile_values(df, (0.5,), columns)
    return {f.name: F.coalesce(as_double(f), F.lit(medians[f.name][0])) for f in fields(df, columns)}


def correlated_pairs(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    medians: dict[str, list[float]] | None = None,
    centres: dict[str, float] | None = None,
    least: float | None = None,
) -> DataFrame:
    """(pair_ix, var1, var2, n, r_filled) on median-filled columns: pairs of varying columns, all or with |r| of at least ``least``."""
    if centres is None:
        centres = column_centres(df, columns)
    names = list(centres)
    if len(names) < 2:
        return _no_pairs(df, "pair_ix int, var1 string, var2 string, n bigint, r_filled double")
    return pair_correlations(df, median_filled(df, names, medians), centres, "r_filled", least)


def strong_correlations(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = STRONG,
    medians: dict[str, list[float]] | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Pairs with |r| of at least the threshold, their p-value and its flag."""
    if pairs is None:
        pairs = correlated_pairs(df, columns, medians, least=threshold)
    r, n = F.col("r_filled"), F.col("n")
    strong = pairs.filter(~F.isnan(r) & (F.abs(r) >= threshold))
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt((n - 2) / (1 - r * r)))
    p = strong.withColumn("p", F.when(n > 2, t_p_value(t, F.greatest(n - 2, F.lit(1)))).otherwise(F.lit(1.0)))
    return p.select(
        "pair_ix", "var1", "var2", "n",
        F.round(r, 3).alias("coefficient"),
        F.round("p", 4).alias("p_value"),
        (F.col("p") < ALPHA).alias("significant"),
    )


def multicollinearity(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = COLLINEAR, pairs: DataFrame | None = None) -> DataFrame:
    if pairs is None:
        pairs = correlated_pairs(df, columns, least=threshold)
    r = F.col("r_filled")
    return pairs.filter(~F.isnan(r) & (F.abs(r) >= threshold)).select(
        "pair_ix", F.col("var1").alias("column_name"), F.col("var2").alias("correlated_with"), F.round(r, 3).alias("coefficient")
    )

"""Correlations of very many columns against numpy, tile by tile."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import correlation


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 23)) + 1e6
    x[:, 7] = 2 * x[:, 3] + 0.01 * rng.normal(size=300)
    x[:, 20] = -x[:, 1]
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 11] = np.nan
    names = [f"c{i}" for i in range(23)]
    return x, spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)


def direct(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    return both.sum(), np.corrcoef(x[both, i], x[both, j])[0, 1]


@pytest.mark.parametrize("tile", [256, 22, 5, 1])
def test_pairwise_complete_pairs(wide, monkeypatch, tile):
    monkeypatch.setattr(correlation, "TILE", tile)
    x, df = wide
    values = {c: F.col(c) for c in df.columns if c != "c11"}
    places = [i for i in range(23) if i != 11]
    found = correlation.pair_correlations(df, values, {c: float(np.nanmean(x[:, int(c[1:])])) for c in values}, "r").collect()
    assert len(found) == 22 * 21 // 2 and sorted(r["pair_ix"] for r in found) == list(range(len(found)))
    for r in found:
        a, b = places[[f"c{i}" for i in places].index(r["var1"])], int(r["var2"][1:])
        n, want = direct(x, a, b)
        assert r["n"] == n and r["r"] == pytest.approx(want, abs=1e-9)
        assert correlation.column_pairs(list(values))[r["pair_ix"]] == (r["var1"], r["var2"])


def test_only_strong_pairs_become_rows(wide, monkeypatch):
    x, df = wide
    monkeypatch.setattr(correlation, "TILE", 6)
    values = {c: F.col(c) for c in df.columns if c != "c11"}
    kept = correlation.pair_correlations(df, values, {c: float(np.nanmean(x[:, int(c[1:])])) for c in values}, "r", least=0.7).collect()
    assert {(r["var1"], r["var2"]) for r in kept} == {("c3", "c7"), ("c1", "c20")}


def test_operators_agree_for_any_tile(wide, monkeypatch):
    _, df = wide
    told = []
    for tile in (256, 4):
        monkeypatch.setattr(correlation, "TILE", tile)
        matrix = sorted(map(tuple, correlation.correlation_matrix(df).collect()))
        strong = sorted(map(tuple, correlation.strong_correlations(df).collect()))
        told.append((matrix, strong, sorted(map(tuple, correlation.pair_counts(df.drop("c11")).collect()))))
    assert told[0] == told[1] and len(told[0][0]) == 22 * 22 and len(told[0][1]) >= 1

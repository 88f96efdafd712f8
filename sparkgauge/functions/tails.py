"""Tail probabilities of the t, F and chi-square distributions.

Spark computes every test statistic from grouped sums; only the last step, the
tail of a distribution, has no built-in. It runs over result frames of a few
rows per column, as Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

LARGE_DF = 1e8
_TINY = 1e-300
_EPS = 1e-15
_STEPS = 20_000


def _floor(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) > _TINY, x, _TINY)


def _lgamma(x: np.ndarray) -> np.ndarray:
    distinct, place = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in distinct])[place].reshape(x.shape)


def _lentz(terms, value: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Modified Lentz steps over whole arrays; elements leave when they have settled.

    ``terms(i, live)`` gives the (numerator, denominator) pairs of step i for the
    elements at the places ``live``.
    """
    value = value.copy()
    live = np.arange(len(value))
    for i in range(1, _STEPS):
        for numerator, denominator in terms(i, live):
            d = 1.0 / _floor(numerator * d + denominator)
            c = _floor(denominator + numerator / c)
            step = c * d
            value[live] *= step
        going = np.abs(step - 1.0) >= _EPS
        live, c, d = live[going], c[going], d[going]
        if not len(live):
            break
    return value


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function."""
    def terms(m, live):
        p, q, y = a[live], b[live], x[live]
        yield m * (q - m) * y / ((p + 2 * m - 1.0) * (p + 2 * m)), 1.0
        yield -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1.0)), 1.0

    d = 1.0 / _floor(1.0 - (a + b) * x / (a + 1.0))
    return _lentz(terms, d, np.ones_like(d), d)


def beta_regularised(a, b, x) -> np.ndarray:
    """I_x(a, b), element by element."""
    a, b, x = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1.0, 1.0, 0.0)
    inner = (x > 0.0) & (x < 1.0)
    a, b, x = a[inner], b[inner], x[inner]
    if len(x):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1.0) / (a + b + 2.0)
        p, q, y = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1.0 - x)
        part = front * _beta_fraction(p, q, y) / p
        out[inner] = np.where(low, part, 1.0 - part)
    return out


def _gamma_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    term = 1.0 / a
    total, n, live = term.copy(), a.copy(), np.arange(len(a))
    while len(live):
        n[live] += 1.0
        term[live] *= x[live] / n[live]
        total[live] += term[live]
        live = live[np.abs(term[live]) > np.abs(total[live]) * _EPS]
    return total


def _gamma_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    def terms(i, live):
        yield -i * (i - a[live]), x[live] + 1.0 - a[live] + 2.0 * i

    d = 1.0 / (x + 1.0 - a)
    return _lentz(terms, d, np.full_like(d, 1.0 / _TINY), d)


def gamma_upper(a, x) -> np.ndarray:
    """Q(a, x), the regularised upper incomplete gamma function, element by element."""
    a, x = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, x))
    out = np.where(x <= 0.0, 1.0, 0.0)
    for inside, below in (((x > 0.0) & (x < a + 1.0), True), ((x >= a + 1.0) & np.isfinite(x) & (x > 0.0), False)):
        p, y = a[inside], x[inside]
        if len(y):
            front = np.exp(p * np.log(y) - y - _lgamma(p))
            out[inside] = 1.0 - _gamma_series(p, y) * front if below else front * _gamma_fraction(p, y)
    return out


def _complement(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in x])


def t_tail(t, df) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(t, df))
    out = np.zeros(len(t))
    finite = np.isfinite(t)
    wide = finite & (df > LARGE_DF)
    u, k = t[wide], df[wide]
    out[wide] = _complement(np.abs(u) * (1.0 - 1.0 / (4.0 * k)) / np.sqrt((1.0 + u * u / (2.0 * k)) * 2.0))
    rest = finite & ~wide
    u, k = t[rest], df[rest]
    out[rest] = beta_regularised(k / 2.0, 0.5, k / (k + u * u))
    return out


def f_tail(f, df1, df2) -> np.ndarray:
    """Upper tail of F."""
    f, df1, df2 = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(f, df1, df2))
    out = np.where(f <= 0.0, 1.0, 0.0)
    inside = (f > 0.0) & np.isfinite(f)
    wide = inside & (df2 > LARGE_DF)
    out[wide] = gamma_upper(df1[wide] / 2.0, df1[wide] * f[wide] / 2.0)
    rest = inside & ~wide
    out[rest] = beta_regularised(df2[rest] / 2.0, df1[rest] / 2.0, df2[rest] / (df2[rest] + df1[rest] * f[rest]))
    return out


def chi_tail(x, df) -> np.ndarray:
    """Upper tail of chi-square."""
    return gamma_upper(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def _batch(function, *columns: pd.Series) -> pd.Series:
    """A tail over a whole batch; null where any argument is."""
    values = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
    known = ~np.isnan(values).any(axis=1)
    out = np.full(len(values), np.nan)
    if known.any():
        out[known] = function(*values[known].T)
    return pd.Series(out, dtype="float64").astype(object).where(known, None).astype("Float64")


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return _batch(t_tail, t, df)

    return tail(t.cast("double"), df.cast("double"))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    @F.pandas_udf("double")
    def tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return _batch(f_tail, f, df1, df2)

    return tail(f.cast("double"), df1.cast("double"), df2.cast("double"))


def chi_p_value(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return _batch(chi_tail, x, df)

    return tail(x.cast("double"), df.cast("double"))

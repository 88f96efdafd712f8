"""Normality statistics: the K-squared closed form and the W test for small samples."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, functions as F

# The polynomial coefficients of Royston (1995), Algorithm AS R94.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
SMALL_SCALE = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SCALE = (-0.4803, -0.082676, 0.0030302)
SMALL_BOUND = (-2.273, 0.459)


def skew_z(n: Column, skew: Column) -> Column:
    """Z score of the sample skewness (D'Agostino 1970)."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta2 - 1)) - 1
    delta = 1.0 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    return delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))


def kurtosis_z(n: Column, excess: Column) -> Column:
    """Z score of the sample kurtosis (Anscombe and Glynn 1983)."""
    mean = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3.0 - mean) / F.sqrt(variance)
    root_beta = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(
        6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))
    )
    a = 6.0 + 8.0 / root_beta * (2.0 / root_beta + F.sqrt(1.0 + 4.0 / (root_beta * root_beta)))
    base = 1.0 + x * F.sqrt(2.0 / (a - 4.0))
    cube = F.signum(base) * F.pow((1.0 - 2.0 / a) / F.abs(base), F.lit(1.0 / 3.0))
    return (1.0 - 2.0 / (9.0 * a) - cube) / F.sqrt(2.0 / (9.0 * a))


def k_squared(n: Column, skew: Column, excess: Column) -> Column:
    n = n.cast("double")
    z1, z2 = skew_z(n, skew), kurtosis_z(n, excess)
    return z1 * z1 + z2 * z2


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**power for power, c in enumerate(coefficients))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value for 8 to 5000 values (Royston 1995)."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    spread = float(np.sum((x - x.mean()) ** 2))
    if x[0] == x[-1] or spread == 0.0:
        return 1.0, 1.0
    normal = NormalDist()
    scores = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square = float(scores @ scores)
    root = 1.0 / math.sqrt(n)
    last = _poly(LAST_WEIGHT, root) + scores[-1] / math.sqrt(square)
    second = _poly(SECOND_WEIGHT, root) + scores[-2] / math.sqrt(square)
    phi = (square - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    weights = scores / math.sqrt(phi)
    weights[[0, 1, -2, -1]] = (-last, -second, second, last)
    w = min(float(weights @ x) ** 2 / spread, 1.0)
    if w == 1.0:
        return 1.0, 1.0
    y = math.log1p(-w)
    if n <= 11:
        bound = _poly(SMALL_BOUND, n)
        if y >= bound:
            return w, 1e-99
        y = -math.log(bound - y)
        mean, scale = _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_SCALE, n))
    else:
        mean, scale = _poly(LARGE_MEAN, math.log(n)), math.exp(_poly(LARGE_SCALE, math.log(n)))
    return w, 0.5 * math.erfc((y - mean) / scale / math.sqrt(2.0))

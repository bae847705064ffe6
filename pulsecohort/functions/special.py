"""Tails of distributions: as columns where a formula does, else as vectorised functions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def erf(x: Column) -> Column:
    """Rational approximation 7.1.26 of Abramowitz and Stegun: error under 1.5e-7.

    Fixed values: the coefficients of that formula.
    """
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_tail(z: Column) -> Column:
    """P(Z > z)."""
    return (1 - erf(z / math.sqrt(2))) / 2


def overlap(d: Column) -> Column:
    """Overlap of two unit normals that lie d apart."""
    return 1 + erf(-F.abs(d) / (2 * math.sqrt(2)))


def mann_whitney_normal(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """Two-sided p-value with tie and continuity correction."""
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - F.try_divide(ties, n * (n - 1)))
    top = F.greatest(u, n1 * n2 - u)
    z = F.try_divide(top - n1 * n2 / 2.0 - 0.5, F.sqrt(var))
    return F.when((n1 > 0) & (n2 > 0), F.when(var > 0, F.least(F.lit(1.0), 2 * normal_tail(z))).otherwise(F.lit(1.0)))


@lru_cache(maxsize=64)
def _arrangements(n1: int, n2: int) -> np.ndarray:
    """How many arrangements of two samples without ties have each U, n1 being the smaller: partitions into at most n1 parts of at most n2.

    The generating function is a product of (1 - x^(n2 + k)) / (1 - x^k): a difference at a distance and a running sum for each k.
    Whole numbers keep it exact up to 2^63 arrangements; above, the running sums go over doubles.
    """
    exact = math.comb(n1 + n2, n1) < 1 << 62
    counts = np.zeros(n1 * n2 + 1, np.int64 if exact else np.float64)
    counts[0] = 1
    for k in range(1, n1 + 1):
        up = n2 + k
        if up < len(counts):
            counts[up:] -= counts[:-up].copy()
        for r in range(k):
            counts[r::k] = np.cumsum(counts[r::k])
    # the two halves mirror each other; in doubles the upper one has lost its small counts
    half = len(counts) // 2
    counts[len(counts) - half :] = counts[:half][::-1]
    return counts


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    counts = _arrangements(min(n1, n2), max(n1, n2))
    top = max(u, n1 * n2 - u)
    return float(min(1.0, 2 * counts[math.ceil(top) :].sum() / counts.sum()))


@F.pandas_udf(T.DoubleType())
def exact_mann_whitney(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_exact(a, int(b), int(c)) if a == a and b > 0 and c > 0 else None for a, b, c in zip(u, n1, n2)], dtype="float64")


def mann_whitney(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """Exact for a group of eight or fewer without ties, else the normal approximation."""
    small = (F.least(n1, n2) <= 8) & (ties == 0)
    exact = exact_mann_whitney(F.when(small, u), F.when(small, n1), F.when(small, n2))
    return F.when(small, exact).otherwise(mann_whitney_normal(u, n1, n2, ties))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b) by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 / max(tiny, 1 - (a + b) * x / (a + 1)) if 1 - (a + b) * x / (a + 1) > 0 else 1 / min(-tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if a == a and b > 0 else None for a, b in zip(t, df)], dtype="float64")


def kolmogorov_p(distance: float, n1: int, n2: int) -> float:
    """Two-sided asymptotic p-value of the two-sample distance."""
    z = distance * math.sqrt(n1 * n2 / (n1 + n2))
    if z < 0.2:
        return 1.0
    if z < 1.0:  # the theta-transformed series converges faster here
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * z * z)) for k in range(1, 20))
        return 1 - math.sqrt(2 * math.pi) / z * s
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 50)))


@F.pandas_udf(T.DoubleType())
def ks_p(distance: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([kolmogorov_p(d, int(a), int(b)) if d == d and a > 0 and b > 0 else None for d, a, b in zip(distance, n1, n2)], dtype="float64")


def bessel_series(order: int, z: np.ndarray, terms: int = 40) -> np.ndarray:
    """J of integer order for complex arguments of modest size, by its power series."""
    half = np.asarray(z, complex) / 2
    term = half**order / math.factorial(order)
    out = term.copy()
    for k in range(1, terms):
        term = term * -(half * half) / (k * (k + order))
        out += term
    return out

"""Tail probabilities for result tables: Arrow-batched, since Spark has no distribution functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_both(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def binomial_least(k: int, n: int, p: float) -> float:
    """Chance of k or more hits."""
    return 1.0 if k <= 0 else beta_cdf(p, k, n - k + 1) if k <= n else 0.0


def _each(fn, *cols):
    return pd.Series([None if any(pd.isna(x) for x in row) else fn(*row) for row in zip(*cols)], dtype="float64")


@pandas_udf(DoubleType())
def t_p(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null where either is null or df < 1."""
    return _each(lambda t, n: t_both(t, n) if n >= 1 else None, stat, df)


@pandas_udf(DoubleType())
def normal_upper(stat: pd.Series) -> pd.Series:
    return _each(lambda z: math.erfc(z / math.sqrt(2)) / 2, stat)


@pandas_udf(DoubleType())
def binomial_upper(hits: pd.Series, n: pd.Series, rate: pd.Series) -> pd.Series:
    return _each(lambda k, m, p: binomial_least(int(k), int(m), p), hits, n, rate)

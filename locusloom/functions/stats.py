"""Tail probabilities the SQL functions lack: as column expressions, or vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_factorial(n: Column) -> Column:
    """ln n! for whole n >= 0: exact below 21, Stirling's series above."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    large = x * F.log(x) - x + 0.5 * F.log(2 * np.pi * x) + series
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(large)


def over_representation_p(x: Column, k: Column, m: Column, n: Column) -> Column:
    """P(X >= x) when k genes are drawn from n of which m carry the term.

    The first probability comes from log-factorials, each further one from the one before."""
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    first = F.exp(choose(m, x) + choose(n - m, k - x) - choose(n, k))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct(
        (a["term"] * (m - i) * (k - i) / ((i + 1) * (n - m - k + i + 1))).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    total = F.aggregate(F.sequence(x, F.least(k, m)), start, step, lambda a: a["sum"])
    return F.when(x <= F.greatest(F.lit(0), k + m - n), 1.0).when(x > F.least(k, m), 0.0).otherwise(F.least(total, F.lit(1.0)))


def _log_gamma_half(n2: np.ndarray) -> np.ndarray:
    """ln Gamma(n2 / 2) for whole n2 >= 1."""
    z = np.asarray(n2, dtype=float) / 2
    shift = np.zeros_like(z)
    for _ in range(12):  # lift small arguments to where the series is exact
        low = z < 12
        shift = shift - np.where(low, np.log(z), 0.0)
        z = np.where(low, z + 1, z)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray, log_norm: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore"):
        front = np.exp(log_norm + a * np.log(x) + b * np.log1p(-x))
    return np.clip(front * h / a, 0.0, 1.0)


def correlation_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a Pearson correlation from n pairs; null below three pairs."""
    r, n = np.clip(np.asarray(r, float), -1, 1), np.asarray(n, float)
    df = np.maximum(n - 2, 1)
    x = 1 - r**2  # df / (df + t^2)
    log_norm = _log_gamma_half(df + 1) - _log_gamma_half(df) - _log_gamma_half(np.ones_like(df))
    a, b = df / 2, np.full_like(df, 0.5)
    direct = x < (a + 1) / (a + b + 2)
    xs = np.clip(x, 1e-300, 1 - 1e-16)
    ys = np.clip(r**2, 1e-300, 1 - 1e-16)
    p = np.where(direct, beta_tail(a, b, xs, log_norm), 1 - beta_tail(b, a, ys, log_norm))
    p = np.where(x <= 0, 0.0, np.where(r == 0, 1.0, p))
    return np.where(n > 2, p, np.nan)


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(correlation_p(r.to_numpy(float), n.to_numpy(float)))


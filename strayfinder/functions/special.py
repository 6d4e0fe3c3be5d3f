"""Tail probability of the two-group F test, vectorised for Arrow batches."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Nodes of the integral, and the exponent at which the rest of the tail no longer counts.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(128)
_DROP = 45.0
# The gamma ratio is taken this far up, where its series has converged.
_SHIFT = 24


def _log_gamma_ratio(a: np.ndarray) -> np.ndarray:
    """log gamma(a + 1/2) - log gamma(a), without the difference of two large numbers."""
    steps = sum(np.log1p(0.5 / (a + j)) for j in range(_SHIFT))
    x = a + _SHIFT
    series = 0.5 * np.log(x) - 1 / (8 * x) + 1 / (192 * x**3) - 1 / (640 * x**5) + 17 / (14336 * x**7)
    return series - steps


def _log_cosh(z: np.ndarray) -> np.ndarray:
    small = np.minimum(z, 1.0)
    return np.where(z < 1.0, np.log1p(2 * np.sinh(small / 2) ** 2), z + np.log1p(np.exp(-2 * z)) - math.log(2))


def f_tail(f: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(F(1, df) > f), by one method at every size.

    F(1, df) is the square of Student's t; with t = sqrt(df) sinh(y) its tail is an integral of
    cosh(y) ** -df, which decays smoothly from its lower end: Gauss-Legendre nodes up to where it has
    fallen by exp(-45) give it to rounding noise.
    """
    f, df = np.asarray(f, float), np.asarray(df, float)
    out = np.full(f.shape, np.nan)
    known = np.isfinite(f) & np.isfinite(df) & (df > 0)
    v, x = df[known], np.sqrt(np.maximum(f[known], 0.0) / df[known])
    low = np.arcsinh(x)
    start = 0.5 * v * np.log1p(x * x)
    # where the exponent is start + _DROP: log cosh(y) = level
    level = (start + _DROP) / v
    high = level + np.log1p(np.sqrt(-np.expm1(-2 * level)))
    half = (high - low) / 2
    y = low[:, None] + half[:, None] * (_NODES + 1)
    inner = (np.exp(start[:, None] - v[:, None] * _log_cosh(y)) * _WEIGHTS).sum(axis=1)
    front = _log_gamma_ratio(v / 2) - start - 0.5 * math.log(math.pi)
    out[known] = np.minimum(2 * np.exp(front) * half * inner, 1.0)
    return out


def anova_f(n: Column, mean_a: Column, mean_b: Column, var_a: Column, var_b: Column) -> Column:
    """F of a one-way test of two columns of n rows; variances are population variances."""
    n = n.cast("double")
    between = n * (mean_a - mean_b) * (mean_a - mean_b) / 2
    within = n * (var_a + var_b) / F.when(n > 1, 2 * n - 2)
    return F.try_divide(between, within)


def anova_p(f: Column, n: Column) -> Column:
    """p of ``anova_f``; the only step without a built-in function, on one row per feature pair."""

    def tail(f: pd.Series, n: pd.Series) -> pd.Series:
        p = f_tail(f.to_numpy(float), 2.0 * n.to_numpy(float) - 2.0)
        return pd.Series(p).where(~np.isnan(p), None)

    return F.pandas_udf(tail, "double")(f, n)

"""Tails and quantiles of the beta and F distributions as Arrow-batched column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated with Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    inside = np.clip(x, 0.0, 1.0)
    flip = inside > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - inside, inside)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            p * np.log(y) + q * np.log1p(-y) - np.log(p) - (_log_gamma(p) + _log_gamma(q) - _log_gamma(p + q))
        )
    lower = np.where(y <= 0.0, 0.0, front * _beta_fraction(p, q, y))
    return np.where(np.isnan(x), np.nan, np.where(flip, 1.0 - lower, lower))


def beta_quantile_array(prob, a, b) -> np.ndarray:
    """Inverse of :func:`beta_cdf` by bisection."""
    prob, a, b = np.broadcast_arrays(np.asarray(prob, float), np.asarray(a, float), np.asarray(b, float))
    low, high = np.zeros(prob.shape), np.ones(prob.shape)
    for _ in range(60):
        mid = (low + high) / 2.0
        below = beta_cdf(mid, a, b) < prob
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2.0


def f_upper_tail_array(f, df1, df2) -> np.ndarray:
    """P(F > f) for the F distribution."""
    f, df1, df2 = np.asarray(f, float), np.asarray(df1, float), np.asarray(df2, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(np.isinf(f), 0.0, df2 / (df2 + df1 * f))
    return beta_cdf(x, df2 / 2.0, df1 / 2.0)


@F.pandas_udf(DoubleType())
def beta_quantile(prob: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile_array(prob.to_numpy(float), a.to_numpy(float), b.to_numpy(float)))


@F.pandas_udf(DoubleType())
def f_upper_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_upper_tail_array(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))

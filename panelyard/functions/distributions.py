"""Student-t and normal values for small aggregated results, in Arrow batches."""

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from .columns import col


def _beta_fraction(a, b, x, steps=300):
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    return h


def _beta_inc(a, b, x):
    from math import lgamma
    log_front = (np.vectorize(lgamma)(a + b) - np.vectorize(lgamma)(a) - np.vectorize(lgamma)(b)
                 + a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300)))
    front = np.exp(log_front)
    swap = x > (a + 1) / (a + b + 2)
    direct = front * _beta_fraction(a, b, np.where(swap, 0.5, x)) / a
    other = 1 - front * _beta_fraction(b, a, np.where(swap, 1 - x, 0.5)) / b
    return np.where(swap, other, direct)


def t_p_value(t, df):
    """Two-sided p value of Student's t (numpy arrays)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = ~np.isnan(t) & (df > 0)
    d = np.where(ok, df, 1.0)
    x = d / (d + np.where(ok, t, 0.0) ** 2)
    return np.where(ok, np.clip(_beta_inc(d / 2, np.full_like(d, 0.5), x), 0, 1), np.nan)


def _t_values(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_p_value(t.astype(float), df.astype(float)))


def _quantiles(p: pd.Series) -> pd.Series:
    n = NormalDist()
    return p.map(lambda v: n.inv_cdf(v) if 0 < v < 1 else np.nan).astype(float)


def _cdfs(x: pd.Series) -> pd.Series:
    n = NormalDist()
    return x.map(lambda v: n.cdf(v) if v == v else np.nan).astype(float)


def _apply(fn, *cols):
    made = F.pandas_udf(fn, T.DoubleType())(*[col(c).cast("double") for c in cols])
    return F.when(~F.isnan(made), made)


def t_two_sided(t, df):
    """Two-sided p value of Student's t."""
    return _apply(_t_values, t, df)


def normal_quantile(p):
    return _apply(_quantiles, p)


def normal_cdf(x):
    return _apply(_cdfs, x)

"""Row windows along one security's history.

A panel has one row per (code, date), so a code's window holds at most one row per
calendar date; raw rows are always aggregated to that grain first (sources.panel).
"""

from pyspark.sql import functions as F, Window

from .columns import col, log_pos, root_abs, safe_div


def history(key="code", order="date"):
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*orders)


def last_rows(n, key="code", order="date"):
    return history(key, order).rowsBetween(-(n - 1), 0)


def running(key="code", order="date"):
    return history(key, order).rowsBetween(Window.unboundedPreceding, 0)


def _short(n):
    return max(3, n // 2)


def over_last(agg, x, n, min_obs=None, key="code", order="date"):
    """agg over the last n rows; NULL until min_obs (default n) non-null values are seen."""
    w = last_rows(n, key, order)
    return F.when(F.count(col(x)).over(w) >= F.lit(n if min_obs is None else min_obs),
                  agg(col(x)).over(w))


def mean(x, n, min_obs=None, **kw):
    return over_last(F.avg, x, n, min_obs, **kw)


def std(x, n, min_obs=None, **kw):
    return over_last(F.stddev_samp, x, n, max(2, n if min_obs is None else min_obs), **kw)


def var(x, n, min_obs=None, **kw):
    return over_last(F.var_samp, x, n, max(2, n if min_obs is None else min_obs), **kw)


def total(x, n, min_obs=None, **kw):
    return over_last(F.sum, x, n, min_obs, **kw)


def high(x, n, min_obs=None, **kw):
    return over_last(F.max, x, n, min_obs, **kw)


def low(x, n, min_obs=None, **kw):
    return over_last(F.min, x, n, min_obs, **kw)


def lag(x, n=1, key="code", order="date"):
    return F.lag(col(x), n).over(history(key, order))


def lead(x, n=1, key="code", order="date"):
    return F.lead(col(x), n).over(history(key, order))


def delta(x, n=1, **kw):
    return col(x) - lag(x, n, **kw)


def pct_change(x, n=1, **kw):
    """x / lag(x, n) - 1, NULL on a zero base."""
    return safe_div(x, lag(x, n, **kw)) - 1


def forward_return(x, n, **kw):
    return safe_div(lead(x, n, **kw), x) - 1


def correlation(a, b, over=lambda agg: agg):
    """Pearson correlation of the pairs where both are known; NULL for a constant side.

    Written from covariance and variances because corr raises on a constant side in ANSI
    mode. ``over`` turns each aggregate into a window expression when needed.
    """
    x = F.when(col(b).isNotNull(), col(a).cast("double"))
    y = F.when(col(a).isNotNull(), col(b).cast("double"))
    flat = (over(F.min(x)) == over(F.max(x))) | (over(F.min(y)) == over(F.max(y)))
    value = safe_div(over(F.covar_pop(x, y)), F.sqrt(over(F.var_pop(x)) * over(F.var_pop(y))))
    return F.when(~flat, value)


def regression_slope(y, x, over=lambda agg: agg):
    a = F.when(col(y).isNotNull(), col(x).cast("double"))
    return safe_div(over(F.covar_pop(col(y).cast("double"), a)), over(F.var_pop(a)))


def _pair(agg, a, b, n, min_obs, **kw):
    w = last_rows(n, **kw)
    both = F.when(col(a).isNotNull() & col(b).isNotNull(), F.lit(1))
    return F.when(F.count(both).over(w) >= min_obs, agg(a, b, lambda e: e.over(w)))


def corr(a, b, n, min_obs=None, **kw):
    return _pair(correlation, a, b, n, n if min_obs is None else min_obs, **kw)


def slope(y, x, n, min_obs=None, **kw):
    return _pair(regression_slope, y, x, n, n if min_obs is None else min_obs, **kw)


def rank_pct(x, n, min_obs=None, **kw):
    """Average-tie percentage rank of the newest value within its window."""
    values = F.array_compact(F.collect_list(col(x)).over(last_rows(n, **kw)))
    below = F.size(F.filter(values, lambda v: v < col(x)))
    equal = F.size(F.filter(values, lambda v: v == col(x)))
    need = n if min_obs is None else min_obs
    return F.when(col(x).isNotNull() & (F.size(values) >= need),
                  (below + (equal + 1) / F.lit(2.0)) / F.size(values))


def mean_abs_dev(x, n, min_obs=1, **kw):
    """Mean absolute distance from the window mean (not the standard deviation)."""
    w = last_rows(n, **kw)
    values = F.collect_list(col(x)).over(w)
    centre = F.avg(col(x)).over(w)
    spread = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.abs(v - centre))
    return F.when(F.size(values) >= min_obs, spread / F.size(values))


def weighted_mean(x, weights, **kw):
    """Fixed-weight mean over the last len(weights) rows, oldest first; NULL until full."""
    n = len(weights)
    parts = [lag(x, n - 1 - i, **kw) * w if i < n - 1 else col(x) * w
             for i, w in enumerate(weights)]
    return sum(parts[1:], parts[0]) / float(sum(weights))


def unbiased_skew(count, g, min_obs=3):
    """Bias-corrected skewness from a count and the population skewness.

    Give columns of an earlier stage: every mention of a window expression is computed anew.
    """
    c, g = col(count), col(g)
    return F.when((c >= max(3, min_obs)) & ~F.isnan(g), g * F.sqrt(c * (c - 1)) / F.nullif(c - 2, F.lit(0)))


def unbiased_kurt(count, g, min_obs=4):
    """Bias-corrected excess kurtosis from a count and the population excess kurtosis."""
    c, g = col(count), col(g)
    return F.when((c >= max(4, min_obs)) & ~F.isnan(g),
                  ((c + 1) * g + 6) * (c - 1) / F.nullif((c - 2) * (c - 3), F.lit(0)))


def sample_skew(x):
    """Aggregate form of the bias-corrected skewness."""
    return unbiased_skew(F.count(col(x)), F.skewness(col(x)))


def sample_kurt(x):
    return unbiased_kurt(F.count(col(x)), F.kurtosis(col(x)))


class Windows:
    """Rolling aggregates of named columns, each computed once.

    Spark evaluates every mention of a window expression anew. The methods note what is
    needed and return expressions over its columns; ``apply`` computes the noted windows in
    one projection, then the outputs, then drops the windows.
    """

    def __init__(self):
        self.base = {}

    def _note(self, kind, agg, x, n):
        name = f"_w_{kind}_{x}_{n}"
        self.base[name] = agg(F.col(x)).over(last_rows(n))
        return F.col(name)

    def _known(self, kind, agg, x, n, min_obs):
        return F.when(self._note("n", F.count, x, n) >= F.lit(n if min_obs is None else min_obs), self._note(kind, agg, x, n))

    def mean(self, x, n, min_obs=None):
        return self._known("avg", F.avg, x, n, min_obs)

    def std(self, x, n, min_obs=None):
        return self._known("sd", F.stddev_samp, x, n, max(2, n if min_obs is None else min_obs))

    def total(self, x, n, min_obs=None):
        return self._known("sum", F.sum, x, n, min_obs)

    def high(self, x, n, min_obs=None):
        return self._known("max", F.max, x, n, min_obs)

    def low(self, x, n, min_obs=None):
        return self._known("min", F.min, x, n, min_obs)

    def skew(self, x, n, min_obs=None):
        return unbiased_skew(self._note("n", F.count, x, n), self._note("skew", F.skewness, x, n), n if min_obs is None else min_obs)

    def kurt(self, x, n, min_obs=None):
        return unbiased_kurt(self._note("n", F.count, x, n), self._note("kurt", F.kurtosis, x, n), n if min_obs is None else min_obs)

    def apply(self, df, outputs):
        if not self.base:
            return df.withColumns(outputs)
        return df.withColumns(self.base).withColumns(outputs).drop(*self.base)


def fill_forward(x, key="code", order="date"):
    return F.last(col(x), ignorenulls=True).over(running(key, order))


# Expression operators: name -> builder of a Column.
TIME_OPERATORS = {
    "TS_MEAN": lambda x, n: mean(x, n, _short(n)),
    "TS_STD": lambda x, n: std(x, n, _short(n)),
    "TS_MAX": lambda x, n: high(x, n, _short(n)),
    "TS_MIN": lambda x, n: low(x, n, _short(n)),
    "TS_RANK": lambda x, n: rank_pct(x, n, max(5, n // 2)),
    "TS_CORR": lambda a, b, n: corr(a, b, n, max(10, n // 2)),
    "DELTA": delta,
    "DELAY": lag,
    "SMA": lambda x, n: mean(x, n, _short(n)),
}

SCALAR_OPERATORS = {
    "ABS": lambda x: F.abs(col(x)),
    "EXP": lambda x: F.exp(col(x)),
    "LOG": log_pos,
    "SQRT": root_abs,
}

"""Scalar column helpers: null-safe arithmetic, text and date clean-up."""

from functools import reduce

from pyspark.sql import functions as F


def col(x):
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b):
    """a / b, NULL when b is zero (ANSI mode would raise)."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def log_pos(x):
    """Natural logarithm, NULL unless x > 0."""
    return F.when(col(x) > 0, F.ln(col(x)))


def root_abs(x):
    return F.sqrt(F.abs(col(x)))


def finite(x):
    """NaN and infinities to NULL; the library uses NULL as its only missing value."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(x, lo, hi):
    """NULL stays NULL; greatest/least alone would skip it."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), lo), hi))


def rounded(x, places=6):
    """Round for output. Prices are quotients with exact decimal ties; the nudge sends a
    tie the same way whatever the last bit, and the final sum turns -0.0 into 0.0."""
    return F.round(col(x) + F.lit(float(f"1.37e-{places + 3}")), places) + F.lit(0.0)


def parse_date(x):
    """Date from DATE, TIMESTAMP, ``yyyyMMdd`` or ``yyyy-MM-dd`` text; NULL when unreadable."""
    text = F.substring(F.regexp_replace(F.trim(col(x).cast("string")), "-", ""), 1, 8)
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def normalize_code(x):
    """``SZ.002594``, ``sz002594`` and ``002594.SZ`` all become ``002594.SZ``."""
    text = F.upper(F.trim(col(x)))
    moved = F.regexp_replace(text, r"^(SH|SZ|BJ)\.?(\d{6})$", "$2.$1")
    return moved


def change_pct(close, pre_close):
    return safe_div(col(close) - col(pre_close), pre_close) * 100


def packed_order(*parts):
    """One DECIMAL(38,0) that sorts like the given columns, each with its number of digits.

    A fixed-width order lets min_by and max_by aggregate by hashing; a struct order makes
    Spark sort. All but the first part must be non-negative integers. A value with more
    digits than declared is an error.
    """
    if sum(d for _, d in parts) > 38:
        raise ValueError("more than 38 digits")
    out = None
    for x, digits in parts:
        part = col(x).cast(f"decimal({digits},0)")
        out = part if out is None else (out * F.lit(str(10 ** digits)).cast(f"decimal({digits + 1},0)") + part).cast("decimal(38,0)")
    return out.cast("decimal(38,0)")


def labels(*pairs):
    """Array of the labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def exact_sum(x):
    """Sum of a double column that does not depend on the order of its rows.

    One or two values have one sum of doubles, the same in every engine, and keep it. More are
    added as decimals of twelve places, what these leave of each as doubles; NaN, infinities
    and values of 1e16 and more have no such decimal and are added as they are.
    """
    x = col(x).cast("double")
    part = F.coalesce(F.when(F.abs(x) < 1e16, x.try_cast("decimal(28,12)")), F.lit(0).cast("decimal(28,12)"))
    exact = F.sum(F.when(x.isNotNull(), part)).cast("double") + F.sum(x - part.cast("double"))
    return F.when(F.count(x) <= 2, F.sum(x)).otherwise(exact)


def all_of(conds):
    return reduce(lambda a, b: a & b, conds)


def any_of(conds):
    return reduce(lambda a, b: a | b, conds)


def week_end(d):
    """Friday that closes the week of d."""
    return F.next_day(F.date_sub(col(d), 1), "FRI")


def month_end(d):
    return F.last_day(col(d))

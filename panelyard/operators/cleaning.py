"""Cleaning steps over a daily panel."""

from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.rolling import fill_forward

# Minimum listing age in days, daily price limit in percent.
MIN_LISTED_DAYS = 60
PRICE_LIMIT = 9.9


def join_dimension(df, dim, key="code", how="left"):
    """Spark chooses the join from the measured bytes of the dimension; AQE splits skewed keys."""
    return df.join(dim, key, how)


def filter_new_listings(df, master, min_days=MIN_LISTED_DAYS):
    """Drop rows younger than min_days; codes without a list date are kept."""
    dates = master.select("code", "list_date")
    return (join_dimension(df, dates)
            .where(F.col("list_date").isNull() | (F.datediff("date", "list_date") >= min_days))
            .drop("list_date"))


def filter_suspended(df):
    return df.where(F.col("volume") > 0)


def fill_suspended(df, columns=None):
    """Carry the last known value forward within a code."""
    names = columns or [c for c in df.columns if c not in ("code", "date")]
    return df.withColumns({c: fill_forward(c) for c in names})


def flag_limits(df, limit=PRICE_LIMIT):
    return df.withColumns({
        "is_limit_up": F.coalesce(F.col("change_pct") >= limit, F.lit(False)),
        "is_limit_down": F.coalesce(F.col("change_pct") <= -limit, F.lit(False))})


def flag_st(df, master):
    flags = master.select("code", F.col("is_st").alias("_st"))
    return (join_dimension(df.drop("is_st"), flags)
            .withColumn("is_st", F.coalesce("_st", F.lit(False))).drop("_st"))


def filter_st(df):
    return df.where(~F.coalesce("is_st", F.lit(False)) & F.col("close").isNotNull())


def adjust_prices(df, factors, mode="qfq", columns=("open", "high", "low", "close")):
    """Adjusted prices from per-day factors.

    ``qfq`` scales to the latest factor of the code, ``hfq`` to the earliest. A day
    without a factor takes the reference factor, so its ratio is one.
    """
    pick = F.max_by if mode == "qfq" else F.min_by
    base = factors.groupBy("code").agg(pick("adj_factor", "date").alias("_base"))
    joined = (df.join(factors.select("code", "date", "adj_factor"), ["code", "date"], "left")
              .join(base, "code", "left"))
    ratio = F.coalesce(safe_div(F.coalesce("adj_factor", "_base"), "_base"), F.lit(1.0))
    return joined.withColumns({c: F.col(c) * ratio for c in columns}).drop("adj_factor", "_base")


def semi(df, keys, on):
    """Rows whose key is in a set."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def resample(df, bucket, by=("code",)):
    """Daily bars to longer bars; bucket is a Column such as week_end('date')."""
    return (df.groupBy(*by, bucket.alias("bucket")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"), F.count("*").alias("bars"))
        .withColumnRenamed("bucket", "date"))


def latest_date(df):
    """Rows at the newest date of the table: a one-row aggregate joined back."""
    newest = df.agg(F.max("date").alias("date"))
    return df.join(F.broadcast(newest), "date", "left_semi")


def last_n(df, n, key="code", order="date"):
    """The newest n rows of each code (n at most a code's history, one row per date)."""
    from pyspark.sql import Window
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)


def latest_row(df, key="code", order="date"):
    """The newest row of each code, by partial aggregation instead of a sort."""
    keys = [key] if isinstance(key, str) else list(key)
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_row")).select(*keys, "_row.*")


def drop_repeats(df, keys, order):
    """First row per key in the given order."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return (df.groupBy(*keys).agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_row"))
            .select("_row.*"))

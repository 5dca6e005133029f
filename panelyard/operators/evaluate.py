"""Factor evaluation: information coefficients, decay, buckets, tear-sheet numbers."""

from functools import reduce

from pyspark.sql import functions as F, Window

from ..functions.columns import safe_div
from ..functions.rolling import correlation, forward_return
from ..functions.sections import DEFAULT_SPLITS, quantiles, with_avg_rank, _small
from ..session import materialize

MIN_SECTION = 10


def _pairs(df, factor, ret):
    """Rows where both sides are known, before any rank is taken."""
    return df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())


def ic_series(df, factor, ret, method="spearman", min_obs=MIN_SECTION, splits=DEFAULT_SPLITS, by=("date",)):
    """One row per section: coefficient and number of pairs."""
    pairs = _pairs(df, factor, ret).select(*by, factor, ret)
    a, b = factor, ret
    if method == "spearman":
        pairs = with_avg_rank(pairs, [factor, ret], by, splits, pct=False, suffix="__r")
        a, b = factor + "__r", ret + "__r"
    return (pairs.groupBy(*by).agg(correlation(a, b).alias("ic"), F.count("*").alias("n_obs"))
            .where((F.col("n_obs") >= min_obs) & F.col("ic").isNotNull()))


def ic_stats(series, by=(), ddof=1):
    """Mean, spread, ratio, share of positive sections, t value."""
    sd = F.stddev_samp("ic") if ddof == 1 else F.stddev_pop("ic")
    agg = [F.avg("ic").alias("ic_mean"), sd.alias("ic_std"), F.count("*").alias("n_dates"),
           F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("positive_ratio")]
    out = series.groupBy(*by).agg(*agg)
    return out.withColumns({
        "ic_ir": F.coalesce(safe_div("ic_mean", "ic_std"), F.lit(0.0)),
        "t_stat": F.coalesce(safe_div(F.col("ic_mean") * F.sqrt("n_dates"), "ic_std"), F.lit(0.0))})


def stack_pairs(df, cells):
    """Long form: one row per cell (factor, horizon) and panel row with both values known.

    A cell goes by its number: names would be moved, sorted and compared with every row.
    """
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("cell"), F.col(x).alias("x"), F.col(y).alias("y")) for i, (x, y) in enumerate(cells)]))
    return df.select("date", one.alias("_c")).select("date", "_c.*").where("x is not null and y is not null")


def ic_matrix_series(df, factors, rets, method="pearson", min_obs=MIN_SECTION, splits=DEFAULT_SPLITS):
    """Coefficients for every factor and horizon in one aggregation."""
    if method == "pearson":
        # no unpivot: partial aggregation keeps one row per date and task
        cells = [(x, y) for x in factors for y in rets]
        aggs = []
        for i, (x, y) in enumerate(cells):
            a = F.when(F.col(y).isNotNull(), F.col(x))
            b = F.when(F.col(x).isNotNull(), F.col(y))
            aggs.append(F.struct(F.lit(x).alias("factor"), F.lit(y).alias("horizon"),
                                 correlation(a, b).alias("ic"), F.count(a).alias("n_obs")).alias(f"_c{i}"))
        wide = df.groupBy("date").agg(*aggs)
        return (wide.select("date", F.explode(F.array(*[f"_c{i}" for i in range(len(cells))])).alias("_c"))
                .select("date", "_c.*").where((F.col("n_obs") >= min_obs) & F.col("ic").isNotNull()))
    cells = [(x, y) for x in factors for y in rets]
    series = ic_series(stack_pairs(df, cells), "x", "y", method, min_obs, splits, by=("date", "cell"))
    name = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in cells]), F.col("cell") + 1)
    return series.select(name(0).alias("factor"), name(1).alias("horizon"), "date", "ic", "n_obs")


def ic_matrix(df, factors, rets, method="pearson", min_obs=MIN_SECTION, splits=DEFAULT_SPLITS, ddof=1):
    return ic_stats(ic_matrix_series(df, factors, rets, method, min_obs, splits), ("factor", "horizon"), ddof)


def ic_decay(panel, factor, periods, method="spearman", min_obs=MIN_SECTION, splits=DEFAULT_SPLITS):
    """Coefficient statistics for chosen forward periods."""
    rets = {f"ret_forward_{p}d": forward_return("close", p) for p in periods}
    return ic_matrix(panel.withColumns(rets), [factor], list(rets), method, min_obs, splits)


def lag_scan(panel, factor, lags=range(1, 21), method="spearman", min_obs=30, min_dates=5,
             splits=DEFAULT_SPLITS):
    """Decay over a run of lags with t value and two-sided p; needs min_dates sections."""
    from ..functions.distributions import t_two_sided
    rets = {f"_lag_{p}": forward_return("close", p) for p in lags}
    known = panel.where(F.col(factor).isNotNull() & F.col("close").isNotNull())
    series = ic_matrix_series(known.withColumns(rets), [factor], list(rets), method, min_obs, splits)
    stats = ic_stats(series, ("horizon",)).where(F.col("n_dates") >= min_dates)
    stats = stats.withColumn("lag", F.substring_index("horizon", "_", -1).cast("int")).drop("horizon")
    return stats.withColumn("p_value", t_two_sided("t_stat", F.col("n_dates") - 1))


def optimal_lag(scan, by=()):
    """Lag with the largest absolute mean; the earliest on a tie."""
    return scan.groupBy(*by).agg(
        F.max_by("lag", F.struct(F.abs("ic_mean"), -F.col("lag"))).alias("optimal_lag"),
        F.max(F.abs("ic_mean")).alias("peak_ic"))


def half_life(scan):
    """First lag after the peak whose absolute mean is at most half the peak."""
    peak = optimal_lag(scan)
    hit = F.when((F.col("lag") > F.col("optimal_lag"))
                 & (F.abs("ic_mean") <= F.col("peak_ic") / 2), F.col("lag"))
    return scan.crossJoin(F.broadcast(peak)).groupBy("optimal_lag", "peak_ic").agg(F.min(hit).alias("half_life_lag"))


def quantile_buckets(df, factor, n=5, by=("date",), splits=DEFAULT_SPLITS, name="bucket"):
    """Equal-count buckets 1..n from interpolated edges, right-closed, equal edges merged."""
    known = df.where(F.col(factor).isNotNull())
    edges = quantiles(known, factor, [i / n for i in range(n + 1)], by, splits, "_edges")
    edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    joined = known.join(_small(edges, list(by)), list(by))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    bucket = F.size(F.filter(inner, lambda e: e < F.col(factor))) + 1
    return (joined.withColumn(name, F.when(F.size("_edges") > 1, bucket)).drop("_edges")
            .where(F.col(name).isNotNull()))


def layered_returns(bucketed, ret, bucket="bucket"):
    """Mean forward return per bucket and the spread of the outer buckets."""
    means = bucketed.where(F.col(ret).isNotNull()).groupBy(bucket).agg(
        F.avg(ret).alias("mean_ret"), F.count("*").alias("n_obs"))
    spread = means.agg((F.max_by("mean_ret", bucket) - F.min_by("mean_ret", bucket)).alias("spread"))
    return means.crossJoin(F.broadcast(spread))


def long_short_series(bucketed, ret, top=5, bottom=1, bucket="bucket"):
    """Top minus bottom mean return per date, dates with both sides only."""
    leg = lambda b: F.avg(F.when(F.col(bucket) == b, F.col(ret)))
    return (bucketed.groupBy("date").agg((leg(top) - leg(bottom)).alias("long_short"))
            .where(F.col("long_short").isNotNull()))


def long_short_sharpe(series, periods=252):
    return series.agg(
        F.avg("long_short").alias("mean_ls"), F.stddev_samp("long_short").alias("std_ls"),
        F.count("*").alias("n_dates")).withColumn(
        "sharpe", F.coalesce(safe_div(F.col("mean_ls") * F.sqrt(F.lit(float(periods))), "std_ls"), F.lit(0.0)))


def top_bucket_turnover(bucketed, top=5, bucket="bucket"):
    """1 - Jaccard of the top members of neighbouring dates, matched by code.

    Members are never gathered: each row is tagged with the date its code last
    appeared in the top bucket, then counted per date.
    """
    dates = bucketed.select("date").distinct()
    # one row per date in this window
    ordered = dates.withColumn("_prev", F.lag("date").over(Window.partitionBy(F.lit(1)).orderBy("date")))
    members = bucketed.where(F.col(bucket) == top).select("code", "date")
    w = Window.partitionBy("code").orderBy("date")
    tagged = (members.withColumn("_last", F.lag("date").over(w))
              .join(ordered, "date"))
    counts = tagged.groupBy("date").agg(
        F.first("_prev").alias("_prev"), F.count("*").alias("_n"),
        F.count(F.when(F.col("_last") == F.col("_prev"), 1)).alias("_both"))
    before = counts.select(F.col("date").alias("_prev"), F.col("_n").alias("_n0"))
    return (counts.join(before, "_prev")
            .select("date", (1 - safe_div("_both", F.col("_n") + F.col("_n0") - F.col("_both"))).alias("turnover")))


def tear_sheet(df, factor, ret, n=5, periods=252, splits=DEFAULT_SPLITS, min_obs=MIN_SECTION):
    """One row of headline numbers and a verdict (IC_IR >= 0.5 and Sharpe >= 0.8)."""
    ic = ic_stats(ic_series(df, factor, ret, "spearman", min_obs, splits))
    bucketed = quantile_buckets(df.select("code", "date", factor, ret), factor, n, splits=splits)
    layers = layered_returns(bucketed, ret).agg(F.max("spread").alias("spread"))
    sharpe = long_short_sharpe(long_short_series(bucketed, ret, n, 1), periods)
    turn = top_bucket_turnover(bucketed, n).agg(F.avg("turnover").alias("top_turnover"))
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [
        ic, layers, sharpe.select("mean_ls", "sharpe"), turn])   # four one-row tables
    return one.withColumn("verdict", F.when((F.col("ic_ir") >= 0.5) & (F.col("sharpe") >= 0.8), "ACCEPT")
                          .otherwise("REVIEW"))


def bootstrap_verdict(series, n_boot=1000, block=5, seed=42):
    """Is the mean coefficient real? Block resampling of the series per factor.

    series: factor, date, ic. A replicate is a number of draws, and a draw only needs the sum
    and the sum of squares of the block it hits, so draws are rows that meet a table of block
    sums and are added up by partial aggregation; no series is gathered. The block a draw hits
    comes from the MD5 of (seed, factor, replicate, draw), so a lost task draws the same
    sample again. The last draw of a replicate is cut to the length of the series.
    """
    one = series.groupBy("factor").agg(
        F.count(F.lit(1)).alias("n_dates"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("_sd"),
        F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("positive_ratio"))
    one = materialize(one.withColumn("ic_ir", F.coalesce(safe_div("ic_mean", "_sd"), F.lit(0.0))))
    tested = one.where((F.col("n_dates") >= 20) & (F.col("_sd") > 0)).withColumn("_draws", F.ceil(F.col("n_dates") / block))
    left = F.col("n_dates") - (F.col("_draws") - 1) * block        # values of the last draw
    by_date = Window.partitionBy("factor").orderBy("date")
    value = (series.join(tested.select("factor", "ic_mean", "n_dates", left.alias("_left")), "factor")
             .select("factor", "date", (F.col("ic") - F.col("ic_mean")).alias("_v"), "n_dates", "_left"))
    ahead = [F.lead("_v", j).over(by_date) for j in range(block)]
    value = value.select("factor", "n_dates", "_left", (F.row_number().over(by_date) - 1).alias("_start"), F.array("_v", *ahead[1:]).alias("_w"))
    total = lambda f, n: F.aggregate(F.slice("_w", F.lit(1), n), F.lit(0.0), lambda a, v: a + f(v))
    sums = value.where(F.col("_start") <= F.col("n_dates") - block)
    sums = sums.select("factor", "_start", *[total(f, n).alias(k) for k, f, n in (
        ("_s", lambda v: v, F.lit(block)), ("_q", lambda v: v * v, F.lit(block)),
        ("_sl", lambda v: v, F.col("_left").cast("int")), ("_ql", lambda v: v * v, F.col("_left").cast("int")))])
    draws = (tested.select("factor", "n_dates", "_draws", (F.abs("ic_mean") / F.col("_sd")).alias("_seen"), F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("_rep"))
             .repartition("factor", "_rep").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_draws").cast("int")))))
    word = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "factor", "_rep", "_k")), 1, 8)
    draws = draws.withColumn("_start", F.pmod(F.conv(word, 16, 10).cast("long"), F.col("n_dates") - block + 1).cast("int"))
    is_last = F.col("_k") == F.col("_draws")
    reps = (draws.join(sums, ["factor", "_start"]).groupBy("factor", "_rep", "n_dates", "_seen")
            .agg(F.sum(F.when(is_last, F.col("_sl")).otherwise(F.col("_s"))).alias("_m"), F.sum(F.when(is_last, F.col("_ql")).otherwise(F.col("_q"))).alias("_d")))
    reps = reps.withColumn("_m", F.col("_m") / F.col("n_dates"))
    reps = reps.withColumn("_d", F.sqrt(F.greatest(F.col("_d") / F.col("n_dates") - F.col("_m") * F.col("_m"), F.lit(0.0))))
    hit = F.abs(safe_div("_m", "_d")) >= F.col("_seen")
    p = reps.groupBy("factor").agg((F.count(F.when(hit, 1)) / F.lit(float(n_boot))).alias("bootstrap_p"))
    out = one.drop("_sd").join(p, "factor", "left").withColumn("bootstrap_p", F.coalesce("bootstrap_p", F.lit(1.0)))
    strong, fair = F.abs("ic_ir") > 0.5, F.abs("ic_ir") > 0.3
    return out.withColumn("verdict", F.when((F.col("bootstrap_p") < 0.05) & strong, "ACCEPT")
                          .when((F.col("bootstrap_p") < 0.10) | fair, "REVIEW").otherwise("REJECT"))

"""Performance metrics of many equity curves at once.

Input rows: strategy_id, date, equity. A curve has one row per date, so windows and exact
percentiles per strategy are bounded by the calendar, however many strategies there are.
Undefined ratios are 0, as a report would print them.
"""

from math import e
from statistics import NormalDist

from pyspark.sql import functions as F, Window

from ..functions.columns import safe_div
from ..functions import rolling as R

DAYS = 252
RISK_FREE = 0.03
MIN_TAIL = 20

KEY = "strategy_id"


def _zero(x):
    return F.coalesce(x, F.lit(0.0))


def curve_rows(curves, key=KEY, equity="equity"):
    """Return, running peak, drawdown, position and cumulative log return of every point."""
    kw = {"key": key}
    rows = curves.where(F.col(equity).isNotNull()).select(key, "date", F.col(equity).alias("equity"))
    rows = rows.withColumns({"ret": R.pct_change("equity", 1, **kw), "peak": F.max("equity").over(R.running(key)),
                             "pos": F.row_number().over(R.history(key))})
    rows = rows.withColumns({"drawdown": safe_div("equity", "peak") - 1, "log_ret": F.when(F.col("ret") > -1, F.log1p("ret"))})
    return rows.withColumn("cum_log", F.when(F.col("ret").isNotNull(), F.sum("log_ret").over(R.running(key))))


def with_tail(rows, confidence=0.95, key=KEY):
    w = Window.partitionBy(key)
    q = F.percentile("ret", [1 - confidence, confidence]).over(w)
    return rows.withColumn("_q", q).withColumns({"q_low": F.col("_q")[0], "q_high": F.col("_q")[1]}).drop("_q")


def _sd(x):
    return F.stddev_samp(x)


def expected_max_sharpe(n_trials):
    """Factor of sqrt(1/n_obs) in the expected best Sharpe ratio among n_trials."""
    if n_trials <= 1:
        return 0.0
    n, gamma = NormalDist(), 0.5772156649
    return (1 - gamma) * n.inv_cdf(1 - 1 / n_trials) + gamma * n.inv_cdf(1 - 1 / (n_trials * e))


def all_metrics(curves, risk_free=RISK_FREE, days=DAYS, n_trials=10, key=KEY):
    """Every single-curve metric in one aggregation per strategy."""
    rows = with_tail(curve_rows(curves, key), key=key)
    r, dd, root = F.col("ret"), F.col("drawdown"), F.sqrt(F.lit(float(days)))
    agg = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_points"), F.count("ret").alias("n_returns"),
        F.min_by("equity", "date").alias("_first"), F.max_by("equity", "date").alias("_last"),
        F.avg("ret").alias("_mean"), _sd("ret").alias("_sd"), F.min("drawdown").alias("max_drawdown"),
        _sd(F.when(r < 0, r)).alias("_down"), F.count(F.when(r < 0, 1)).alias("_n_down"),
        F.sqrt(F.avg(F.when(r < 0, r * r).when(r.isNotNull(), 0.0))).alias("_down_rms"),
        F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("win_rate"),
        R.sample_skew("ret").alias("skewness"), R.sample_kurt("ret").alias("kurtosis"),
        F.max("ret").alias("best_day"), F.min("ret").alias("worst_day"),
        F.first("q_low").alias("_q_low"), F.first("q_high").alias("_q_high"),
        F.avg(F.when(r <= F.col("q_low"), r)).alias("_tail"),
        F.sum(F.when(r > 0, r)).alias("_gain"), F.sum(F.when(r < 0, -r)).alias("_loss"),
        F.sqrt(F.avg(F.when(dd < 0, dd * dd))).alias("ulcer_index"), F.avg(F.abs(dd)).alias("_abs_dd"),
        R.correlation("pos", "cum_log").alias("_line"))
    growth = safe_div("_last", "_first")
    c = F.col
    out = agg.withColumns({
        "total_return": _zero(growth - 1), "annual_return": _zero(F.pow(growth, days / c("n_points")) - 1),
        "annual_return_by_returns": _zero(F.pow(growth, safe_div(F.lit(float(days)), "n_returns")) - 1),
        "volatility": _zero(c("_sd") * root)})
    excess = c("_mean") * days - risk_free
    enough = c("n_returns") >= MIN_TAIL
    out = out.withColumns({
        "sharpe": _zero(safe_div(excess, "volatility")),
        "sharpe_compound": _zero(safe_div(c("annual_return_by_returns") - risk_free, "volatility")),
        "sortino": _zero(F.when(c("_n_down") >= 2, safe_div(excess, c("_down") * root))),
        "sortino_compound": _zero(safe_div(c("annual_return_by_returns") - risk_free, c("_down") * root)),
        "sortino_rms": _zero(safe_div(excess, c("_down_rms") * root)),
        "calmar": _zero(safe_div("annual_return", F.abs("max_drawdown"))),
        "var_95": _zero(F.when(enough, -c("_q_low"))), "cvar_95": _zero(F.when(enough, -c("_tail"))),
        "omega": safe_div("_gain", "_loss"), "gain_to_pain": safe_div("_gain", "_loss"),
        "profit_factor": safe_div("_gain", "_loss"), "ulcer_index": _zero(c("ulcer_index")),
        "tail_ratio": _zero(F.abs(safe_div("_q_high", "_q_low"))), "stability_r2": _zero(c("_line") * c("_line")),
        "skewness": _zero(c("skewness")), "kurtosis": _zero(c("kurtosis"))})
    over = c("annual_return_by_returns") - risk_free
    s, n = c("sharpe"), c("n_returns")
    spread = (1 + 0.5 * s * s - c("skewness") * s + (c("kurtosis") - 3) / 4 * s * s) / F.nullif(n - 1, F.lit(0))
    best = expected_max_sharpe(n_trials) * F.sqrt(safe_div(F.lit(1.0), n))
    sr = safe_div(c("_mean") - risk_free / days, "_sd") * root
    fat = F.when(c("kurtosis") + 3 <= 3, F.lit(3.0001)).otherwise(c("kurtosis") + 3)
    denom = 1 - c("skewness") * sr + (fat - 1) / 4 * sr * sr
    out = out.withColumns({
        "upi": _zero(safe_div(over, "ulcer_index")), "serenity": _zero(safe_div(over, "_abs_dd")),
        "deflated_sharpe": F.when((F.lit(n_trials) <= 1) | (n <= 1), s).when(spread > 0, safe_div(s - best, F.sqrt(spread))).otherwise(s - best),
        "deflated_sharpe_moment": _zero(F.when(denom > 0, safe_div(sr, F.sqrt(denom))))})
    return out.drop(*[x for x in out.columns if x.startswith("_")])


METRICS = ["total_return", "annual_return", "annual_return_by_returns", "volatility", "sharpe", "sharpe_compound", "sortino",
           "sortino_compound", "sortino_rms", "max_drawdown", "calmar", "win_rate", "var_95", "cvar_95", "omega", "gain_to_pain",
           "profit_factor", "ulcer_index", "upi", "serenity", "tail_ratio", "stability_r2", "skewness", "kurtosis", "best_day",
           "worst_day", "deflated_sharpe", "deflated_sharpe_moment"]


def aligned_returns(curves, benchmark, key=KEY):
    """Returns of every curve beside the benchmark's on the same date.

    A benchmark with several rows on a date counts once, with their mean.
    """
    mine = curve_rows(curves, key).where("ret is not null").select(key, "date", "ret")
    one = curve_rows(benchmark.withColumn(key, F.lit("benchmark")), key).where("ret is not null")
    return mine.join(one.groupBy("date").agg(F.avg("ret").alias("bench")), "date")


def benchmark_metrics(curves, benchmark, risk_free=RISK_FREE, days=DAYS, key=KEY):
    """Alpha and beta in three variants, information ratio, capture, benchmark figures."""
    a = aligned_returns(curves, benchmark, key)
    up, down = F.col("bench") > 0, F.col("bench") < 0
    agg = a.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_common"), F.avg("ret").alias("_mp"), F.avg("bench").alias("_mb"),
        F.covar_samp("ret", "bench").alias("_cov"), F.var_samp("bench").alias("_var"), _sd(F.col("ret") - F.col("bench")).alias("_te"),
        F.avg(F.when(up, F.col("ret"))).alias("_pu"), F.avg(F.when(up, F.col("bench"))).alias("_bu"),
        F.avg(F.when(down, F.col("ret"))).alias("_pd"), F.avg(F.when(down, F.col("bench"))).alias("_bd"))
    own = all_metrics(curves, risk_free, days, key=key).select(key, "annual_return", "total_return")
    bm = all_metrics(benchmark.withColumn(key, F.lit("benchmark")), risk_free, days, key=key).select(
        F.col("total_return").alias("benchmark_return"), F.col("volatility").alias("benchmark_volatility"),
        F.col("max_drawdown").alias("benchmark_max_drawdown"))
    out = agg.join(own, key).crossJoin(F.broadcast(bm))   # one benchmark row
    c = F.col
    b = safe_div("_cov", "_var")
    capm = days * ((c("_mp") - risk_free / days) - b * (c("_mb") - risk_free / days))
    return out.select(
        key, "n_common", _zero(b).alias("beta"), _zero(F.when(c("n_common") >= MIN_TAIL, capm)).alias("alpha_capm"),
        _zero(F.when(c("n_common") > 2, c("annual_return") - b * c("benchmark_return"))).alias("alpha_backtest"),
        _zero(c("_mp") * days - (risk_free + b * (c("_mb") * days - risk_free))).alias("alpha_extended"),
        _zero(safe_div((c("_mp") - c("_mb")) * days, c("_te") * F.sqrt(F.lit(float(days))))).alias("information_ratio"),
        _zero(safe_div("_pu", "_bu")).alias("up_capture"), _zero(safe_div("_pd", "_bd")).alias("down_capture"),
        "benchmark_return", "benchmark_volatility", "benchmark_max_drawdown",
        (c("total_return") - c("benchmark_return")).alias("excess_return"))


def drawdown_summary(curves, key=KEY):
    """Runs below the peak: count, depth, length, and rows from the end of a run to recovery."""
    rows = curve_rows(curves, key)
    under = F.col("drawdown") < 0
    rows = rows.withColumns({"_run": F.sum(F.when(under, 0).otherwise(1)).over(R.running(key)), "_next": R.lead("pos", 1, key=key),
                             "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    runs = rows.where(under).groupBy(key, "_run").agg(
        F.min("drawdown").alias("depth"), F.count(F.lit(1)).alias("days"), F.max("pos").alias("_end"),
        F.max_by(F.coalesce("_next", F.col("_n") + 1), "pos").alias("_back"))
    have = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("dd_count"), F.avg("depth").alias("avg_depth"), F.min("depth").alias("max_depth"),
        F.max("days").alias("max_duration"), F.max(F.col("_back") - F.col("_end")).alias("max_recovery"))
    every = curves.select(key).distinct().join(have, key, "left")
    return every.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("dd_count", "max_duration", "max_recovery")}
                             ).withColumns({x: _zero(F.col(x)) for x in ("avg_depth", "max_depth")})


def monthly_returns(curves, key=KEY):
    """Compounded return per month."""
    rows = curve_rows(curves, key).where("ret is not null")
    return rows.groupBy(key, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.expm1(F.sum("log_ret")).alias("month_return"))


def monthly_table(curves, key=KEY):
    """Year by month, twelve columns."""
    wide = monthly_returns(curves, key).groupBy(key, "year").pivot("month", list(range(1, 13))).agg(F.first("month_return"))
    return wide.withColumnsRenamed({str(m): f"m{m:02d}" for m in range(1, 13)})


def segment_consistency(curves, length=252, key=KEY):
    """Spread of the annualized return-to-risk ratio over consecutive segments.

    Segments share a point, so the return reaching row i belongs to segment (i - 2) // length.
    """
    rows = curve_rows(curves, key).where("ret is not null")
    seg = rows.groupBy(key, F.floor((F.col("pos") - 2) / length).alias("segment")).agg(
        F.avg("ret").alias("_m"), _sd("ret").alias("_s"), F.count(F.lit(1)).alias("_n")).where("_n >= 2 and _s > 0")
    seg = seg.withColumn("seg_sharpe", (F.pow(1 + F.col("_m"), F.lit(252.0)) - 1) / (F.col("_s") * F.sqrt(F.lit(252.0))))
    # deviations from the mean: a spread beyond the largest double is infinite, which stddev_samp would make NaN
    off = F.col("seg_sharpe") - F.avg("seg_sharpe").over(Window.partitionBy(key))
    out = seg.withColumn("_d2", off * off).groupBy(key).agg(F.count(F.lit(1)).alias("segment_count"), F.sum("_d2").alias("_d2"))
    spread = F.sqrt(F.col("_d2") / (F.col("segment_count") - 1))
    out = out.withColumn("seg_ir_std", F.when(F.col("segment_count") >= 2, spread)).drop("_d2")
    return out.withColumn("seg_ir_std", F.when(F.col("segment_count") >= 2, F.col("seg_ir_std")).otherwise(0.0))


# The five gates of the verdict.
GATES = {"sharpe": 0.8, "calmar": 0.5, "max_drawdown": 0.35, "trades": 50, "segments": 0.5}


def judge(metrics, segments, trades, gates=GATES, key=KEY):
    """candidate or rejected, with the failed and skipped gates. trades: key, trade_count."""
    from ..functions.columns import labels
    j = metrics.select(key, "sharpe", "calmar", "max_drawdown").join(segments, key, "left").join(trades, key, "left")
    # na.fill would also turn NaN, an unknown spread, into the best one
    j = j.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in (("trade_count", 0), ("segment_count", 0), ("seg_ir_std", 0.0))})
    c = F.col
    skip = c("segment_count") < 2
    failed = labels(("sharpe", c("sharpe") < gates["sharpe"]), ("calmar", c("calmar") < gates["calmar"]),
                    ("max_drawdown", F.abs("max_drawdown") > gates["max_drawdown"]), ("trades", c("trade_count") < gates["trades"]),
                    ("segments", ~skip & (c("seg_ir_std") > gates["segments"])))
    return j.withColumns({"failed_gates": failed, "skipped_gates": labels(("segments", skip))}).withColumn(
        "state", F.when(F.size("failed_gates") > 0, "rejected").otherwise("candidate"))


def turnover_stats(weights, key=KEY, days=DAYS):
    """Half the summed absolute weight changes per date, averaged over dates after the first.

    A code missing on a date has weight zero, so a gap is both a sale and, later, a
    purchase: rows are compared with the previous date of the strategy, not of the code.
    """
    dates = weights.select(key, "date").distinct()
    w = Window.partitionBy(key).orderBy("date")
    dates = dates.withColumns({"_prev": F.lag("date").over(w), "_next": F.lead("date").over(w)})
    rows = weights.join(dates, [key, "date"])
    h = Window.partitionBy(key, "code").orderBy("date")
    rows = rows.withColumns({"_w0": F.lag("weight").over(h), "_d0": F.lag("date").over(h), "_d1": F.lead("date").over(h)})
    change = F.abs(F.col("weight") - F.when(F.col("_d0") == F.col("_prev"), F.col("_w0")).otherwise(0.0))
    moves = rows.where("_prev is not null").select(key, "date", change.alias("_m"))
    # a code held before and absent on the strategy's next date was sold then
    gone = rows.where("_next is not null and (_d1 is null or _d1 <> _next)").select(key, F.col("_next").alias("date"), F.abs("weight").alias("_m"))
    per = moves.unionByName(gone).groupBy(key, "date").agg((F.sum("_m") / 2).alias("turnover"))
    return per.groupBy(key).agg(F.avg("turnover").alias("avg_daily_turnover"), (F.avg("turnover") * days).alias("annual_turnover"))


def trade_stats(trades, key=KEY, blocks=("date",)):
    """Counts, win rate, profit factor, and days from a buy to the sell that closes it.

    trades: key, code, date, seq, action, pnl. Consecutive buys keep the newest date; only
    the first sell after a buy counts. Rows of one key and code are ordered by (date, seq);
    ``blocks`` cuts that order for functions.prefix, e.g. by date and a block of seq.
    """
    from ..functions.prefix import previous
    t = previous(trades, [key, "code"], blocks, ["seq"], {"_before": "action", "_d0": "date"})
    held = F.when((F.col("action") == "sell") & (F.col("_before") == "buy"), F.datediff("date", "_d0"))
    out = t.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count(F.when(F.col("action") == "buy", 1)).alias("buy_count"),
        F.count(F.when(F.col("action") == "sell", 1)).alias("sell_count"), F.count("pnl").alias("_n"),
        F.count(F.when(F.col("pnl") > 0, 1)).alias("_wins"), F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("_gain"),
        F.sum(F.when(F.col("pnl") < 0, -F.col("pnl"))).alias("_loss"), F.avg(held).alias("avg_holding_days"))
    return out.select(key, "total_trades", "buy_count", "sell_count", _zero(safe_div("_wins", "_n")).alias("win_rate"),
                      safe_div("_gain", "_loss").alias("profit_factor"), _zero(F.col("avg_holding_days")).alias("avg_holding_days"))

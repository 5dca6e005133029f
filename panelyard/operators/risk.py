"""Risk rules on orders, portfolios and equity curves."""

from pyspark.sql import functions as F, Window

from ..functions.columns import safe_div
from ..functions import rolling as R
from .curves import KEY, curve_rows

# Limits.
MAX_WEIGHT, MAX_ORDER_RATIO, MAX_DEVIATION, LOT = 0.10, 0.02, 0.05, 100
MAX_LEVERAGE, MAX_INDUSTRY, CASH_BUFFER, MAX_TURNOVER = 1.0, 0.30, 0.05, 0.5
MAX_DAY_LOSS, MAX_WEEK_LOSS, MAX_LOSING_DAYS = 0.03, 0.05, 5
DAY_STOP, CODE_STOP, STOP_BARS = 0.02, 0.08, 20


def check_orders(orders, portfolio_value, max_weight=MAX_WEIGHT, max_ratio=MAX_ORDER_RATIO):
    """First broken rule of every order, in order of severity.

    orders: code, side, price, shares, held_shares and optional is_limit_up, is_limit_down, vwap.
    """
    have = lambda n, d: F.col(n) if n in orders.columns else F.lit(d)
    c = F.col
    amount = c("price") * c("shares")
    held = F.coalesce(have("held_shares", 0), F.lit(0)) * c("price")
    value = F.lit(float(portfolio_value))
    after = (F.when(c("side") == "buy", safe_div(held + amount, value + amount))
             .when(c("side") == "sell", F.when(value - amount > 0, safe_div(held - amount, value - amount)).otherwise(0.0))
             .otherwise(safe_div(held, value)))
    vwap = have("vwap", None).cast("double")
    bad_price = F.isnan("price") | (F.abs("price") == float("inf"))
    rule = (F.when(~((c("price") > 0) & (c("shares") > 0)), "invalid").when(c("shares") % LOT != 0, "lot_size").when(bad_price, "nan_price")
            .when(F.coalesce(have("is_limit_up", False), F.lit(False)) & (c("side") == "buy"), "limit_up")
            .when(F.coalesce(have("is_limit_down", False), F.lit(False)) & (c("side") == "sell"), "limit_down")
            .when((value > 0) & (amount / value > max_ratio), "amount_ratio").when((value > 0) & (after > max_weight), "single_weight")
            .when((vwap > 0) & (safe_div(F.abs(c("price") - vwap), vwap) > MAX_DEVIATION), "price_deviation").otherwise("passed"))
    out = orders.withColumn("rule", rule)
    return out.withColumns({"passed": c("rule") == "passed", "level": F.when(c("rule") == "passed", "info").otherwise("block")})


def _decisions(one, rules, passed_rule):
    """Long rows of the rules that hold in a one-row (or one-per-key) table."""
    keys = [k for k in one.columns if k == KEY]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(n).alias("rule"), F.lit(l).alias("level"), v.cast("double").alias("value")))
                                      for n, l, cond, v in rules]))
    nothing = F.array(F.struct(F.lit(passed_rule).alias("rule"), F.lit("info").alias("level"), F.lit(None).cast("double").alias("value")))
    out = one.select(*keys, F.explode(F.when(F.size(found) > 0, found).otherwise(nothing)).alias("_d")).select(*keys, "_d.*")
    return out.withColumn("passed", F.col("level") == "info")


def check_portfolio(weights, targets=None, industries=None):
    """Leverage, cash, industry concentration and turnover of one portfolio."""
    from .portfolio import industry_exposure
    one = weights.agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)))).alias("gross"), (1 - F.sum(F.coalesce("weight", F.lit(0.0)))).alias("cash"))
    if industries is not None:
        one = one.crossJoin(F.broadcast(industry_exposure(weights, industries).agg(F.max("exposure").alias("top_industry"))))
    else:
        one = one.withColumn("top_industry", F.lit(None).cast("double"))
    if targets is not None:
        both = weights.select("code", F.col("weight").alias("_a")).join(targets.select("code", F.col("weight").alias("_b")), "code", "full")
        moved = both.agg((F.sum(F.abs(F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0)))) / 2).alias("turnover"))
        one = one.crossJoin(F.broadcast(moved))   # one-row tables
    else:
        one = one.withColumn("turnover", F.lit(None).cast("double"))
    c = F.col
    return _decisions(one, [
        ("portfolio.leverage", "block", c("gross") > MAX_LEVERAGE + 1e-6, c("gross")), ("portfolio.cash_negative", "block", c("cash") < -1e-6, c("cash")),
        ("portfolio.cash_buffer", "warn", c("cash") < CASH_BUFFER, c("cash")),
        ("portfolio.industry_concentration", "block", c("top_industry") > MAX_INDUSTRY, c("top_industry")),
        ("portfolio.turnover", "warn", c("turnover") > MAX_TURNOVER, c("turnover"))], "portfolio.passed")


def loss_breakers(curves, key=KEY):
    """Worst day, worst five-day return and longest losing run of every curve, as decisions."""
    rows = curve_rows(curves, key).where("ret is not null")
    week = F.when(F.count("log_ret").over(R.last_rows(5, key)) >= 5, F.expm1(F.sum("log_ret").over(R.last_rows(5, key))))
    run = F.sum(F.when(F.col("ret") < 0, 0).otherwise(1)).over(R.running(key))
    rows = rows.withColumns({"_week": week, "_run": run})
    runs = rows.where("ret < 0").groupBy(key, "_run").agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.max("_n").alias("losing_days"))
    one = rows.groupBy(key).agg(F.min("ret").alias("worst_day"), F.min("_week").alias("worst_week")).join(runs, key, "left")
    c = F.col
    return _decisions(one, [
        ("circuit_breaker.daily_loss", "block", c("worst_day") < -MAX_DAY_LOSS, c("worst_day")),
        ("circuit_breaker.weekly_loss", "block", c("worst_week") < -MAX_WEEK_LOSS, c("worst_week")),
        ("circuit_breaker.consecutive_loss", "block", c("losing_days") >= MAX_LOSING_DAYS, c("losing_days"))], "circuit_breaker.passed")


def data_decisions(health, columns=("open", "high", "low", "close", "volume")):
    """pit.data_health as decisions."""
    c = F.col
    return _decisions(health, [("data.staleness", "block", c("stale"), c("age_days"))] + [
        (f"data.nan_inf.{x}", "block", c(f"bad_{x}") > 0, c(f"bad_{x}")) for x in columns], "data.passed")


def risk_report(*decisions):
    """Counts by level over any number of decision tables."""
    out = None
    for d in decisions:
        d = d.select("rule", "level", "passed")
        out = d if out is None else out.unionByName(d)
    return out.agg(F.count(F.when(~F.col("passed") & (F.col("level") == "block"), 1)).alias("n_blocked"),
                   F.count(F.when(~F.col("passed") & (F.col("level") == "warn"), 1)).alias("n_warn"),
                   F.count(F.when(F.col("passed"), 1)).alias("n_passed")).withColumn("blocked", F.col("n_blocked") > 0)


def check_weights(weights, max_weight=MAX_WEIGHT):
    return weights.agg((F.max("weight") <= max_weight).alias("max_single_weight"), (F.abs(F.sum("weight") - 1.0) < 0.001).alias("weights_sum_one"))


def portfolio_stop(navs, limit=DAY_STOP):
    """navs: start_nav, current_nav. Triggered when the day's loss reaches the limit."""
    ret = F.when(F.col("start_nav") > 0, safe_div(F.col("current_nav") - F.col("start_nav"), "start_nav")).otherwise(0.0)
    return navs.withColumn("daily_return", ret).withColumn("triggered", F.col("daily_return") <= -limit)


def code_stops(panel, limit=CODE_STOP, bars=STOP_BARS):
    """Newest close against the close ``bars`` rows back (the first one when shorter)."""
    w = Window.partitionBy("code").orderBy("date")
    base = F.coalesce(F.lag("close", bars - 1).over(w), F.first("close").over(w))
    last = panel.withColumns({"entry_price": base, "_last": F.lead("date").over(w)}).where("_last is null")
    move = safe_div(F.col("close") - F.col("entry_price"), "entry_price")
    return last.select("code", "entry_price", "close", move.alias("move"), (move <= -limit).alias("stop"))

"""Signals to returns, costs, weights, expected returns, covariance, Brinson effects."""

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, Window

from ..functions.columns import safe_div
from ..functions import rolling as R
from ..session import materialize

# Fee rates, minimum commission, lot size.
COMMISSION, MIN_COMMISSION, STAMP_TAX, TRANSFER, SLIPPAGE = 0.00025, 5.0, 0.001, 0.00002, 0.001
LOT = 100


def signal_changes(signals, key=("code",)):
    """Number of signal changes: rows whose signal differs from the code's previous one."""
    moved = signals.withColumn("_d", F.abs(R.delta("signal", 1, key=list({*key, "code"}))))
    by = [k for k in key if k != "code"]
    return moved.groupBy(*by).agg(F.count(F.when(F.col("_d") > 0, 1)).alias("trade_count"))


def tradable(signals, flags):
    """Can the signal be executed? No buying at the upper limit, no selling at the lower."""
    j = signals.join(flags.select("code", "date", "is_limit_up", "is_limit_down"), ["code", "date"])
    ok = ~((F.col("signal") > 0) & F.coalesce("is_limit_up", F.lit(False))) \
        & ~((F.col("signal") < 0) & F.coalesce("is_limit_down", F.lit(False)))
    return j.withColumn("can_trade", ok)


def trade_costs(trades, commission=COMMISSION, minimum=MIN_COMMISSION, stamp=STAMP_TAX, transfer=TRANSFER, slippage=SLIPPAGE):
    """Fill price after slippage and the fees of every trade (side, price, shares)."""
    sell = F.col("side") == "sell"
    fill = F.col("price") * F.when(sell, 1 - slippage).otherwise(1 + slippage)
    out = trades.withColumn("fill_price", fill).withColumn("amount", F.col("fill_price") * F.col("shares"))
    out = out.withColumns({
        "commission": F.greatest(F.col("amount") * commission, F.lit(minimum)),
        "stamp_tax": F.when(sell, F.col("amount") * stamp).otherwise(0.0), "transfer_fee": F.col("amount") * transfer})
    return out.withColumn("total_cost", F.col("commission") + F.col("stamp_tax") + F.col("transfer_fee"))


def portfolio_returns(signals, panel, cost_rate=COMMISSION + SLIPPAGE + STAMP_TAX / 2):
    """Daily gross and net return of holding the signalled codes in equal weight.

    A signal of 1 on a date earns the code's return to its next bar. Cost is charged on
    the weight that changes between the code's bars, entries and exits alike.
    """
    held = signals.where(F.col("signal") > 0).groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    from ..functions.sections import _small
    j = signals.join(panel.select("code", "date", "close"), ["code", "date"])
    j = j.withColumn("next_ret", R.forward_return("close", 1))
    j = j.join(_small(held, ["date"]), "date", "left")
    j = j.withColumn("weight", F.when(F.col("signal") > 0, safe_div(F.lit(1.0), "_n")).otherwise(0.0))
    j = j.withColumn("_move", F.abs(F.col("weight") - F.coalesce(R.lag("weight"), F.lit(0.0))))
    per = j.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("next_ret", F.lit(0.0))).alias("gross_return"),
                                F.sum("_move").alias("traded_weight"), F.count(F.when(F.col("weight") > 0, 1)).alias("n_held"))
    return per.withColumns({"cost": F.col("traded_weight") * cost_rate}).withColumn("net_return", F.col("gross_return") - F.col("cost"))


def to_curve(returns, column, name):
    """Equity curve of one return series: the calendar bounds its single window."""
    w = R.running("strategy_id")
    r = returns.select(F.lit(name).alias("strategy_id"), "date", F.col(column).alias("_r"))
    return r.select("strategy_id", "date", F.exp(F.sum(F.log1p("_r")).over(w)).alias("equity"))


def cost_drag(returns):
    """Gross and net total return and what costs took."""
    both = to_curve(returns, "gross_return", "gross").unionByName(to_curve(returns, "net_return", "net"))
    last = both.groupBy("strategy_id").agg((F.max_by("equity", "date") - 1).alias("total"))
    one = last.agg(F.max(F.when(F.col("strategy_id") == "gross", F.col("total"))).alias("gross_total_return"),
                   F.max(F.when(F.col("strategy_id") == "net", F.col("total"))).alias("net_total_return"))
    return one.withColumn("total_cost_drag", F.col("gross_total_return") - F.col("net_total_return"))


def rebalance_orders(targets, holdings, nav):
    """Buy and sell orders in whole lots towards target weights.

    targets: code, weight, price; holdings: code, shares, available. Sells are limited to
    available shares; codes without a target are left alone.
    """
    j = targets.join(holdings, "code", "left").na.fill({"shares": 0})
    j = j.withColumn("available", F.coalesce("available", "shares"))
    want = (F.floor(nav * F.col("weight") / F.col("price") / LOT) * LOT).cast("long")
    j = j.withColumn("target_shares", want)
    buy = F.col("target_shares") - F.col("shares")
    sell = F.col("available") - F.col("target_shares")
    side = F.when(F.col("target_shares") > F.col("shares"), F.when(buy >= LOT, "buy")) \
        .when(F.col("target_shares") < F.col("available"), F.when(sell >= LOT, "sell"))
    return (j.withColumn("side", side).where("side is not null")
            .select("code", "side", F.when(F.col("side") == "buy", buy).otherwise(sell).alias("volume"), "price"))


def equal_weights(codes):
    """1/n for every code."""
    n = codes.agg(F.count(F.lit(1)).alias("_n"))
    return codes.crossJoin(F.broadcast(n)).select(*codes.columns, (F.lit(1.0) / F.col("_n")).alias("weight"))


def expected_returns(returns, method="mean_historical", days=252, span=500, market=None, risk_free=0.02):
    """Yearly expected return per code from rows (code, date, ret).

    mean_historical and ema_historical compound; capm adds beta times the market premium,
    the market being given or the mean of all codes per date.
    """
    if method == "mean_historical":
        return returns.groupBy("code").agg((F.exp(F.sum(F.log1p("ret")) * days / F.count("ret")) - 1).alias("expected"))
    if method == "ema_historical":
        a = 2.0 / (span + 1)
        age = F.row_number().over(Window.partitionBy("code").orderBy(F.col("date").desc())) - 1
        w = F.pow(F.lit(1 - a), F.col("_age"))
        return (returns.where("ret is not null").withColumn("_age", age).groupBy("code")
                .agg((F.pow(1 + F.sum(w * F.col("ret")) / F.sum(w), F.lit(float(days))) - 1).alias("expected")))
    if method == "capm":
        from ..functions.sections import _small
        market = market if market is not None else returns.groupBy("date").agg(F.avg("ret").alias("market"))
        j = returns.join(_small(market, ["date"]), "date")
        premium = market.agg((F.exp(F.sum(F.log1p("market")) * days / F.count("market")) - 1).alias("_m"))
        b = j.groupBy("code").agg(R.regression_slope("ret", "market").alias("beta"))
        return b.crossJoin(F.broadcast(premium)).select(   # one-row premium
            "code", (risk_free + F.col("beta") * (F.col("_m") - risk_free)).alias("expected"))
    raise ValueError(f"unknown method {method}")


def alpha_expected(codes, alphas):
    """Newest alpha score per code, 0 where missing."""
    from .cleaning import latest_date
    newest = latest_date(alphas).select("code", "alpha_score")
    return codes.join(newest, "code", "left").withColumn("expected", F.coalesce("alpha_score", F.lit(0.0))).drop("alpha_score")


def covariance(returns, cells=2_000_000):
    """Sample covariance of every pair of codes over the dates known for all of them.

    Codes are hashed into blocks and each pair of blocks is one task, which multiplies two
    returns matrices of bounded size; pairs are never formed row by row. The
    blocks are sized from the counted codes and dates. Rows: code_a <= code_b, covariance.
    """
    known = returns.where("ret is not null")
    complete = known.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    total = known.agg(F.countDistinct("code").alias("_codes"))
    days = complete.crossJoin(F.broadcast(total)).where("_n = _codes").select("date")
    known = materialize(known.join(days, "date", "left_semi").select("code", "date", "ret"))      # counted, then multiplied
    size = known.agg(F.approx_count_distinct("code").alias("codes"), F.approx_count_distinct("date").alias("dates")).first()
    blocks = max(1, ceil(size["codes"] * size["dates"] / cells))
    b = F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = known.select("code", "date", "ret", b.alias("_b")).select("code", "date", "ret", "_b", F.explode(others).alias("_o"))
    rows = rows.select("code", "date", "ret", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def multiply(pdf):
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        wide = pdf.pivot(index="date", columns="code", values="ret").sort_index()
        block = pdf.drop_duplicates("code").set_index("code")["_b"]
        x = wide.to_numpy()
        if len(x) < 2:
            return pd.DataFrame({"code_a": [], "code_b": [], "covariance": []}).astype({"code_a": str, "code_b": str})
        x = x - x.mean(axis=0)
        names, place = np.array(wide.columns), block.reindex(wide.columns).to_numpy()
        left, right = np.flatnonzero(place == i), np.flatnonzero(place == j)
        c = x[:, left].T @ x[:, right] / (len(x) - 1)
        a, bb = np.meshgrid(names[left], names[right], indexing="ij")
        keep = (a <= bb) if i == j else np.ones(a.shape, bool)
        first, second = np.where(a <= bb, a, bb), np.where(a <= bb, bb, a)
        return pd.DataFrame({"code_a": first[keep], "code_b": second[keep], "covariance": c[keep]})

    return rows.groupBy("_i", "_j").applyInPandas(multiply, "code_a string, code_b string, covariance double")


def weighted_returns(returns, weights):
    """Portfolio return per date: codes without a weight count as zero."""
    j = returns.join(weights.select("code", "weight"), "code", "left")
    return j.groupBy("date").agg(F.sum(F.col("ret") * F.coalesce("weight", F.lit(0.0))).alias("ret"))


def portfolio_tail(returns, confidence=0.95):
    """Historical VaR and CVaR of one return series (sign kept)."""
    q = returns.agg(F.percentile("ret", 1 - confidence).alias("value_at_risk"))
    return (returns.crossJoin(F.broadcast(q)).groupBy("value_at_risk")   # one-row quantile
            .agg(F.avg(F.when(F.col("ret") <= F.col("value_at_risk"), F.col("ret"))).alias("cvar")))


def industry_exposure(weights, industries):
    from .cleaning import join_dimension
    return join_dimension(weights, industries).groupBy("industry").agg(F.sum("weight").alias("exposure"))


def brinson(rows, mode="classic"):
    """Allocation, selection and interaction per date, checked to close.

    rows: date, industry, wp, wb, rp, rb. ``classic`` multiplies weight differences by rb;
    ``fachler`` by rb minus the benchmark's total return.
    """
    c = F.col
    total = rows.groupBy("date").agg(F.sum(c("wb") * c("rb")).alias("_rb"))
    from ..functions.sections import _small
    j = rows.join(_small(total, ["date"]), "date")
    base = c("rb") - c("_rb") if mode == "fachler" else c("rb")
    out = j.groupBy("date").agg(
        F.sum((c("wp") - c("wb")) * base).alias("allocation"), F.sum(c("wb") * (c("rp") - c("rb"))).alias("selection"),
        F.sum((c("wp") - c("wb")) * (c("rp") - c("rb"))).alias("interaction"),
        F.sum(c("wp") * c("rp") - c("wb") * c("rb")).alias("direct_excess"))
    out = out.withColumn("total_excess", c("allocation") + c("selection") + c("interaction"))
    return out.withColumn("closes", F.abs(c("total_excess") - c("direct_excess")) <= 1e-6)


def brinson_summary(per_date):
    return per_date.agg(*[F.sum(x).alias(f"{x}_cumulative") for x in ("allocation", "selection", "interaction", "total_excess")],
                        *[F.avg(x).alias(f"{x}_mean") for x in ("allocation", "selection", "interaction")],
                        F.count(F.lit(1)).alias("n_periods"))

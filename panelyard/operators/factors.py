"""Named factor columns over a panel.

Each set is a list of stages; a stage is a dict of Columns that may use the stages before
it, with the rolling windows it shares. All windows of a set have the code partitioning, so
a whole set costs one shuffle however many factors it has.
"""

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.columns import log_pos, safe_div


def apply_stages(df, stages):
    for windows, stage in stages:
        df = windows.apply(df, stage)
    return df


def three_windows():
    return R.Windows(), R.Windows(), R.Windows()


def _has(df, *names):
    return all(n in df.columns for n in names)


def null_column():
    return F.lit(None).cast("double")


def size_factor(df):
    """Log market value estimated from amount and turnover rate."""
    if _has(df, "amount", "turnover_rate"):
        return log_pos(safe_div("amount", "turnover_rate") * 100)
    return null_column()


def forward_returns(df, periods=(1, 5, 20)):
    return df.withColumns({f"ret_forward_{p}d": R.forward_return("close", p) for p in periods})


def panel_factors(df):
    """Returns, reversal, size, turnover, volatility, volume and money-flow factors."""
    w1, w2, w3 = three_windows()
    turnover = _has(df, "turnover_rate")
    flow = F.col("change_pct") if _has(df, "change_pct") else F.col("ret_1d")
    value = F.col("amount") if _has(df, "amount") else F.col("volume")
    first = {f"ret_{n}d": R.pct_change("close", n) for n in (1, 5, 20, 60)}
    first["lncap"] = size_factor(df)
    first["turnover_20d"] = w1.mean("turnover_rate", 20, 5) if turnover else null_column()
    first["turnover_5d"] = w1.mean("turnover_rate", 5, 3) if turnover else null_column()
    first["volume_20d"] = w1.mean("volume", 20, 5)
    second = {
        "reversal_5d": -F.col("ret_5d"), "reversal_20d": -F.col("ret_20d"),
        "turnover_change": safe_div("turnover_5d", "turnover_20d") - 1,
        "volatility_20d": w2.std("ret_1d", 20, 10),
        "volume_ratio": safe_div("volume", "volume_20d"),
        "money_flow_raw": flow * value,
    }
    return apply_stages(df, [
        (w1, first), (w2, second), (w3, {"money_flow_20d": w3.total("money_flow_raw", 20, 5)})])


PANEL_FACTORS = ["ret_1d", "ret_5d", "ret_20d", "ret_60d", "reversal_5d", "reversal_20d", "lncap",
                 "turnover_20d", "turnover_5d", "turnover_change", "volatility_20d", "volume_20d",
                 "volume_ratio", "money_flow_raw", "money_flow_20d"]


def true_range(high="high", low="low", close="close", **kw):
    before = R.lag(close, **kw)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def money_multiplier(tiny=0.0):
    span = F.col("high") - F.col("low") + tiny
    return safe_div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), span)


def signed_volume():
    return F.signum(R.delta("close")) * F.col("volume")


def extended_factors(df):
    """The extended library without its recursive members (see smoothing.extended_recursive)."""
    w1, w2, w3 = three_windows()
    one = {f"momentum_{n}d": R.pct_change("close", n) for n in (1, 5, 10, 20, 60, 120)}
    one.update({f"bias_{n}d": safe_div("close", w1.mean("close", n)) - 1 for n in (5, 10, 20, 60)})
    one.update({f"roc_{n}d": safe_div(R.delta("close", n), R.lag("close", n)) for n in (10, 20)})
    rate = "turnover_rate" if _has(df, "turnover_rate") else "volume"
    one.update({f"turnover_{n}d": w1.mean(rate, n) for n in (5, 20)})
    one.update({f"volume_ratio_{n}d": safe_div("volume", w1.mean("volume", n)) for n in (5, 20)})
    one.update({
        "_ma_v5": w1.mean("volume", 5), "_ma_v20": w1.mean("volume", 20),
        "_tr": true_range(), "_hl": safe_div(F.col("high") - F.col("low"), "close"),
        "_ma": w1.mean("close", 20), "_sd": w1.std("close", 20),
        "_mf": money_multiplier(1e-10) * F.col("volume"), "_sv": F.coalesce(signed_volume(), F.lit(0.0)),
        "lncap": size_factor(df),
        "intraday_range": safe_div(F.col("high") - F.col("low"), "open"),
        "intraday_return": safe_div(F.col("close") - F.col("open"), "open"),
        "volume_price_corr_20d": R.corr("volume", "close", 20),
    })
    two = {f"reversal_{n}d": -F.col(f"momentum_{n}d") for n in (1, 5, 10, 20)}
    two.update({f"volatility_{n}d": w2.std("momentum_1d", n) for n in (5, 10, 20, 60)})
    two.update({f"volume_trend_{n}d": R.pct_change(f"_ma_v{n}", n) for n in (5, 20)})
    two.update({
        "_flow": F.col("momentum_1d") * F.col("volume"),
        "atr_14": w2.mean("_tr", 14), "hl_ratio_20d": w2.mean("_hl", 20),
        "bb_width": safe_div(4 * F.col("_sd"), "_ma"),
        "bb_position": (F.col("close") - (F.col("_ma") - 2 * F.col("_sd"))) / (4 * F.col("_sd") + 1e-10),
        "cmf_20d": safe_div(w2.total("_mf", 20), w2.total("volume", 20)),
        "obv": F.sum("_sv").over(R.running()),
    })
    out = apply_stages(df, [(w1, one), (w2, two), (w3, {
        "obv_change_20d": R.pct_change("obv", 20), "money_flow_5d": w3.total("_flow", 5), "money_flow_20d": w3.total("_flow", 20)})])
    return out.drop(*[c for c in out.columns if c.startswith("_")])


EXTENDED_FACTORS = (
    [f"momentum_{n}d" for n in (1, 5, 10, 20, 60, 120)] + [f"bias_{n}d" for n in (5, 10, 20, 60)]
    + [f"roc_{n}d" for n in (10, 20)] + [f"reversal_{n}d" for n in (1, 5, 10, 20)]
    + [f"volatility_{n}d" for n in (5, 10, 20, 60)] + ["atr_14", "hl_ratio_20d"]
    + [f"volume_ratio_{n}d" for n in (5, 20)] + [f"volume_trend_{n}d" for n in (5, 20)]
    + [f"turnover_{n}d" for n in (5, 20)] + ["bb_width", "bb_position", "money_flow_5d", "money_flow_20d",
       "cmf_20d", "obv", "obv_change_20d", "lncap", "intraday_range", "intraday_return",
       "volume_price_corr_20d"])


def simple_rsi(windows, gain, loss, n, min_obs):
    up, down = windows.mean(gain, n, min_obs), windows.mean(loss, n, min_obs)
    return 100 - F.lit(100.0) / (1 + safe_div(up, down))


def registry_factors(df, windows=(1, 5, 10, 20, 60)):
    """Registry library: windows need half their length (at least one row)."""
    half = lambda n: max(n // 2, 1)
    w1, w2, w3 = three_windows()
    one = {f"ret_{n}d": R.pct_change("close", n) for n in windows}
    one.update({f"ma_ratio_{n}": safe_div("close", w1.mean("close", n, half(n))) - 1 for n in windows})
    one.update({f"volume_ratio_{n}": safe_div("volume", w1.mean("volume", n, half(n))) for n in windows})
    one.update({f"amount_chg_{n}d": R.pct_change("amount", n) if _has(df, "amount") else null_column()
                for n in windows})
    one.update({f"hl_range_{n}d": safe_div(w1.high("high", n, half(n)) - w1.low("low", n, half(n)), "close")
                for n in windows})
    one.update({f"turnover_chg_{n}d": R.pct_change("turnover_rate", n) if _has(df, "turnover_rate")
                else null_column() for n in (20, 60)})
    one["volume_ratio_5_20"] = safe_div(w1.mean("volume", 5), w1.mean("volume", 20))
    one["_r"] = R.pct_change("close", 1)
    two = {f"reversal_{n}d": -F.col(f"ret_{n}d") for n in windows}
    two.update({f"volatility_{n}d": w2.std("_r", n, half(n)) for n in windows if n > 1})
    two.update({f"skew_{n}d": w2.skew("_r", n, half(n)) for n in (20, 60)})
    two.update({f"kurt_{n}d": w2.kurt("_r", n, half(n)) for n in (20, 60)})
    two["_g"] = F.when(F.col("_r") > 0, F.col("_r")).otherwise(F.lit(0.0))
    two["_l"] = F.when(F.col("_r") < 0, -F.col("_r")).otherwise(F.lit(0.0))
    three = {f"rsi_{n}": simple_rsi(w3, "_g", "_l", n, half(n)) for n in (20, 60)}
    return apply_stages(df, [(w1, one), (w2, two), (w3, three)]).drop("_r", "_g", "_l")


REGISTRY_FACTORS = (
    [f"ret_{n}d" for n in (1, 5, 10, 20, 60)] + [f"reversal_{n}d" for n in (1, 5, 10, 20, 60)]
    + [f"ma_ratio_{n}" for n in (1, 5, 10, 20, 60)] + [f"volatility_{n}d" for n in (5, 10, 20, 60)]
    + [f"volume_ratio_{n}" for n in (1, 5, 10, 20, 60)] + [f"amount_chg_{n}d" for n in (1, 5, 10, 20, 60)]
    + [f"hl_range_{n}d" for n in (1, 5, 10, 20, 60)] + [f"turnover_chg_{n}d" for n in (20, 60)]
    + ["volume_ratio_5_20", "skew_20d", "skew_60d", "kurt_20d", "kurt_60d", "rsi_20", "rsi_60"])


def technical_factors(df):
    """Technical block without its recursive members: short minimum windows."""
    w1, w2, _ = three_windows()
    change = R.delta("close")
    one = {
        "ma5": w1.mean("close", 5, 1), "ma10": w1.mean("close", 10, 1),
        "ma20": w1.mean("close", 20, 5), "ma60": w1.mean("close", 60, 10),
        "_g": F.when(change > 0, change).otherwise(F.lit(0.0)),
        "_l": F.when(change < 0, -change).otherwise(F.lit(0.0)),
        "boll_mid": w1.mean("close", 20, 5), "_sd": w1.std("close", 20, 5),
        "_hh": w1.high("high", 14, 1), "_ll": w1.low("low", 14, 1),
        "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3, "_sv": signed_volume(),
    }
    two = {
        "rsi_14": simple_rsi(w2, "_g", "_l", 14, 1),
        "boll_ub": F.col("boll_mid") + 2 * F.col("_sd"), "boll_lb": F.col("boll_mid") - 2 * F.col("_sd"),
        "wr": safe_div(F.col("_hh") - F.col("close"), F.col("_hh") - F.col("_ll")) * -100,
        "cci": safe_div(F.col("_tp") - w2.mean("_tp", 14, 1), 0.015 * R.mean_abs_dev("_tp", 14, 1)),
        "obv": F.sum("_sv").over(R.running()),
    }
    return apply_stages(df, [(w1, one), (w2, two)]).drop("_g", "_l", "_sd", "_hh", "_ll", "_tp", "_sv")


TECHNICAL_FACTORS = ["ma5", "ma10", "ma20", "ma60", "rsi_14", "boll_mid", "boll_ub", "boll_lb", "wr", "cci", "obv"]

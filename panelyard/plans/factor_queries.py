"""Factor libraries over the weekly panel."""

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.columns import change_pct
from ..operators import expressions as X, factors as FA
from .registry import query
from .tables import DAILY, WEEKLY, daily_bars, report, weekly_bars, weekly_rows, weekly_splits


def over(n=None):
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY code ORDER BY date{frame})"


def roll(fn, x, n, mp=None, min_count=None):
    mp = n if mp is None else mp
    if fn in ("stddev_samp", "var_samp"):
        mp = max(mp, 2)
    return f"CASE WHEN count({x}) {over(n)} >= {mp} THEN {fn}({x}) {over(n)} END"


def lag(x, n=1):
    return f"lag({x}, {n}) {over()}"


def pct(x, n=1):
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def out(names, places=6, sizes=None):
    sizes = sizes or {}
    return ", ".join(f"round({n}, {sizes.get(n, places)}) + 0.0 AS {n}" for n in names)


def final(names, src="z", sizes=None, places=6):
    return f"SELECT code, CAST(date AS VARCHAR) AS date, {out(names, places, sizes)} FROM {src}"


def stage(name, src, exprs):
    return f"{name} AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in exprs.items()) + f" FROM {src})"


_PANEL = [
    stage("c0", "bars", {"change_pct": f"{pct('close')} * 100"}),
    stage("s1", "c0", {**{f"ret_{n}d": pct("close", n) for n in (1, 5, 20, 60)},
                       "lncap": "CASE WHEN amount > 0 AND turnover_rate > 0 THEN ln(amount / turnover_rate * 100) END",
                       "turnover_20d": roll("avg", "turnover_rate", 20, 5),
                       "turnover_5d": roll("avg", "turnover_rate", 5, 3), "volume_20d": roll("avg", "volume", 20, 5)}),
    stage("s2", "s1", {"reversal_5d": "-ret_5d", "reversal_20d": "-ret_20d",
                       "turnover_change": "turnover_5d / nullif(turnover_20d, 0) - 1",
                       "volatility_20d": roll("stddev_samp", "ret_1d", 20, 10),
                       "volume_ratio": "volume / nullif(volume_20d, 0)", "money_flow_raw": "change_pct * amount"}),
    stage("z", "s2", {"money_flow_20d": roll("sum", "money_flow_raw", 20, 5)})]
_BIG = {"money_flow_raw": 2, "money_flow_20d": 2, "money_flow_5d": 4}


@query("factors_panel", f"WITH {WEEKLY}, {', '.join(_PANEL)} " + final(FA.PANEL_FACTORS, sizes=_BIG))
def factors_panel(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).withColumn("change_pct", change_pct("close", R.lag("close")))
    df = FA.panel_factors(bars)
    return report(df, ["code", "date"], [(n, _BIG.get(n, 6)) for n in FA.PANEL_FACTORS])


@query("forward_returns", f"""WITH {WEEKLY} SELECT code, CAST(date AS VARCHAR) AS date,
 round(lead(close, 1) {over()} / close - 1, 6) + 0.0 AS ret_forward_1d,
 round(lead(close, 5) {over()} / close - 1, 6) + 0.0 AS ret_forward_5d,
 round(lead(close, 20) {over()} / close - 1, 6) + 0.0 AS ret_forward_20d FROM bars""")
def forward_returns(spark, sf_dir):
    df = FA.forward_returns(weekly_bars(spark, sf_dir).select("code", "date", "close"))
    return report(df, ["code", "date"], [f"ret_forward_{p}d" for p in (1, 5, 20)])


_TR = "greatest(high - low, abs(high - {p}), abs(low - {p}))".format(p=lag("close"))
_EXT = [
    stage("s1", "bars", {
        **{f"momentum_{n}d": pct("close", n) for n in (1, 5, 10, 20, 60, 120)},
        **{f"bias_{n}d": f"close / ({roll('avg', 'close', n)}) - 1" for n in (5, 10, 20, 60)},
        **{f"roc_{n}d": f"(close - {lag('close', n)}) / {lag('close', n)}" for n in (10, 20)},
        **{f"turnover_{n}d": roll("avg", "turnover_rate", n) for n in (5, 20)},
        **{f"volume_ratio_{n}d": f"volume / ({roll('avg', 'volume', n)})" for n in (5, 20)},
        "ma_v5": roll("avg", "volume", 5), "ma_v20": roll("avg", "volume", 20), "tr": _TR,
        "hl": "(high - low) / close", "ma": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20),
        "mf": "((close - low) - (high - close)) / (high - low + 1e-10) * volume",
        "sv": f"coalesce(sign(close - {lag('close')}) * volume, 0)",
        "lncap": "ln(amount / turnover_rate * 100)", "intraday_range": "(high - low) / open",
        "intraday_return": "(close - open) / open",
        "volume_price_corr_20d": f"CASE WHEN count(close) {over(20)} >= 20 AND NOT isnan(corr(volume, close) {over(20)})"
                                 f" THEN corr(volume, close) {over(20)} END"}),
    stage("s2", "s1", {
        **{f"reversal_{n}d": f"-momentum_{n}d" for n in (1, 5, 10, 20)},
        **{f"volatility_{n}d": roll("stddev_samp", "momentum_1d", n) for n in (5, 10, 20, 60)},
        **{f"volume_trend_{n}d": pct(f"ma_v{n}", n) for n in (5, 20)},
        "atr_14": roll("avg", "tr", 14), "hl_ratio_20d": roll("avg", "hl", 20), "bb_width": "4 * sd / ma",
        "bb_position": "(close - (ma - 2 * sd)) / (4 * sd + 1e-10)", "fv": "momentum_1d * volume",
        "cmf_20d": f"({roll('sum', 'mf', 20)}) / ({roll('sum', 'volume', 20)})",
        "obv": f"sum(sv) {over()}"}),
    stage("z", "s2", {"money_flow_5d": roll("sum", "fv", 5), "money_flow_20d": roll("sum", "fv", 20),
                      "obv_change_20d": pct("obv", 20)})]
_EXT_SIZES = {"money_flow_5d": 5, "money_flow_20d": 5}


@query("factors_extended", f"WITH {WEEKLY}, {', '.join(_EXT)} " + final(FA.EXTENDED_FACTORS, sizes=_EXT_SIZES))
def factors_extended(spark, sf_dir):
    df = FA.extended_factors(weekly_bars(spark, sf_dir))
    return report(df, ["code", "date"], [(n, _EXT_SIZES.get(n, 6)) for n in FA.EXTENDED_FACTORS])


def _half(n):
    return max(n // 2, 1)


def _moment(fn, x, n, mp):
    # DuckDB's skewness and kurtosis are the bias-corrected ones
    return f"CASE WHEN count({x}) {over(n)} >= {mp} THEN {fn}({x}) {over(n)} END"


_W = (1, 5, 10, 20, 60)
_REG = [
    stage("s1", "bars", {
        **{f"ret_{n}d": pct("close", n) for n in _W},
        **{f"ma_ratio_{n}": f"close / ({roll('avg', 'close', n, _half(n))}) - 1" for n in _W},
        **{f"volume_ratio_{n}": f"volume / ({roll('avg', 'volume', n, _half(n))})" for n in _W},
        **{f"amount_chg_{n}d": pct("amount", n) for n in _W},
        **{f"hl_range_{n}d": f"(({roll('max', 'high', n, _half(n))}) - ({roll('min', 'low', n, _half(n))})) / close"
           for n in _W},
        **{f"turnover_chg_{n}d": pct("turnover_rate", n) for n in (20, 60)},
        "volume_ratio_5_20": f"({roll('avg', 'volume', 5)}) / ({roll('avg', 'volume', 20)})"}),
    stage("s2", "s1", {
        **{f"reversal_{n}d": f"-ret_{n}d" for n in _W},
        **{f"volatility_{n}d": roll("stddev_samp", "ret_1d", n, _half(n)) for n in _W if n > 1},
        **{f"skew_{n}d": _moment("skewness", "ret_1d", n, _half(n)) for n in (20, 60)},
        **{f"kurt_{n}d": _moment("kurtosis", "ret_1d", n, _half(n)) for n in (20, 60)},
        "g": "CASE WHEN ret_1d > 0 THEN ret_1d ELSE 0 END", "l": "CASE WHEN ret_1d < 0 THEN -ret_1d ELSE 0 END"}),
    stage("z", "s2", {f"rsi_{n}": f"100 - 100 / (1 + ({roll('avg', 'g', n, _half(n))}) / "
                                  f"nullif(({roll('avg', 'l', n, _half(n))}), 0))" for n in (20, 60)})]
_REG_SIZES = {f"{k}_{n}d": 5 for k in ("skew", "kurt") for n in (20, 60)}


@query("factors_registry", f"WITH {WEEKLY}, {', '.join(_REG)} " + final(FA.REGISTRY_FACTORS, sizes=_REG_SIZES))
def factors_registry(spark, sf_dir):
    df = FA.registry_factors(weekly_bars(spark, sf_dir))
    return report(df, ["code", "date"], [(n, _REG_SIZES.get(n, 6)) for n in FA.REGISTRY_FACTORS])


_TECH = [
    stage("s1", "bars", {
        "ma5": roll("avg", "close", 5, 1), "ma10": roll("avg", "close", 10, 1), "ma20": roll("avg", "close", 20, 5),
        "ma60": roll("avg", "close", 60, 10), "d": f"close - {lag('close')}", "boll_mid": roll("avg", "close", 20, 5),
        "sd": roll("stddev_samp", "close", 20, 5), "hh": roll("max", "high", 14, 1), "ll": roll("min", "low", 14, 1),
        "tp": "(high + low + close) / 3"}),
    stage("s2", "s1", {
        "g": "CASE WHEN d > 0 THEN d ELSE 0 END", "l": "CASE WHEN d < 0 THEN -d ELSE 0 END", "sv": "sign(d) * volume",
        "boll_ub": "boll_mid + 2 * sd", "boll_lb": "boll_mid - 2 * sd", "wr": "(hh - close) / nullif(hh - ll, 0) * -100",
        "sma": roll("avg", "tp", 14, 1), "tps": f"list(tp) {over(14)}"}),
    stage("z", "s2", {
        "rsi_14": f"100 - 100 / (1 + ({roll('avg', 'g', 14, 1)}) / nullif({roll('avg', 'l', 14, 1)}, 0))",
        "cci": "(tp - sma) / nullif(0.015 * list_avg(list_transform(tps, lambda v: abs(v - sma))), 0)",
        "obv": f"sum(sv) {over()}"})]


@query("factors_technical", f"WITH {WEEKLY}, {', '.join(_TECH)} " + final(FA.TECHNICAL_FACTORS, sizes={"cci": 4}))
def factors_technical(spark, sf_dir):
    df = FA.technical_factors(weekly_bars(spark, sf_dir))
    return report(df, ["code", "date"], [(n, 4 if n == "cci" else 6) for n in FA.TECHNICAL_FACTORS])


_OPS = ["ts_mean", "ts_std", "ts_max", "ts_min", "ts_rank", "ts_corr", "delta", "delay", "abs_d", "exp_r", "log_v",
        "sqrt_d", "ratio"]
_OPS_SQL = [
    stage("s1", "bars", {
        "ts_mean": roll("avg", "close", 10, 5), "ts_std": roll("stddev_samp", "close", 10, 5),
        "ts_max": roll("max", "close", 10, 5), "ts_min": roll("min", "close", 10, 5),
        "cs": f"list(close) {over(10)}",
        "ts_corr": f"CASE WHEN count(close) {over(20)} >= 10 AND NOT isnan(corr(close, volume) {over(20)})"
                   f" THEN corr(close, volume) {over(20)} END",
        "delta": f"close - {lag('close', 5)}", "delay": lag("close", 5),
        "ratio": "(close - open) / nullif(high - low, 0)"}),
    stage("z", "s1", {
        "ts_rank": "CASE WHEN len(cs) >= 5 THEN (len(list_filter(cs, lambda v: v < close)) + "
                   "(len(list_filter(cs, lambda v: v = close)) + 1) / 2.0) / len(cs) END",
        "abs_d": "abs(delta)", "exp_r": "exp(ratio)", "log_v": "ln(volume)", "sqrt_d": "sqrt(abs(delta))"})]


@query("expression_rolling", f"WITH {WEEKLY}, {', '.join(_OPS_SQL)} " + final(_OPS))
def expression_rolling(spark, sf_dir):
    op = X.operator
    c, v = X.var("$close"), X.var("$volume")
    df = weekly_bars(spark, sf_dir).withColumns({
        "ts_mean": op("TS_MEAN")(c, 10), "ts_std": op("TS_STD")(c, 10), "ts_max": op("TS_MAX")(c, 10),
        "ts_min": op("TS_MIN")(c, 10), "ts_rank": op("TS_RANK")(c, 10), "ts_corr": op("TS_CORR")(c, v, 20),
        "delta": op("DELTA")(c, 5), "delay": op("DELAY")(c, 5),
        "ratio": (c - X.var("$open")) / F.nullif(X.var("$high") - X.var("$low"), F.lit(0.0))})
    df = df.withColumns({"abs_d": op("ABS")("delta"), "exp_r": op("EXP")("ratio"), "log_v": op("LOG")(v),
                         "sqrt_d": op("SQRT")("delta")})
    return report(df, ["code", "date"], _OPS)


def rank_sql(x, by="date"):
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x}) + "
            f"(count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END")


_SEC = {"rank_c": "RANK", "scale_c": "SCALE", "z_c": "ZSCORE", "mean_c": "MEAN", "std_c": "STD", "max_c": "MAX",
        "min_c": "MIN"}


@query("expression_section", f"""WITH {WEEKLY}, z AS (SELECT code, date, {rank_sql('close')} AS rank_c,
 CASE WHEN max(close) OVER d = min(close) OVER d THEN 0.5 ELSE (close - min(close) OVER d) / (max(close) OVER d - min(close) OVER d) END AS scale_c,
 CASE WHEN coalesce(stddev_samp(close) OVER d, 0) = 0 THEN 0 ELSE (close - avg(close) OVER d) / stddev_samp(close) OVER d END AS z_c,
 avg(close) OVER d AS mean_c, stddev_samp(close) OVER d AS std_c, max(close) OVER d AS max_c, min(close) OVER d AS min_c,
 {rank_sql('close', 'code')} AS full_rank_c
 FROM bars WINDOW d AS (PARTITION BY date)) """ + final([*_SEC, "full_rank_c"]))
def expression_section(spark, sf_dir):
    df = weekly_bars(spark, sf_dir).select("code", "date", "close")
    df = df.withColumn("full_rank_c", X.ts_full("RANK", "close"))
    df = X.section_ops(df, {k: (op, "close") for k, op in _SEC.items()}, splits=weekly_splits(spark, sf_dir))
    return report(df, ["code", "date"], [*_SEC, "full_rank_c"])


_PRE = ["momentum_5d", "momentum_20d", "momentum_60d", "reversal_5d", "reversal_20d", "volatility_20d", "volume_ratio",
        "volume_trend", "turnover_rank", "rsi_14", "intraday_range"]


def _zscore_sql(x):
    return (f"CASE WHEN coalesce(stddev_samp({x}) OVER (PARTITION BY date), 0) = 0 THEN 0 ELSE "
            f"({x} - avg({x}) OVER (PARTITION BY date)) / stddev_samp({x}) OVER (PARTITION BY date) END")


@query("expression_presets", f"""WITH {WEEKLY}, {stage('s1', 'bars', {
    'd1': f"close - {lag('close')}", 'd5': f"close - {lag('close', 5)}", 'd20': f"close - {lag('close', 20)}",
    'd60': f"close - {lag('close', 60)}", 'n5': f"-(close - {lag('close', 5)})",
    'n20': f"-(close - {lag('close', 20)})", 'v20': roll('avg', 'volume', 20, 10),
    'i': "CAST(row_number() OVER (PARTITION BY code ORDER BY date) AS DOUBLE)"})},
 {stage('s2', 's1', {'sd': roll('stddev_samp', 'd1', 20, 10), 'up': "CASE WHEN d1 IS NOT NULL THEN greatest(d1, 0) END * pow(13.0 / 14, -i)",
                     'down': "CASE WHEN d1 IS NOT NULL THEN greatest(-d1, 0) END * pow(13.0 / 14, -i)"})},
 {stage('z', 's2', {'momentum_5d': rank_sql('d5'), 'momentum_20d': rank_sql('d20'), 'momentum_60d': rank_sql('d60'),
  'reversal_5d': rank_sql('n5'), 'reversal_20d': rank_sql('n20'), 'volatility_20d': _zscore_sql('sd'),
  'volume_ratio': rank_sql('volume'), 'volume_trend': _zscore_sql('v20'), 'turnover_rank': rank_sql('turnover_rate'),
  'rsi_14': f"CASE WHEN count(up) {over()} >= 14 THEN 100 - 100 / (1 + sum(up) {over()} / nullif(sum(down) {over()}, 0)) END", 'intraday_range': rank_sql('d1')})} """ + final(_PRE))
def expression_presets(spark, sf_dir):
    df = X.compute_presets(weekly_bars(spark, sf_dir), _PRE, weekly_splits(spark, sf_dir), weekly_rows(spark, sf_dir))
    return report(df, ["code", "date"], _PRE)


@query("expression_user_operators", f"""WITH {DAILY}, {stage('s1', 'bars', {'mid': '(high + low) / 2'})},
 {stage('s2', 's1', {'gap': f"mid - {lag('mid')}"})}, {stage('z', 's2', {'gap_mean': roll('avg', 'gap', 3, 3),
 'gap_share': 'gap / nullif(mid, 0)'})} """ + final(["mid", "gap", "gap_mean", "gap_share"]))
def expression_user_operators(spark, sf_dir):
    X.register("MIDPRICE", lambda a, b: (F.col(a) + F.col(b)) / 2)
    made = (X.FactorSet().add("gap_share", lambda: F.col("gap") / F.nullif(F.col("mid"), F.lit(0.0)), ["gap", "mid"])
            .add("gap_mean", lambda: R.mean("gap", 3), ["gap"]).add("gap", lambda: R.delta("mid"), ["mid"])
            .add("mid", lambda: X.operator("MIDPRICE")("high", "low")))
    return report(made.compute(daily_bars(spark, sf_dir)), ["code", "date"], ["mid", "gap", "gap_mean", "gap_share"])

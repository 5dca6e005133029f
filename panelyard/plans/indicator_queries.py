"""Technical indicators over the weekly panel.

The SQL twins write each exponential mean in closed form, from powers of the decay.
"""

from ..operators import indicators as I, smoothing as S
from .factor_queries import final, lag, over, pct, roll, stage
from .registry import query
from .tables import WEEKLY, report, weekly_bars, weekly_rows

POS = "numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY date) AS DOUBLE) AS i FROM bars)"


def ewm_ctes(src, name, specs):
    """CTE texts and the last name. specs: out -> (x, kind, alpha, n) with kind
    'adjust' (n = least count), 'plain' (started at the first value) or 'seeded'."""
    first = {f"f_{o}": f"min(CASE WHEN {x} IS NOT NULL THEN i END) OVER (PARTITION BY code)"
             for o, (x, *_) in specs.items()}
    seed, value = {}, {}
    for o, (x, kind, a, n) in specs.items():
        g = f"(1 - {a})"
        if kind == "adjust":
            value[o] = (f"CASE WHEN count({x}) {over()} >= {n} THEN sum({x} * pow({g}, -i)) {over()} / "
                        f"sum(CASE WHEN {x} IS NOT NULL THEN pow({g}, -i) END) {over()} END")
            continue
        n = 1 if kind == "plain" else n
        s = f"(f_{o} + {n - 1})"
        seed[f"s_{o}"] = f"avg(CASE WHEN i <= {s} THEN {x} END) OVER (PARTITION BY code)"
        value[o] = (f"CASE WHEN i >= {s} THEN pow({g}, i - {s}) * s_{o} + {a} * pow({g}, i) * "
                    f"coalesce(sum(CASE WHEN i > {s} THEN {x} * pow({g}, -i) END) {over()}, 0) END")
    ctes = [stage(f"{name}_f", src, first)]
    last = f"{name}_f"
    if seed:
        ctes.append(stage(f"{name}_s", last, seed))
        last = f"{name}_s"
    ctes.append(stage(name, last, value))
    return ctes, name


def chain(*parts):
    """CTE list from stage texts and (specs-name, specs) pairs applied in order."""
    out, src = [], None
    for p in parts:
        if isinstance(p, str):
            out.append(p)
            src = p.split(" AS ")[0]
        else:
            name, specs = p
            if callable(specs):
                specs = specs()
            texts, src = ewm_ctes(src, name, specs)
            out += texts
    return ", ".join(out), src


def run(names, places=6, sizes=None):
    sizes = sizes or {}

    def go(spark, sf_dir):
        df = I.indicators(weekly_bars(spark, sf_dir), names, weekly_rows(spark, sf_dir))
        return report(df, ["code", "date"], [(n, sizes.get(n, places)) for n in names])
    return go


OVERLAP = [*(f"ma_{n}" for n in I.MA_WINDOWS), "ma", "trima", "wma", "midpoint", "midprice", "bbands_upper",
           "bbands_middle", "bbands_lower", "bollinger_upper", "bollinger_middle", "bollinger_lower"]
_SD = f"CASE WHEN count(close) {over(20)} >= 20 THEN stddev_pop(close) {over(20)} END"
_OVERLAP_SQL = [POS, stage("s1", "numbered", {
    **{f"ma_{n}": roll("avg", "close", n) for n in I.MA_WINDOWS}, "ma": roll("avg", "close", 30),
    "sma16": roll("avg", "close", 16), "xi": "close * i", "sd": _SD,
    "midpoint": f"(({roll('max', 'close', 14)}) + ({roll('min', 'close', 14)})) / 2",
    "midprice": f"(({roll('max', 'high', 14)}) + ({roll('min', 'low', 14)})) / 2"}),
    stage("z", "s1", {
        "trima": roll("avg", "sma16", 15),
        "wma": f"(({roll('sum', 'xi', 30)}) - (i - 30) * ({roll('sum', 'close', 30)})) / 465",
        **{f"{p}_{k}": f"ma_20 + {m} * sd" for p in ("bbands", "bollinger")
           for k, m in (("upper", 2), ("middle", 0), ("lower", -2))}})]
query("indicators_overlap", f"WITH {WEEKLY}, {', '.join(_OVERLAP_SQL)} " + final(OVERLAP, places=5))(run(OVERLAP, 5))

MOMENTUM = ["apo", "ppo", "aroon_up", "aroon_down", "aroonosc", "bop", "cci", "mfi", "mom", "roc", "rocp", "rocr",
            "rocr100", "stochf_k", "stochf_d", "stoch_k", "stoch_d", "ultosc", "willr"]
_AROON = ("CASE WHEN count({x}) {w} >= 15 THEN 100 * (1 - (i - arg_max(i, ({s}{x}, i)) {w}) / 14.0) END")


def _arn(x, s):
    return _AROON.format(x=x, s=s, w=over(15))


_MOM_SQL = [POS, stage("s1", "numbered", {
    "ma12": roll("avg", "close", 12), "ma26": roll("avg", "close", 26), "aroon_up": _arn("high", ""),
    "aroon_down": _arn("low", "-"), "bop": "(close - open) / nullif(high - low, 0)", "tp": "(high + low + close) / 3",
    "mom": f"close - {lag('close', 10)}", "roc": f"100 * {pct('close', 10)}", "rocp": pct("close", 10),
    "rocr": f"close / {lag('close', 10)}", "rocr100": f"100 * (close / {lag('close', 10)})",
    "k0": f"100 * (close - ({roll('min', 'low', 5)})) / nullif(({roll('max', 'high', 5)}) - ({roll('min', 'low', 5)}), 0)",
    "pc": lag("close"), "willr": f"-100 * (({roll('max', 'high', 14)}) - close) / "
                                 f"nullif(({roll('max', 'high', 14)}) - ({roll('min', 'low', 14)}), 0)"}),
    stage("s2", "s1", {
        "apo": "ma12 - ma26", "ppo": "100 * (ma12 - ma26) / ma26", "aroonosc": "aroon_up - aroon_down",
        "tps": f"list(tp) {over(14)}", "tpm": roll("avg", "tp", 14), "mf": "tp * volume", "dtp": f"tp - {lag('tp')}",
        "stochf_k": "k0", "stochf_d": roll("avg", "k0", 3), "stoch_k": roll("avg", "k0", 3),
        "bp": "CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END",
        "tr": "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"}),
    stage("s3", "s2", {
        "cci": "CASE WHEN tpm IS NOT NULL THEN (tp - tpm) / nullif(0.015 * list_avg(list_transform(tps, lambda v: abs(v - tpm))), 0) END",
        "pos": "CASE WHEN dtp IS NOT NULL THEN CASE WHEN dtp > 0 THEN mf ELSE 0 END END",
        "neg": "CASE WHEN dtp IS NOT NULL THEN CASE WHEN dtp < 0 THEN mf ELSE 0 END END",
        "stoch_d": roll("avg", "stoch_k", 3),
        "ultosc": "100 * (" + " + ".join(f"{w} * (({roll('sum', 'bp', n)}) / nullif(({roll('sum', 'tr', n)}), 0))"
                                         for w, n in ((4, 7), (2, 14), (1, 28))) + ") / 7"}),
    stage("z", "s3", {"mfi": f"100 * ({roll('sum', 'pos', 14)}) / nullif(({roll('sum', 'pos', 14)}) + ({roll('sum', 'neg', 14)}), 0)"})]
query("indicators_momentum", f"WITH {WEEKLY}, {', '.join(_MOM_SQL)} " + final(MOMENTUM, places=5))(run(MOMENTUM, 5))

OTHER = ["ad", "obv", "trange", "avgprice", "medprice", "typprice", "wclprice", "beta", "correl", "linearreg",
         "linearreg_slope", "linearreg_intercept", "linearreg_angle", "tsf", "stddev", "var"]
_VAR_SIZE = {"var": 3}


def _safe_slope(y, x, n):
    both = f"CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN 1 END"
    xx = f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    return (f"CASE WHEN count({both}) {over(n)} >= {n} THEN covar_pop({y}, {x}) {over(n)} / "
            f"nullif(var_pop({xx}) {over(n)}, 0) END")


_OTHER_SQL = [POS, stage("s1", "numbered", {
    "mfv": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0)",
    "sv": f"coalesce(sign(close - {lag('close')}) * volume, 0)", "pc": lag("close"),
    "avgprice": "(open + high + low + close) / 4", "medprice": "(high + low) / 2", "typprice": "(high + low + close) / 3",
    "wclprice": "(high + low + 2 * close) / 4", "rh": pct("high"), "rl": pct("low"),
    "correl": f"CASE WHEN count(close) {over(30)} >= 30 THEN corr(high, low) {over(30)} END",
    "linearreg_slope": _safe_slope("close", "i", 14), "m14": roll("avg", "close", 14),
    "stddev": roll("stddev_samp", "close", 5), "var": roll("var_samp", "close", 5)}),
    stage("z", "s1", {
        "ad": f"sum(mfv) {over()}", "obv": f"sum(sv) {over()}",
        "trange": "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END",
        "beta": _safe_slope("rl", "rh", 5), "linearreg": "m14 + 6.5 * linearreg_slope",
        "linearreg_intercept": "m14 - 6.5 * linearreg_slope",
        "linearreg_angle": "degrees(atan(linearreg_slope))", "tsf": "m14 + 7.5 * linearreg_slope"})]
query("indicators_other", f"WITH {WEEKLY}, {', '.join(_OTHER_SQL)} " + final(OTHER, places=5, sizes=_VAR_SIZE))(
    run(OTHER, 5, _VAR_SIZE))


def _k(n):
    return f"(2.0 / {n + 1})"


def _ema(n):
    return ("close", "seeded", _k(n), n)


AVERAGES = ["ema", "ema_5", "ema_10", "ema_20", "ema_60", "dema", "tema", "t3", "macd", "macd_signal", "macd_hist", "trix"]
_AVG, _ = chain(
    POS,
    ("a1", {"ema": _ema(30), **{f"ema_{n}": _ema(n) for n in (5, 10, 20, 60)}, "e12": _ema(12), "e26": _ema(26)}),
    stage("a2", "a1", {"macd": "e12 - e26"}),
    ("a3", {"ee30": ("ema", "seeded", _k(30), 30), "t5_2": ("ema_5", "seeded", _k(5), 5),
            "macd_signal": ("macd", "seeded", _k(9), 9)}),
    ("a4", {"eee30": ("ee30", "seeded", _k(30), 30), "t5_3": ("t5_2", "seeded", _k(5), 5)}),
    ("a5", {"t5_4": ("t5_3", "seeded", _k(5), 5)}), ("a6", {"t5_5": ("t5_4", "seeded", _k(5), 5)}),
    ("a7", {"t5_6": ("t5_5", "seeded", _k(5), 5)}),
    stage("z", "a7", {"dema": "2 * ema - ee30", "tema": "3 * ema - 3 * ee30 + eee30", "macd_hist": "macd - macd_signal",
                      "trix": f"100 * {pct('eee30')}",
                      "t3": "-0.343 * t5_6 + 3 * (0.49 + 0.343) * t5_5 - 3 * (2 * 0.49 + 0.7 + 0.343) * t5_4 "
                            "+ (1 + 2.1 + 0.343 + 3 * 0.49) * t5_3"}))
query("indicators_averages", f"WITH {WEEKLY}, {_AVG} " + final(AVERAGES, places=4))(run(AVERAGES, 4))

WILDER = ["rsi", "cmo", "atr", "natr", "plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx", "adxr",
          "stochrsi_k", "stochrsi_d", "adosc"]
_W = "(1.0 / 14)"
_WIL, _ = chain(
    POS,
    stage("b1", "numbered", {
        "d": f"close - {lag('close')}", "pc": lag("close"), "up": f"high - {lag('high')}", "dn": f"{lag('low')} - low",
        "mfv": "coalesce((2 * close - high - low) / nullif(high - low, 0) * volume, 0)"}),
    stage("b2", "b1", {
        "g": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "l": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END",
        "tr": "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END",
        "pm": "CASE WHEN up > dn AND up > 0 THEN up WHEN up IS NOT NULL THEN 0 END",
        "mm": "CASE WHEN dn > up AND dn > 0 THEN dn WHEN dn IS NOT NULL THEN 0 END", "adl": f"sum(mfv) {over()}"}),
    ("b3", {"ag": ("g", "adjust", _W, 14), "al": ("l", "adjust", _W, 14), "atr": ("tr", "adjust", _W, 14),
            "plus_dm": ("pm", "adjust", _W, 14), "minus_dm": ("mm", "adjust", _W, 14),
            "ad3": ("adl", "seeded", _k(3), 3), "ad10": ("adl", "seeded", _k(10), 10)}),
    stage("b4", "b3", {
        "rsi": "100 - 100 / (1 + ag / nullif(al, 0))", "cmo": "100 * (ag - al) / nullif(ag + al, 0)", "natr": "100 * atr / close",
        "plus_di": "100 * plus_dm / nullif(atr, 0)", "minus_di": "100 * minus_dm / nullif(atr, 0)", "adosc": "ad3 - ad10"}),
    stage("b5", "b4", {"dx": "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)",
                       "sr": f"100 * (rsi - ({roll('min', 'rsi', 14)})) / nullif(({roll('max', 'rsi', 14)}) - ({roll('min', 'rsi', 14)}), 0)"}),
    ("b6", {"adx": ("dx", "adjust", _W, 14)}),
    stage("b7", "b6", {"adxr": f"(adx + {lag('adx', 14)}) / 2", "stochrsi_k": roll("avg", "sr", 5)}),
    stage("z", "b7", {"stochrsi_d": roll("avg", "stochrsi_k", 3)}))
query("indicators_wilder", f"WITH {WEEKLY}, {_WIL} " + final(WILDER, places=4))(run(WILDER, 4))

_K = "(2.0 / 3 - 2.0 / 31)"
_PATH = f"""{POS.replace("CAST(row_number() OVER (PARTITION BY code ORDER BY date) AS DOUBLE) AS i", "row_number() OVER (PARTITION BY code ORDER BY date) AS k, count(*) OVER (PARTITION BY code) AS n")},
 pd AS (SELECT *, abs(close - {lag('close')}) AS step, {lag('high')} AS h1, {lag('low')} AS l1, coalesce({lag('low', 2)}, {lag('low')}) AS l2 FROM numbered),
 pw AS (SELECT *, pow(CASE WHEN path = 0 THEN 1 ELSE net / path END * {_K} + 2.0 / 31, 2) AS w FROM (SELECT *, sum(step) {over(30)} AS path, abs(close - {lag('close', 30)}) AS net FROM pd)),
 kc AS (SELECT code, k, close AS kama FROM pw WHERE k = 30 AND n > 30
  UNION ALL SELECT p.code, p.k, kc.kama + p.w * (p.close - kc.kama) FROM kc JOIN pw p ON p.code = kc.code AND p.k = kc.k + 1),
 sc AS (SELECT code, k, up, CASE WHEN up THEN l1 ELSE h1 END AS stop, CASE WHEN up THEN high ELSE low END AS extreme, 0.02::DOUBLE AS speed, NULL::DOUBLE AS sar, FALSE AS done
   FROM (SELECT *, (high - h1) >= (l1 - low) AS up FROM pw WHERE k = 2)
  UNION ALL SELECT code, k, up2, sar + speed2 * (extreme2 - sar), extreme2, speed2, sar, TRUE FROM (
   SELECT *, CASE WHEN crossed THEN (CASE WHEN up2 THEN high ELSE low END) WHEN further THEN (CASE WHEN up THEN high ELSE low END) ELSE extreme END AS extreme2,
     CASE WHEN crossed THEN 0.02 WHEN further THEN least(speed + 0.02, 0.2) ELSE speed END AS speed2,
     CASE WHEN NOT crossed THEN s1 WHEN up2 THEN least(extreme, low) ELSE greatest(extreme, high) END AS sar FROM (
    SELECT *, crossed <> up AS up2, CASE WHEN up THEN high > extreme ELSE low < extreme END AS further FROM (
     SELECT *, CASE WHEN up THEN low < s1 ELSE high > s1 END AS crossed FROM (
      SELECT p.code, p.k, p.high, p.low, sc.up, sc.extreme, sc.speed, CASE WHEN sc.up THEN least(sc.stop, p.l1, p.l2) ELSE greatest(sc.stop, p.h1, coalesce(p.h2, p.h1)) END AS s1
      FROM sc JOIN (SELECT *, {lag('high', 2)} AS h2 FROM pw) p ON p.code = sc.code AND p.k = sc.k + CASE WHEN sc.done THEN 1 ELSE 0 END))))),
 z AS (SELECT pw.code, pw.date, kc.kama, sc.sar FROM pw LEFT JOIN kc ON kc.code = pw.code AND kc.k = pw.k LEFT JOIN sc ON sc.code = pw.code AND sc.k = pw.k AND sc.done)"""
query("indicators_path_dependent", f"WITH RECURSIVE {WEEKLY}, {_PATH} " + final(["kama", "sar"], places=4))(run(["kama", "sar"], 4))

EXT_R = list(S.EXTENDED)
_EXTR, _ = chain(
    POS,
    stage("c1", "numbered", {
        "d": f"close - {lag('close')}",
        "rsv": f"(close - ({roll('min', 'low', 9)})) / (({roll('max', 'high', 9)}) - ({roll('min', 'low', 9)}) + 1e-10) * 100"}),
    stage("c2", "c1", {"g": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END",
                       "l": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END"}),
    ("c3", {"e12": ("close", "adjust", _k(12), 1), "e26": ("close", "adjust", _k(26), 1),
            **{f"{x}{n}": (x, "adjust", f"(1.0 / {n})", n) for x in ("g", "l") for n in (6, 14, 24)},
            "kdj_k": ("rsv", "adjust", "(1.0 / 3)", 3)}),
    stage("c4", "c3", {"macd": "e12 - e26"}),
    ("c5", {"macd_signal": ("macd", "adjust", "0.2", 1), "kdj_d": ("kdj_k", "adjust", "(1.0 / 3)", 3)}),
    stage("z", "c5", {"macd_hist": "macd - macd_signal", "kdj_j": "3 * kdj_k - 2 * kdj_d",
                      **{f"rsi_{n}": f"100 - 100 / (1 + g{n} / nullif(l{n}, 0))" for n in (6, 14, 24)}}))


@query("factors_extended_recursive", f"WITH {WEEKLY}, {_EXTR} " + final(EXT_R, places=4))
def factors_extended_recursive(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("code", "date", "high", "low", "close")
    return report(S.add_recursive(bars, S.EXTENDED, rows=weekly_rows(spark, sf_dir)), ["code", "date"], EXT_R, 4)


TEC_R = list(S.TECHNICAL)
_TECR, _ = chain(
    POS,
    stage("d1", "numbered", {"rsv": f"(close - ({roll('min', 'low', 9, 1)})) / nullif(({roll('max', 'high', 9, 1)}) - ({roll('min', 'low', 9, 1)}), 0) * 100"}),
    ("d2", {"e12": ("close", "plain", _k(12), 1), "e26": ("close", "plain", _k(26), 1),
            "kdj_k": ("rsv", "plain", "(1.0 / 3)", 1)}),
    stage("d3", "d2", {"macd_dif": "e12 - e26"}),
    ("d4", {"macd_dea": ("macd_dif", "plain", "0.2", 1), "kdj_d": ("kdj_k", "plain", "(1.0 / 3)", 1)}),
    stage("z", "d4", {"macd_hist": "2 * (macd_dif - macd_dea)", "kdj_j": "3 * kdj_k - 2 * kdj_d"}))


@query("factors_technical_recursive", f"WITH {WEEKLY}, {_TECR} " + final(TEC_R, places=4))
def factors_technical_recursive(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("code", "date", "high", "low", "close")
    return report(S.add_recursive(bars, S.TECHNICAL, rows=weekly_rows(spark, sf_dir)), ["code", "date"], TEC_R, 4)


OPS = ["ema_10", "rsi_14", "macd"]
_OPSR, _ = chain(
    POS, stage("e1", "numbered", {"d": f"close - {lag('close')}"}),
    stage("e2", "e1", {"g": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END",
                       "l": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END"}),
    ("e3", {"ema_10": ("close", "adjust", _k(10), 5), "m12": ("close", "adjust", _k(12), 12),
            "m26": ("close", "adjust", _k(26), 26), "ag": ("g", "adjust", _W, 14), "al": ("l", "adjust", _W, 14)}),
    stage("z", "e3", {"rsi_14": "100 - 100 / (1 + ag / nullif(al, 0))", "macd": "m12 - m26"}))


@query("expression_recursive", f"WITH {WEEKLY}, {_OPSR} " + final(OPS, places=4))
def expression_recursive(spark, sf_dir):
    df = weekly_bars(spark, sf_dir).select("code", "date", "close")
    n = weekly_rows(spark, sf_dir)
    df = S.ema_operator(df, "close", {"ema_10": 10}, rows=n)
    df = S.macd_operator(S.wilder_rsi(df, "close", {"rsi_14": 14}, rows=n), "close", rows=n)
    return report(df, ["code", "date"], OPS, 4)

"""Technical indicators by name.

Window indicators are Columns; recursive ones come from ``smoothing``. ``indicators``
computes any list of names: all window stages in one shuffle by code, then one grouped
pass for the recursive ones on the same partitioning.
"""

from math import pi

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.columns import safe_div
from .factors import money_multiplier, signed_volume, true_range
from .smoothing import INDICATORS as RECURSIVE, add_recursive

MA_WINDOWS = (5, 10, 20, 30, 60, 120, 250)
PRICE = ("open", "high", "low", "close")


def _high(n):
    return R.high("high", n)


def _low(n):
    return R.low("low", n)


def _band(k, n=20):
    w = R.last_rows(n)
    sd = F.when(F.count("close").over(w) >= n, F.stddev_pop("close").over(w))
    return R.mean("close", n) + k * sd


def _stoch_raw(n=5):
    return 100 * safe_div(F.col("close") - _low(n), _high(n) - _low(n))


def _bars_since(x, pick, n):
    """Rows since the newest extreme among the last n + 1 rows."""
    w = R.last_rows(n + 1)
    signed = F.col(x) if pick is F.max_by else -F.col(x)
    at = F.max_by("_pos", F.struct(signed, F.col("_pos"))).over(w)
    return F.when(F.count(x).over(w) >= n + 1, F.col("_pos") - at)


def _aroon(x, pick):
    return 100 * (1 - _bars_since(x, pick, 14) / F.lit(14.0))


def _ultimate(n):
    return safe_div(R.total("_bp", n), R.total("_tr1", n))


# Helpers of the stages: name -> Column over the panel, then over the first helpers.
_HELP = {
    "_pos": lambda: F.row_number().over(R.history()).cast("double"),
    "_tp": lambda: (F.col("high") + F.col("low") + F.col("close")) / 3,
    "_tr1": lambda: F.when(R.lag("close").isNotNull(), true_range()),
    "_bp": lambda: F.when(R.lag("close").isNotNull(), F.col("close") - F.least("low", R.lag("close"))),
    "_ad": lambda: F.coalesce(money_multiplier() * F.col("volume"), F.lit(0.0)),
    "_sv": lambda: F.coalesce(signed_volume(), F.lit(0.0)),
    "_k0": _stoch_raw,
    "_rh": lambda: R.pct_change("high"), "_rl": lambda: R.pct_change("low"),
    "_sma16": lambda: R.mean("close", 16),
}
_HELP2 = {
    "_k3": lambda: R.mean("_k0", 3),
    "_slope": lambda: R.slope("close", "_pos", 14), "_mid14": lambda: R.mean("close", 14),
    "_mf": lambda: F.col("_tp") * F.col("volume"), "_dtp": lambda: R.delta("_tp"),
    "_ma12": lambda: R.mean("close", 12), "_ma26": lambda: R.mean("close", 26),
    "_xw": lambda: F.col("close") * F.col("_pos"),
}


def _flow(sign):
    return R.total(F.when(F.col("_dtp").isNotNull(), F.when(sign * F.col("_dtp") > 0, F.col("_mf"))
                          .otherwise(F.lit(0.0))), 14)


def _wma(n=30):
    # weights 1..n on the last n rows, from two sums and the row position
    lead = R.total("_xw", n) - (F.col("_pos") - n) * R.total("close", n)
    return lead / (n * (n + 1) / 2.0)


# Window indicators: name -> (inputs, helpers, Column builder).
WINDOW = {
    **{f"ma_{n}": (("close",), (), lambda n=n: R.mean("close", n)) for n in MA_WINDOWS},
    "ma": (("close",), (), lambda: R.mean("close", 30)),
    "trima": (("close",), ("_sma16",), lambda: R.mean("_sma16", 15)),
    "wma": (("close",), ("_pos", "_xw"), _wma),
    "midpoint": (("close",), (), lambda: (R.high("close", 14) + R.low("close", 14)) / 2),
    "midprice": (("high", "low"), (), lambda: (_high(14) + _low(14)) / 2),
    **{f"{p}_{k}": (("close",), (), lambda s=s: _band(s)) for p in ("bbands", "bollinger")
       for k, s in (("upper", 2), ("middle", 0), ("lower", -2))},
    "apo": (("close",), ("_ma12", "_ma26"), lambda: F.col("_ma12") - F.col("_ma26")),
    "ppo": (("close",), ("_ma12", "_ma26"), lambda: 100 * safe_div(F.col("_ma12") - F.col("_ma26"), "_ma26")),
    "aroon_up": (("high",), ("_pos",), lambda: _aroon("high", F.max_by)),
    "aroon_down": (("low",), ("_pos",), lambda: _aroon("low", F.min_by)),
    "aroonosc": (("high", "low"), ("_pos",), lambda: _aroon("high", F.max_by) - _aroon("low", F.min_by)),
    "bop": (PRICE, (), lambda: safe_div(F.col("close") - F.col("open"), F.col("high") - F.col("low"))),
    "cci": (("high", "low", "close"), ("_tp",), lambda: safe_div(
        F.col("_tp") - R.mean("_tp", 14), 0.015 * R.mean_abs_dev("_tp", 14, 14))),
    "mfi": (("high", "low", "close", "volume"), ("_tp", "_mf", "_dtp"),
            lambda: 100 * safe_div(_flow(1), _flow(1) + _flow(-1))),
    "mom": (("close",), (), lambda: R.delta("close", 10)),
    "roc": (("close",), (), lambda: 100 * R.pct_change("close", 10)),
    "rocp": (("close",), (), lambda: R.pct_change("close", 10)),
    "rocr": (("close",), (), lambda: safe_div("close", R.lag("close", 10))),
    "rocr100": (("close",), (), lambda: 100 * safe_div("close", R.lag("close", 10))),
    "stochf_k": (("high", "low", "close"), ("_k0",), lambda: F.col("_k0")),
    "stochf_d": (("high", "low", "close"), ("_k0",), lambda: R.mean("_k0", 3)),
    "stoch_k": (("high", "low", "close"), ("_k0", "_k3"), lambda: F.col("_k3")),
    "stoch_d": (("high", "low", "close"), ("_k0", "_k3"), lambda: R.mean("_k3", 3)),
    "ultosc": (("high", "low", "close"), ("_bp", "_tr1"),
               lambda: 100 * (4 * _ultimate(7) + 2 * _ultimate(14) + _ultimate(28)) / 7),
    "willr": (("high", "low", "close"), (),
              lambda: -100 * safe_div(_high(14) - F.col("close"), _high(14) - _low(14))),
    "ad": (("high", "low", "close", "volume"), ("_ad",), lambda: F.sum("_ad").over(R.running())),
    "obv": (("close", "volume"), ("_sv",), lambda: F.sum("_sv").over(R.running())),
    "trange": (("high", "low", "close"), ("_tr1",), lambda: F.col("_tr1")),
    "avgprice": (PRICE, (), lambda: (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4),
    "medprice": (("high", "low"), (), lambda: (F.col("high") + F.col("low")) / 2),
    "typprice": (("high", "low", "close"), ("_tp",), lambda: F.col("_tp")),
    "wclprice": (("high", "low", "close"), (), lambda: (F.col("high") + F.col("low") + 2 * F.col("close")) / 4),
    "beta": (("high", "low"), ("_rh", "_rl"), lambda: R.slope("_rl", "_rh", 5)),
    "correl": (("high", "low"), (), lambda: R.corr("high", "low", 30)),
    "linearreg_slope": (("close",), ("_pos", "_slope"), lambda: F.col("_slope")),
    "linearreg": (("close",), ("_pos", "_slope", "_mid14"), lambda: F.col("_mid14") + 6.5 * F.col("_slope")),
    "linearreg_intercept": (("close",), ("_pos", "_slope", "_mid14"),
                            lambda: F.col("_mid14") - 6.5 * F.col("_slope")),
    "linearreg_angle": (("close",), ("_pos", "_slope"), lambda: F.atan(F.col("_slope")) * 180 / pi),
    "tsf": (("close",), ("_pos", "_slope", "_mid14"), lambda: F.col("_mid14") + 7.5 * F.col("_slope")),
    "stddev": (("close",), (), lambda: R.std("close", 5)),
    "var": (("close",), (), lambda: R.var("close", 5)),
}


def list_indicators():
    return sorted([*WINDOW, *RECURSIVE])


def indicator_info(name):
    if name in WINDOW:
        return {"name": name, "inputs": list(WINDOW[name][0]), "kind": "window"}
    if name in RECURSIVE:
        return {"name": name, "inputs": list(RECURSIVE[name][0]), "kind": "recursive"}
    raise ValueError(f"unknown indicator {name}")


def indicators(df, names, rows=None):
    """Add the named indicators; raises ValueError for unknown names or missing inputs.

    ``rows``: the most rows of a code, if known; short histories need fewer sorts.
    """
    infos = [indicator_info(n) for n in names]
    missing = sorted({i for info in infos for i in info["inputs"]} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    native = [n for n in names if n in WINDOW]
    need = {h for n in native for h in WINDOW[n][1]}
    base = [c for c in df.columns if c not in names]
    out = df
    for stage in (_HELP, _HELP2):
        cols = {h: make() for h, make in stage.items() if h in need}
        out = out.withColumns(cols) if cols else out
    out = out.withColumns({n: WINDOW[n][2]() for n in native}) if native else out
    out = out.select(*base, *native)
    recursive = {n: RECURSIVE[n] for n in names if n in RECURSIVE}
    if recursive:
        out = add_recursive(out, recursive, rows=rows)
    return out.select(*base, *names)

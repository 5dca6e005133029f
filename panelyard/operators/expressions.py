"""Expression operators as Column builders, presets, and user registration.

Cross-sectional operators need the whole date, so they work on a DataFrame
(``section_op``); their per-code counterparts, which look at a code's entire history,
carry the prefix ``ts_full_``.
"""

from pyspark.sql import functions as F, Window

from ..functions import rolling as R
from ..functions.columns import col, safe_div
from ..functions.sections import DEFAULT_SPLITS, with_avg_rank, with_stats

# Expression variable -> panel column.
VARIABLES = {"$close": "close", "$open": "open", "$high": "high", "$low": "low", "$volume": "volume",
             "$amount": "amount", "$turnover": "turnover_rate", "$change_pct": "change_pct"}


def var(name):
    return F.col(VARIABLES[name])


SECTION_OPERATORS = ("RANK", "SCALE", "ZSCORE", "MEAN", "STD", "MAX", "MIN")
RECURSIVE_OPERATORS = ("EMA", "RSI", "MACD")

_custom = {}


def register(name, builder, category="custom"):
    """Add a user operator: builder takes Columns and parameters and returns a Column."""
    _custom[name.upper()] = (builder, category)


def operator(name):
    name = name.upper()
    known = {**R.TIME_OPERATORS, **R.SCALAR_OPERATORS, **{k: b for k, (b, _) in _custom.items()}}
    if name not in known:
        raise ValueError(f"unknown operator {name}; known: {sorted(known)}")
    return known[name]


def list_operators():
    out = {k: "cross_section" for k in SECTION_OPERATORS}
    out.update({k: "rolling" for k in R.TIME_OPERATORS})
    out.update({k: "element" for k in (*R.SCALAR_OPERATORS, "DELTA", "DELAY")})
    out.update({k: "technical" for k in ("SMA", *RECURSIVE_OPERATORS)})
    out.update({k: c for k, (_, c) in _custom.items()})
    return out


def _shape(op, x, mean, sd, lo, hi):
    if op == "SCALE":
        return F.when(hi == lo, F.lit(0.5)).otherwise(safe_div(x - lo, hi - lo))
    if op == "ZSCORE":
        return F.when(sd.isNull() | (sd == 0), F.lit(0.0)).otherwise(safe_div(x - mean, sd))
    return {"MEAN": mean, "STD": sd, "MAX": hi, "MIN": lo}[op]


def section_ops(df, wanted, by=("date",), splits=DEFAULT_SPLITS):
    """Cross-sectional operators over each date. wanted: output -> (operator, column)."""
    ranks = {out: x for out, (op, x) in wanted.items() if op == "RANK"}
    other = {out: v for out, v in wanted.items() if v[0] != "RANK"}
    if other:
        xs = sorted({x for _, x in other.values()})
        aggs = {}
        for x in xs:
            aggs.update({f"_mean_{x}": F.avg(x), f"_sd_{x}": F.stddev_samp(x),
                         f"_lo_{x}": F.min(x), f"_hi_{x}": F.max(x)})
        df = with_stats(df, aggs, by, splits)
        df = df.withColumns({out: _shape(op, F.col(x), *[F.col(f"_{k}_{x}") for k in ("mean", "sd", "lo", "hi")])
                             for out, (op, x) in other.items()})
        df = df.drop(*[f"_{k}_{x}" for k in ("mean", "sd", "lo", "hi") for x in xs])
    if ranks:
        df = with_avg_rank(df, sorted(set(ranks.values())), by, splits, suffix="__rank")
        df = df.withColumns({out: F.col(x + "__rank") for out, x in ranks.items()})
        df = df.drop(*[x + "__rank" for x in set(ranks.values())])
    return df


def ts_full(op, x, key="code"):
    """The same operators over a code's whole history, later rows included."""
    w = Window.partitionBy(key)
    x = col(x)
    if op == "RANK":
        rank = F.rank().over(Window.partitionBy(key).orderBy(x.asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy(F.col(key), x))
        return F.when(x.isNotNull(), (rank + (ties - 1) / F.lit(2.0)) / F.count(x).over(w))
    return _shape(op, x, F.avg(x).over(w), F.stddev_samp(x).over(w), F.min(x).over(w), F.max(x).over(w))


# Preset -> (time-window Column, section operator or None). Reversals are negated momenta.
PRESETS = {
    "momentum_5d": (lambda: R.delta(var("$close"), 5), "RANK"),
    "momentum_20d": (lambda: R.delta(var("$close"), 20), "RANK"),
    "momentum_60d": (lambda: R.delta(var("$close"), 60), "RANK"),
    "reversal_5d": (lambda: -R.delta(var("$close"), 5), "RANK"),
    "reversal_20d": (lambda: -R.delta(var("$close"), 20), "RANK"),
    "volatility_20d": (lambda: R.TIME_OPERATORS["TS_STD"](F.col("_d1"), 20), "ZSCORE"),
    "volume_ratio": (lambda: var("$volume"), "RANK"),
    "volume_trend": (lambda: R.TIME_OPERATORS["TS_MEAN"](var("$volume"), 20), "ZSCORE"),
    "turnover_rank": (lambda: var("$turnover"), "RANK"),
    "rsi_14": (lambda: F.col("_rsi_14"), None),
    "intraday_range": (lambda: R.delta(var("$close"), 1), "RANK"),
}


def compute_presets(df, names=None, splits=DEFAULT_SPLITS, rows=None):
    """Named preset factors: all code windows first, then all date windows. ``rows``: the most rows of a code, if known."""
    names = list(names or PRESETS)
    unknown = [n for n in names if n not in PRESETS]
    if unknown:
        raise ValueError(f"unknown presets: {unknown}")
    if "rsi_14" in names:
        from .smoothing import wilder_rsi
        df = wilder_rsi(df, "close", {"_rsi_14": 14}, rows=rows)
    df = df.withColumn("_d1", R.delta("close"))
    df = df.withColumns({f"_in_{n}": PRESETS[n][0]() for n in names}).drop("_d1", "_rsi_14")
    wanted = {n: (PRESETS[n][1], f"_in_{n}") for n in names if PRESETS[n][1]}
    df = section_ops(df, wanted, splits=splits)
    plain = {n: F.col(f"_in_{n}") for n in names if PRESETS[n][1] is None}
    df = df.withColumns(plain) if plain else df
    return df.drop(*[f"_in_{n}" for n in names])


class FactorSet:
    """User factors with dependencies, computed in dependency order, each once."""

    def __init__(self):
        self._made = {}

    def add(self, name, builder, needs=(), category="custom", description=""):
        self._made[name] = (builder, tuple(needs), category, description)
        return self

    def levels(self, names=None):
        """Factor names grouped so that each level only needs earlier ones."""
        todo, want = {}, list(names or self._made)
        while want:
            n = want.pop()
            if n in self._made and n not in todo:
                todo[n] = [d for d in self._made[n][1] if d in self._made]
                want += todo[n]
            elif n not in self._made:
                raise ValueError(f"unknown factor {n}")
        out, done = [], set()
        while len(done) < len(todo):
            ready = [n for n in self._made if n in todo and n not in done and set(todo[n]) <= done]
            if not ready:
                raise ValueError(f"circular factors: {sorted(set(todo) - done)}")
            out.append(ready)
            done |= set(ready)
        return out

    def compute(self, df, names=None):
        for level in self.levels(names):
            df = df.withColumns({n: self._made[n][0]() for n in level})
        return df

    def info(self):
        return {n: {"needs": d, "category": c, "description": t} for n, (_, d, c, t) in self._made.items()}

"""Processing and evaluation of factors on the weekly panel."""

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.columns import log_pos
from ..operators import evaluate as E, process as P
from ..session import materialize
from .factor_queries import out as outs, over, pct, rank_sql, roll, stage
from .registry import query
from .tables import INDUSTRY, WEEKLY, industries, report, weekly_bars, weekly_splits

FACTORS = ["reversal_5d", "reversal_20d", "volatility_20d", "volume_ratio"]
RETS = ["ret_forward_1d", "ret_forward_5d", "ret_forward_20d"]


def factor_panel(spark, sf_dir):
    """Four factors (with their natural gaps), forward returns, log size."""
    bars = weekly_bars(spark, sf_dir).select("code", "date", "close", "volume", "amount")
    df = bars.withColumns({
        "reversal_5d": -R.pct_change("close", 5), "reversal_20d": -R.pct_change("close", 20), "_r": R.pct_change("close"),
        "volume_ratio": F.col("volume") / R.mean("volume", 20, 5), "lncap": log_pos("amount"),
        **{f"ret_forward_{p}d": R.forward_return("close", p) for p in (1, 5, 20)}})
    df = df.withColumn("volatility_20d", R.std("_r", 20, 10))
    return df.select("code", "date", "close", "lncap", *FACTORS, *RETS)


FP = ", ".join([WEEKLY, stage("fp0", "bars", {
    "reversal_5d": f"-{pct('close', 5)}", "reversal_20d": f"-{pct('close', 20)}", "r1": pct("close"),
    "volume_ratio": f"volume / ({roll('avg', 'volume', 20, 5)})", "lncap": "ln(amount)",
    **{f"ret_forward_{p}d": f"lead(close, {p}) {over()} / close - 1" for p in (1, 5, 20)}}),
    stage("fp", "fp0", {"volatility_20d": roll("stddev_samp", "r1", 20, 10)})])


def _final(names, src, places=6):
    return f"SELECT code, CAST(date AS VARCHAR) AS date, {outs(names, places)} FROM {src}"


D = "OVER (PARTITION BY date)"
_COLS = ["reversal_20d", "volume_ratio"]
_MED = stage("m1", "fp", {f"med_{x}": f"median({x}) {D}" for x in _COLS})
_MAD = stage("m2", "m1", {f"mad_{x}": f"median(abs({x} - med_{x})) {D}" for x in _COLS})


@query("winsorize_mad", f"WITH {FP}, {_MED}, {_MAD} SELECT code, CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"round(CASE WHEN {x} IS NULL THEN NULL WHEN mad_{x} > 0 THEN least(greatest({x}, med_{x} - 3 * mad_{x}), med_{x} + 3 * mad_{x}) ELSE {x} END, 6) + 0.0 AS {x}"
    for x in _COLS) + " FROM m2")
def winsorize_mad(spark, sf_dir):
    df = factor_panel(spark, sf_dir).select("code", "date", *_COLS)
    return report(P.winsorize_mad(df, _COLS, splits=weekly_splits(spark, sf_dir)), ["code", "date"], _COLS)


@query("winsorize_quantile", f"WITH {FP}, q AS (SELECT *, " + ", ".join(
    f"quantile_cont({x}, {p}) {D} AS {k}_{x}" for x in _COLS for k, p in (("lo", 0.01), ("hi", 0.99))) + " FROM fp) SELECT code, CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"round(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, lo_{x}), hi_{x}) END, 6) + 0.0 AS {x}" for x in _COLS) + " FROM q")
def winsorize_quantile(spark, sf_dir):
    df = factor_panel(spark, sf_dir).select("code", "date", *_COLS)
    return report(P.winsorize_quantile(df, _COLS, splits=weekly_splits(spark, sf_dir)), ["code", "date"], _COLS)


_STD = {**{f"z_{x}": f"coalesce(CASE WHEN coalesce(stddev_samp({x}) {D}, 0) = 0 THEN {x} - avg({x}) {D} ELSE ({x} - avg({x}) {D}) / stddev_samp({x}) {D} END, 0)" for x in _COLS},
        **{f"m_{x}": f"coalesce(({x} - min({x}) {D}) / nullif(max({x}) {D} - min({x}) {D}, 0), 0)" for x in _COLS}}


@query("standardize", f"WITH {FP}, {stage('z', 'fp', _STD)} " + _final(list(_STD), "z"))
def standardize(spark, sf_dir):
    df, n = factor_panel(spark, sf_dir), weekly_splits(spark, sf_dir)
    df = df.select("code", "date", *[F.col(x).alias(f"{k}_{x}") for k in "zm" for x in _COLS])
    df = P.standardize(df, [f"z_{x}" for x in _COLS], "zscore", n)
    return report(P.standardize(df, [f"m_{x}" for x in _COLS], "minmax", n), ["code", "date"], list(_STD))


_FILL = {"rank_v": f"coalesce({rank_sql('reversal_20d')}, 0.5)", "mean_v": f"coalesce(reversal_20d, avg(reversal_20d) {D}, 0)",
         "zero_v": "coalesce(reversal_20d, 0)",
         "ffill_v": "coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"}


@query("fill_missing", f"WITH {FP}, g0 AS (SELECT *, CASE WHEN volume_ratio < 1.5 THEN volume_ratio END AS g FROM fp), {stage('z', 'g0', _FILL)} " + _final(list(_FILL), "z"))
def fill_missing(spark, sf_dir):
    df, n = factor_panel(spark, sf_dir), weekly_splits(spark, sf_dir)
    df = df.select("code", "date", *[F.col("reversal_20d").alias(k) for k in ("rank_v", "mean_v", "zero_v")],
                   F.when(F.col("volume_ratio") < 1.5, F.col("volume_ratio")).alias("ffill_v"))
    df = P.fill_missing(df, ["ffill_v"], "ffill")   # code windows first, then dates
    for m, c in (("zero", "zero_v"), ("mean", "mean_v"), ("rank_pct", "rank_v")):
        df = P.fill_missing(df, [c], m, n)
    return report(df, ["code", "date"], list(_FILL))


_NEU = ["reversal_20d", "volatility_20d"]
_G = "OVER (PARTITION BY date, g)"
_NEU_SQL = ", ".join([
    "n0 AS (SELECT fp.code, date, coalesce(lncap, 0) AS x, coalesce(industry, '') AS g, coalesce(reversal_20d, 0) AS y1, coalesce(volatility_20d, 0) AS y2, count(*) OVER (PARTITION BY date) AS k FROM fp LEFT JOIN ind USING (code))",
    f"n1 AS (SELECT *, x - avg(x) {_G} AS xd, y1 - avg(y1) {_G} AS d1, y2 - avg(y2) {_G} AS d2 FROM n0)",
    f"n2 AS (SELECT *, coalesce(sum(xd * d1) {D} / nullif(sum(xd * xd) {D}, 0), 0) AS b1, coalesce(sum(xd * d2) {D} / nullif(sum(xd * xd) {D}, 0), 0) AS b2 FROM n1)"])


@query("neutralize", f"""WITH {FP}, {INDUSTRY}, {_NEU_SQL} SELECT code, CAST(date AS VARCHAR) AS date,
 round(CASE WHEN k < 30 THEN y1 ELSE d1 - b1 * xd END, 6) + 0.0 AS reversal_20d_neutral, round(CASE WHEN k < 30 THEN y2 ELSE d2 - b2 * xd END, 6) + 0.0 AS volatility_20d_neutral FROM n2""")
def neutralize(spark, sf_dir):
    df = factor_panel(spark, sf_dir).select("code", "date", "lncap", *_NEU).join(industries(spark, sf_dir), "code", "left")
    return report(P.neutralize(df, _NEU), ["code", "date"], [f"{x}_neutral" for x in _NEU])


@query("neutralize_valid", f"""WITH {FP}, {INDUSTRY}, v0 AS (SELECT fp.code, date, CASE WHEN volume_ratio < 2 THEN lncap END AS x0, CASE WHEN industry <> 'ASIA' THEN industry END AS g0, reversal_20d AS y FROM fp LEFT JOIN ind USING (code)),
 v1 AS (SELECT code, date, y, coalesce(x0, (SELECT avg(x0) FROM v0)) AS x, coalesce(g0, (SELECT min(g0) FROM v0)) AS g FROM v0),
 v2 AS (SELECT *, x - avg(x) {_G} AS xd, y - avg(y) {_G} AS yd FROM v1 WHERE y IS NOT NULL),
 v3 AS (SELECT *, yd - coalesce(sum(xd * yd) {D} / nullif(sum(xd * xd) {D}, 0), 0) * xd AS res, count(*) {D} AS k FROM v2)
SELECT v1.code, CAST(v1.date AS VARCHAR) AS date, round(CASE WHEN k >= 3 THEN res END, 6) + 0.0 AS reversal_20d_neut FROM v1 LEFT JOIN v3 USING (code, date)""")
def neutralize_valid(spark, sf_dir):
    df = factor_panel(spark, sf_dir).join(industries(spark, sf_dir), "code", "left")
    df = df.select("code", "date", F.when(F.col("volume_ratio") < 2, F.col("lncap")).alias("lncap"),
                   F.when(F.col("industry") != "ASIA", F.col("industry")).alias("industry"), "reversal_20d")
    return report(P.neutralize_valid(df, ["reversal_20d"]), ["code", "date"], ["reversal_20d_neut"])


def ic_sql(f, r, method="pearson", min_obs=10, src="fp"):
    """CTE-less series of one factor and horizon."""
    base = f"SELECT date, {f} AS x, {r} AS y FROM {src} WHERE {f} IS NOT NULL AND {r} IS NOT NULL"
    if method == "spearman":
        rk = lambda v: f"rank() OVER (PARTITION BY date ORDER BY {v}) + (count(*) OVER (PARTITION BY date, {v}) - 1) / 2.0"
        base = f"SELECT date, {rk('x')} AS x, {rk('y')} AS y FROM ({base})"
    return (f"SELECT '{f}' AS factor, '{r}' AS horizon, date, corr(x, y) AS ic, count(*) AS n_obs FROM ({base}) GROUP BY date "
            f"HAVING count(*) >= {min_obs} AND min(x) < max(x) AND min(y) < max(y)")


def ic_union(method, factors=FACTORS, rets=RETS, **kw):
    return "ics AS (" + " UNION ALL ".join(ic_sql(f, r, method, **kw) for f in factors for r in rets) + ")"


def stats_sql(by, ddof=1):
    sd = "stddev_samp(ic)" if ddof == 1 else "stddev_pop(ic)"
    keys = ", ".join(by)
    return (f"SELECT {keys}, count(*) AS n_dates, round(avg(ic), 6) + 0.0 AS ic_mean, round({sd}, 6) + 0.0 AS ic_std, "
            f"round(coalesce(avg(ic) / nullif({sd}, 0), 0), 6) + 0.0 AS ic_ir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS positive_ratio, "
            f"round(coalesce(avg(ic) * sqrt(count(*)) / nullif({sd}, 0), 0), 6) + 0.0 AS t_stat FROM ics GROUP BY {keys}")


STATS = ["ic_mean", "ic_std", "ic_ir", "positive_ratio", "t_stat"]


@query("ic_pearson_series", f"WITH {FP}, ics AS ({ic_sql('volatility_20d', 'ret_forward_5d')}) SELECT CAST(date AS VARCHAR) AS date, n_obs, round(ic, 6) + 0.0 AS ic FROM ics")
def ic_pearson_series(spark, sf_dir):
    s = E.ic_series(factor_panel(spark, sf_dir), "volatility_20d", "ret_forward_5d", "pearson", splits=weekly_splits(spark, sf_dir))
    return report(s, ["date", "n_obs"], ["ic"])


@query("ic_matrix_pearson", f"WITH {FP}, {ic_union('pearson')} " + stats_sql(["factor", "horizon"]))
def ic_matrix_pearson(spark, sf_dir):
    return report(E.ic_matrix(factor_panel(spark, sf_dir), FACTORS, RETS), ["factor", "horizon", "n_dates"], STATS)


@query("ic_matrix_spearman", f"WITH {FP}, {ic_union('spearman')} " + stats_sql(["factor", "horizon"]))
def ic_matrix_spearman(spark, sf_dir):
    m = E.ic_matrix(factor_panel(spark, sf_dir), FACTORS, RETS, "spearman", splits=weekly_splits(spark, sf_dir))
    return report(m, ["factor", "horizon", "n_dates"], STATS)


@query("ic_summary_population", f"WITH {FP}, {ic_union('pearson', rets=['ret_forward_5d'])} " + stats_sql(["factor"], 0))
def ic_summary_population(spark, sf_dir):
    s = E.ic_matrix_series(factor_panel(spark, sf_dir), FACTORS, ["ret_forward_5d"])
    return report(E.ic_stats(s, ("factor",), ddof=0), ["factor", "n_dates"], STATS)


_PERIODS = (1, 2, 5, 10, 20)
_LEADS = lambda ps: stage("dc", "fp", {f"ret_forward_{p}d_": f"lead(close, {p}) {over()} / close - 1" for p in ps})


@query("ic_decay_periods", f"WITH {FP}, {_LEADS(_PERIODS)}, ics AS (" + " UNION ALL ".join(
    ic_sql("reversal_5d", f"ret_forward_{p}d_", "spearman", src="dc").replace(f"'ret_forward_{p}d_'", f"'ret_forward_{p}d'") for p in _PERIODS) + ") " + stats_sql(["horizon"]))
def ic_decay_periods(spark, sf_dir):
    panel = factor_panel(spark, sf_dir).select("code", "date", "close", "reversal_5d")
    d = E.ic_decay(panel, "reversal_5d", _PERIODS, splits=weekly_splits(spark, sf_dir))
    return report(d, ["horizon", "n_dates"], STATS)


_LAGS = range(1, 21)
SCAN_SQL = f"""{FP}, kn AS (SELECT code, date, close, reversal_5d FROM fp WHERE reversal_5d IS NOT NULL), {stage('dl', 'kn', {f'l{p}': f'lead(close, {p}) {over()} / close - 1' for p in _LAGS})},
 ics AS ({' UNION ALL '.join(f"SELECT {p} AS lag, * FROM ({ic_sql('reversal_5d', f'l{p}', 'spearman', 30, 'dl')})" for p in _LAGS)})"""


def scan(spark, sf_dir):
    panel = factor_panel(spark, sf_dir).select("code", "date", "close", "reversal_5d")
    return E.lag_scan(panel, "reversal_5d", _LAGS, splits=weekly_splits(spark, sf_dir))


@query("ic_lag_scan", f"WITH {SCAN_SQL} " + stats_sql(["lag"]) + " HAVING count(*) >= 5")
def ic_lag_scan(spark, sf_dir):
    return report(scan(spark, sf_dir), ["lag", "n_dates"], STATS)


# two-sided t probability for a whole number of degrees of freedom: finite sums of powers of a cosine
_T_SUM = """CASE WHEN nu % 2 = 0 THEN sin(th) * coalesce(list_sum(list_transform(range(0, nu // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * pow(cos(th), 2 * j))), 0)
 ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (nu - 1) // 2), lambda j: 0.5 * sqrt(pi()) * exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * pow(cos(th), 2 * j + 1))), 0)) END"""


@query("ic_lag_p_values", f"""WITH {SCAN_SQL}, st AS (SELECT lag, count(*) - 1 AS nu, coalesce(avg(ic) * sqrt(count(*)) / nullif(stddev_samp(ic), 0), 0) AS t_stat FROM ics GROUP BY lag HAVING count(*) >= 5),
 an AS (SELECT *, atan(abs(t_stat) / sqrt(nu)) AS th FROM st)
SELECT CAST(lag AS INTEGER) AS lag, round(t_stat, 6) + 0.0 AS t_stat, round(1 - ({_T_SUM}), 6) + 0.0 AS p_value FROM an""")
def ic_lag_p_values(spark, sf_dir):
    return report(scan(spark, sf_dir), ["lag"], ["t_stat", "p_value"])


@query("ic_half_life", f"""WITH {SCAN_SQL}, st AS (SELECT lag, avg(ic) AS m FROM ics GROUP BY lag HAVING count(*) >= 5),
 pk AS (SELECT arg_max(lag, (abs(m), -lag)) AS optimal_lag, max(abs(m)) AS peak_ic FROM st)
SELECT optimal_lag, round(peak_ic, 6) + 0.0 AS peak_ic, (SELECT min(lag) FROM st WHERE lag > optimal_lag AND abs(m) <= peak_ic / 2) AS half_life_lag FROM pk""")
def ic_half_life(spark, sf_dir):
    return report(E.half_life(scan(spark, sf_dir)), ["optimal_lag", "half_life_lag"], ["peak_ic"])


_PAIRS = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1:]]


@query("factor_correlation", f"WITH {FP}, dm AS (SELECT date, " + ", ".join(f"avg({f}) AS {f}" for f in FACTORS) + " FROM fp GROUP BY date) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM dm" for a, b in _PAIRS))
def factor_correlation(spark, sf_dir):
    return report(P.correlation_pairs(factor_panel(spark, sf_dir), FACTORS), ["a", "b"], ["corr"])


_CORR = "dm AS (SELECT date, " + ", ".join(f"avg({f}) AS {f}" for f in FACTORS) + " FROM fp GROUP BY date), hi AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b FROM dm HAVING abs(corr({a}, {b})) > 0.1" for a in FACTORS for b in FACTORS if a != b) + ")"


@query("correlation_filter", f"""WITH RECURSIVE {FP}, {_CORR}, {ic_union('pearson', rets=['ret_forward_5d'])},
 ir AS (SELECT factor, row_number() OVER (ORDER BY abs(avg(ic) / stddev_samp(ic)) DESC, list_position([{', '.join(f"'{f}'" for f in FACTORS)}], factor)) AS k FROM ics GROUP BY factor),
 pick AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS kept UNION ALL SELECT ir.k, CASE WHEN EXISTS (SELECT 1 FROM hi WHERE hi.a = ir.factor AND list_contains(pick.kept, hi.b)) THEN pick.kept ELSE list_append(pick.kept, ir.factor) END
  FROM pick JOIN ir ON ir.k = pick.k + 1)
SELECT unnest(kept) AS kept FROM (SELECT kept FROM pick ORDER BY k DESC LIMIT 1)""")
def correlation_filter(spark, sf_dir):
    df = materialize(factor_panel(spark, sf_dir).select("code", "date", *FACTORS, "ret_forward_5d"))
    strengths = P.factor_strengths(FACTORS, E.ic_matrix(df, FACTORS, ["ret_forward_5d"]))
    return P.select_uncorrelated(P.correlation_pairs(df, FACTORS), strengths, 0.1).select(F.col("factor").alias("kept"))


_FUSE = [f"coalesce({rank_sql(f)}, 0.5)" for f in FACTORS]


@query("fusion_ic_weighted", f"WITH {FP}, {ic_union('pearson', rets=['ret_forward_5d'])}, w AS (SELECT factor, abs(avg(ic) / stddev_samp(ic)) AS s FROM ics GROUP BY factor), "
       + stage("fr", "fp", {f"rk{i}": e for i, e in enumerate(_FUSE)}) + " SELECT code, CAST(date AS VARCHAR) AS date, round(("
       + " + ".join(f"rk{i} * (SELECT s FROM w WHERE factor = '{f}')" for i, f in enumerate(FACTORS)) + ") / (SELECT sum(s) FROM w), 6) + 0.0 AS alpha_score FROM fr")
def fusion_ic_weighted(spark, sf_dir):
    df = factor_panel(spark, sf_dir)
    fused = P.fuse(df, FACTORS, E.ic_matrix(df, FACTORS, ["ret_forward_5d"]), weekly_splits(spark, sf_dir))
    return report(fused, ["code", "date"], ["alpha_score"])


EQUAL = stage("fr", "fp", {f"rk{i}": e for i, e in enumerate(_FUSE)}) + ", al AS (SELECT *, (" + " + ".join(f"rk{i}" for i in range(len(FACTORS))) + ") / 4 AS alpha_score FROM fr)"


def equal_alpha(spark, sf_dir):
    return P.fuse(factor_panel(spark, sf_dir), FACTORS, None, weekly_splits(spark, sf_dir))


@query("fusion_equal", f"WITH {FP}, {EQUAL} " + _final(["alpha_score"], "al"))
def fusion_equal(spark, sf_dir):
    return report(equal_alpha(spark, sf_dir), ["code", "date"], ["alpha_score"])


# ranks of volume_ratio are the signal: the score has exact ties that two engines may break apart
@query("top_quantile_signal", f"WITH {FP}, s AS (SELECT *, {rank_sql('volume_ratio')} AS rk FROM fp) SELECT code, CAST(date AS VARCHAR) AS date, CASE WHEN rk > 0.8 THEN 1 ELSE 0 END AS signal FROM s")
def top_quantile_signal(spark, sf_dir):
    df = factor_panel(spark, sf_dir).select("code", "date", "volume_ratio")
    return report(P.top_signal(df, "volume_ratio", splits=weekly_splits(spark, sf_dir)), ["code", "date", "signal"], [])


BUCKET = """bk0 AS (SELECT code, date, volatility_20d AS f, ret_forward_5d AS r FROM fp WHERE volatility_20d IS NOT NULL),
 ed AS (SELECT date, list_distinct(quantile_cont(f, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e FROM bk0 GROUP BY date),
 bk AS (SELECT bk0.*, len(list_filter(list_sort(e)[2:-2], lambda v: v < f)) + 1 AS bucket FROM bk0 JOIN ed USING (date) WHERE len(e) > 1)"""


def buckets(spark, sf_dir):
    df = factor_panel(spark, sf_dir).select("code", "date", "volatility_20d", "ret_forward_5d")
    return E.quantile_buckets(df, "volatility_20d", 5, splits=weekly_splits(spark, sf_dir))


@query("quantile_buckets", f"WITH {FP}, {BUCKET} SELECT code, CAST(date AS VARCHAR) AS date, CAST(bucket AS INTEGER) AS bucket FROM bk")
def quantile_buckets(spark, sf_dir):
    return report(buckets(spark, sf_dir), ["code", "date", "bucket"], [])


@query("layered_returns", f"""WITH {FP}, {BUCKET}, m AS (SELECT bucket, avg(r) AS m, count(*) AS n_obs FROM bk WHERE r IS NOT NULL GROUP BY bucket)
SELECT CAST(bucket AS INTEGER) AS bucket, n_obs, round(m, 6) + 0.0 AS mean_ret, round((SELECT arg_max(m, bucket) - arg_min(m, bucket) FROM m), 6) + 0.0 AS spread FROM m""")
def layered_returns(spark, sf_dir):
    return report(E.layered_returns(buckets(spark, sf_dir), "ret_forward_5d"), ["bucket", "n_obs"], ["mean_ret", "spread"])


_LS = "ls AS (SELECT date, avg(r) FILTER (bucket = 5) - avg(r) FILTER (bucket = 1) AS v FROM bk GROUP BY date)"


@query("long_short_series", f"WITH {FP}, {BUCKET}, {_LS} SELECT CAST(date AS VARCHAR) AS date, round(v, 6) + 0.0 AS long_short FROM ls WHERE v IS NOT NULL")
def long_short_series(spark, sf_dir):
    return report(E.long_short_series(buckets(spark, sf_dir), "ret_forward_5d"), ["date"], ["long_short"])


@query("long_short_sharpe", f"""WITH {FP}, {BUCKET}, {_LS} SELECT count(v) AS n_dates, round(avg(v), 6) + 0.0 AS mean_ls, round(stddev_samp(v), 6) + 0.0 AS std_ls,
 round(avg(v) / stddev_samp(v) * sqrt(252), 6) + 0.0 AS sharpe FROM ls""")
def long_short_sharpe(spark, sf_dir):
    s = E.long_short_series(buckets(spark, sf_dir), "ret_forward_5d")
    return report(E.long_short_sharpe(s), ["n_dates"], ["mean_ls", "std_ls", "sharpe"])


_TURN = """tp AS (SELECT code, date FROM bk WHERE bucket = 5), dt AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM bk)),
 tn AS (SELECT dt.date, (SELECT count(*) FROM tp a JOIN tp b ON a.code = b.code AND a.date = dt.date AND b.date = dt.prev) AS both_,
  (SELECT count(*) FROM tp WHERE tp.date = dt.date) AS n1, (SELECT count(*) FROM tp WHERE tp.date = dt.prev) AS n0 FROM dt WHERE prev IS NOT NULL),
 turn AS (SELECT date, 1 - both_ / (n1 + n0 - both_) AS turnover FROM tn)"""


@query("top_bucket_turnover", f"WITH {FP}, {BUCKET}, {_TURN} SELECT CAST(date AS VARCHAR) AS date, round(turnover, 6) + 0.0 AS turnover FROM turn")
def top_bucket_turnover(spark, sf_dir):
    return report(E.top_bucket_turnover(buckets(spark, sf_dir)), ["date"], ["turnover"])


@query("factor_tear_sheet", f"""WITH {FP}, {BUCKET}, {_LS}, {_TURN}, ics AS ({ic_sql('volatility_20d', 'ret_forward_5d', 'spearman')}),
 m AS (SELECT bucket, avg(r) AS m FROM bk WHERE r IS NOT NULL GROUP BY bucket),
 one AS (SELECT (SELECT count(*) FROM ics) AS n_dates, (SELECT avg(ic) FROM ics) AS ic_mean, (SELECT avg(ic) / stddev_samp(ic) FROM ics) AS ic_ir,
  (SELECT arg_max(m, bucket) - arg_min(m, bucket) FROM m) AS spread, (SELECT avg(v) FROM ls) AS mean_ls, (SELECT avg(v) / stddev_samp(v) * sqrt(252) FROM ls) AS sharpe,
  (SELECT avg(turnover) FROM turn) AS top_turnover)
SELECT n_dates, {outs(['ic_mean', 'ic_ir', 'spread', 'mean_ls', 'sharpe', 'top_turnover'])}, CASE WHEN ic_ir >= 0.5 AND sharpe >= 0.8 THEN 'ACCEPT' ELSE 'REVIEW' END AS verdict FROM one""")
def factor_tear_sheet(spark, sf_dir):
    t = E.tear_sheet(factor_panel(spark, sf_dir), "volatility_20d", "ret_forward_5d", splits=weekly_splits(spark, sf_dir))
    return report(t, ["n_dates", "verdict"], ["ic_mean", "ic_ir", "spread", "mean_ls", "sharpe", "top_turnover"])


@query("bootstrap_verdict", f"""WITH {FP}, {ic_union('pearson', rets=['ret_forward_5d'])},
 one AS (SELECT factor, count(*) AS n, avg(ic) AS m, coalesce(avg(ic) / nullif(stddev_pop(ic), 0), 0) AS ir, stddev_pop(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS pos, ceil(count(*) / 5.0)::BIGINT AS draws FROM ics GROUP BY factor),
 v AS (SELECT factor, n, n - (draws - 1) * 5 AS rest, ic - m AS x, row_number() OVER (PARTITION BY factor ORDER BY date) - 1 AS i FROM ics JOIN one USING (factor)),
 dr AS (SELECT factor, n, draws, rest, rep, k, CAST('0x' || substr(md5(concat_ws('-', '42', factor, rep, k)), 1, 8) AS BIGINT) % (n - 4) AS start
  FROM (SELECT factor, n, draws, n - (draws - 1) * 5 AS rest, rep, unnest(range(1, draws + 1)) AS k FROM (SELECT *, unnest(range(1, 1001)) AS rep FROM one WHERE n >= 20 AND sd > 0))),
 bl AS (SELECT a.factor, a.i AS start, sum(b.x) AS s, sum(b.x * b.x) AS q, sum(b.x) FILTER (b.i < a.i + a.rest) AS sl, sum(b.x * b.x) FILTER (b.i < a.i + a.rest) AS ql
  FROM v a JOIN v b ON b.factor = a.factor AND b.i BETWEEN a.i AND a.i + 4 GROUP BY 1, 2),
 rp AS (SELECT factor, rep, sum(CASE WHEN k = draws THEN sl ELSE s END) / any_value(n) AS rm, sum(CASE WHEN k = draws THEN ql ELSE q END) / any_value(n) AS rq FROM dr JOIN bl USING (factor, start) GROUP BY factor, rep),
 pv AS (SELECT factor, count(*) FILTER (abs(rm / nullif(sqrt(greatest(rq - rm * rm, 0)), 0)) >= abs(m) / sd) / 1000.0 AS p FROM rp JOIN one USING (factor) GROUP BY factor),
 al AS (SELECT one.*, coalesce(p, 1.0) AS p FROM one LEFT JOIN pv USING (factor))
SELECT factor, n AS n_dates, CASE WHEN p < 0.05 AND abs(ir) > 0.5 THEN 'ACCEPT' WHEN p < 0.10 OR abs(ir) > 0.3 THEN 'REVIEW' ELSE 'REJECT' END AS verdict,
 round(m, 6) + 0.0 AS ic_mean, round(ir, 6) + 0.0 AS ic_ir, round(pos, 6) + 0.0 AS positive_ratio, round(p, 6) + 0.0 AS bootstrap_p FROM al""")
def bootstrap_verdict(spark, sf_dir):
    s = E.ic_matrix_series(factor_panel(spark, sf_dir), FACTORS, ["ret_forward_5d"])
    return report(E.bootstrap_verdict(s.select("factor", "date", "ic")), ["factor", "n_dates", "verdict"], ["ic_mean", "ic_ir", "positive_ratio", "bootstrap_p"])


@query("alpha_by_industry", f"WITH {FP}, {INDUSTRY}, {EQUAL} SELECT industry, round(avg(alpha_score), 6) + 0.0 AS mean_value FROM al JOIN ind USING (code) WHERE date = (SELECT max(date) FROM al) GROUP BY industry ORDER BY industry")
def alpha_by_industry(spark, sf_dir):
    df = equal_alpha(spark, sf_dir).join(industries(spark, sf_dir), "code")
    return report(P.latest_group_mean(df, "alpha_score", "industry"), ["industry"], ["mean_value"])


@query("style_exposure", f"WITH {FP}, l AS (SELECT * FROM fp WHERE date = (SELECT max(date) FROM fp)) " + " UNION ALL ".join(
    f"SELECT '{f}' AS style, round(avg({f}), 6) + 0.0 AS exposure FROM l" for f in FACTORS))
def style_exposure(spark, sf_dir):
    return report(P.latest_exposure(factor_panel(spark, sf_dir), FACTORS), ["style"], ["exposure"])


@query("processor_chain", f"""WITH {FP}, q AS (SELECT *, quantile_cont(reversal_20d, 0.01) {D} AS lo, quantile_cont(reversal_20d, 0.99) {D} AS hi FROM fp),
 c AS (SELECT code, date, CASE WHEN reversal_20d IS NOT NULL THEN least(greatest(reversal_20d, lo), hi) END AS x FROM q),
 z AS (SELECT code, date, coalesce((x - avg(x) {D}) / nullif(stddev_samp(x) {D}, 0), 0) AS reversal_20d FROM c) """ + _final(["reversal_20d"], "z"))
def processor_chain(spark, sf_dir):
    n = weekly_splits(spark, sf_dir)
    P.register_step("winsorize", lambda d: P.winsorize_quantile(d, ["reversal_20d"], splits=n), ["reversal_20d"])
    P.register_step("standardize", lambda d: P.standardize(d, ["reversal_20d"], splits=n), ["reversal_20d"])
    P.register_step("needs_more", lambda d: d, ["not_there"], critical=False)
    df = factor_panel(spark, sf_dir).select("code", "date", "reversal_20d")
    return report(P.run_steps(df, ["winsorize", "needs_more", "standardize"]), ["code", "date"], ["reversal_20d"])

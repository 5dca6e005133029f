"""Candlestick patterns, timeframes, levels and volume measures."""

from pyspark.sql import functions as F

from ..functions.rolling import lag as col_lag
from ..operators import levels as L, patterns as P, timeframes as T
from .factor_queries import lag, over, roll, stage
from .indicator_queries import ewm_ctes
from .registry import query
from .tables import WEEKLY, report, weekly_bars, weekly_rows

_SHAPES = {"o": "open", "h": "high", "l": "low", "c": "close", "body": "close - open", "sz": "abs(close - open)",
           "top": "greatest(open, close)", "bot": "least(open, close)"}
_LAGS = {f"{k}{b}": lag(k, b) for k in _SHAPES for b in (1, 2)}
_SMALL = "(h > l AND sz / nullif(h - l, 0) <= 0.3"
_INSIDE = "top <= top1 AND bot >= bot1 AND sz < sz1"
_OPENS = "o1 BETWEEN bot2 AND top2 AND o BETWEEN bot1 AND top1"
_STAR = "sz1 <= 0.3 * ((sz2 + sz1) / 2) AND sz > (sz2 + sz1) / 2"


def _mark(v, cond):
    return f"CASE WHEN {cond} THEN {v} ELSE 0 END"


_RULES = {
    "doji": _mark(100, "h > l AND sz / nullif(h - l, 0) <= 0.1"),
    "hammer": _mark(100, f"{_SMALL} AND bot - l >= 2 * sz AND h - top <= 0.3 * sz)"),
    "hanging_man": _mark(-100, f"{_SMALL} AND bot - l >= 2 * sz AND h - top <= 0.3 * sz)"),
    "engulfing": "CASE WHEN body1 < 0 AND body > 0 AND sz > sz1 AND c > o1 AND o < c1 THEN 100 "
                 "WHEN body1 > 0 AND body < 0 AND sz > sz1 AND c < o1 AND o > c1 THEN -100 ELSE 0 END",
    "morning_star": _mark(100, f"body2 < 0 AND {_STAR} AND top1 < bot2 AND body > 0 AND c > (o2 + c2) / 2"),
    "evening_star": _mark(-100, f"body2 > 0 AND {_STAR} AND bot1 > top2 AND body < 0 AND c < (o2 + c2) / 2"),
    "piercing": _mark(100, "body1 < 0 AND body > 0 AND o < l1 AND c > (o1 + c1) / 2 AND c < o1"),
    "dark_cloud_cover": _mark(-100, "body1 > 0 AND body < 0 AND o > h1 AND c < (o1 + c1) / 2 AND c > o1"),
    "harami": f"CASE WHEN {_INSIDE} AND body1 < 0 AND body > 0 THEN 100 WHEN {_INSIDE} AND body1 > 0 AND body < 0 THEN -100 ELSE 0 END",
    "shooting_star": _mark(-100, f"{_SMALL} AND h - top >= 2 * sz AND bot - l <= 0.3 * sz)"),
    "inverted_hammer": _mark(100, f"{_SMALL} AND h - top >= 2 * sz AND bot - l <= 0.3 * sz)"),
    "three_white_soldiers": _mark(100, f"body > 0 AND body1 > 0 AND body2 > 0 AND c1 > c2 AND c > c1 AND {_OPENS}"),
    "three_black_crows": _mark(-100, f"body < 0 AND body1 < 0 AND body2 < 0 AND c1 < c2 AND c < c1 AND {_OPENS}"),
    "spinning_top": _mark(100, f"{_SMALL} AND bot - l > sz AND h - top > sz)"),
}
_PAT = ", ".join([stage("p1", "bars", _SHAPES), stage("p2", "p1", _LAGS), stage("pat", "p2", _RULES)])
_META = "meta(pattern, signal_type, reliability) AS (VALUES " + ", ".join(
    f"('{P.PATTERNS[n]}', '{P.PATTERN_META[P.PATTERNS[n]][0]}', '{P.PATTERN_META[P.PATTERNS[n]][1]}')" for n in P.PATTERNS) + ")"
_EVENTS = "ev AS (" + " UNION ALL ".join(
    f"SELECT code, date, '{P.PATTERNS[n]}' AS pattern, {n} AS signal FROM pat WHERE {n} <> 0" for n in P.PATTERNS) + ")"


def signals(spark, sf_dir, bars=None):
    bars = weekly_bars(spark, sf_dir) if bars is None else bars
    return P.candlesticks(bars.select("code", "date", "open", "high", "low", "close"))


@query("candlestick_signals", f"WITH {WEEKLY}, {_PAT} SELECT code, CAST(date AS VARCHAR) AS date, {', '.join(P.PATTERNS)} FROM pat")
def candlestick_signals(spark, sf_dir):
    return report(signals(spark, sf_dir), ["code", "date", *P.PATTERNS], [])


@query("candlestick_events", f"""WITH {WEEKLY}, {_PAT}, {_META}, {_EVENTS} SELECT code, CAST(date AS VARCHAR) AS date,
 pattern, signal, signal_type, reliability FROM ev JOIN meta USING (pattern)""")
def candlestick_events(spark, sf_dir):
    return report(P.pattern_events(signals(spark, sf_dir)), ["code", "date", "pattern", "signal", "signal_type", "reliability"], [])


@query("candlestick_recent", f"""WITH {WEEKLY}, {_PAT}, {_META}, {_EVENTS},
 b AS (SELECT code, date FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 20)
SELECT code, CAST(date AS VARCHAR) AS date, pattern, signal, signal_type, reliability FROM ev JOIN meta USING (pattern) JOIN b USING (code, date)""")
def candlestick_recent(spark, sf_dir):
    return report(P.recent_patterns(signals(spark, sf_dir)), ["code", "date", "pattern", "signal", "signal_type", "reliability"], [])


_SUMMARY_SQL = f"""{_PAT}, {_EVENTS},
 b60 AS (SELECT code, date FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 60),
 cnt AS (SELECT code, count(signal) FILTER (signal > 0) AS bullish_count, count(signal) FILTER (signal < 0) AS bearish_count
  FROM b60 LEFT JOIN ev USING (code, date) GROUP BY code),
 patsum AS (SELECT *, CASE WHEN bullish_count > bearish_count THEN 'bullish' WHEN bearish_count > bullish_count THEN 'bearish'
 ELSE 'neutral' END AS dominant_signal FROM cnt)"""


@query("candlestick_summary", f"WITH {WEEKLY}, {_SUMMARY_SQL} SELECT * FROM patsum")
def candlestick_summary(spark, sf_dir):
    return P.signal_summary(signals(spark, sf_dir))


@query("candlestick_metadata", f"""WITH {WEEKLY}, {_PAT}, {_META}, {_EVENTS} SELECT reliability, signal_type, count(*) AS hits
 FROM ev JOIN meta USING (pattern) GROUP BY 1, 2""")
def candlestick_metadata(spark, sf_dir):
    return P.pattern_events(signals(spark, sf_dir)).groupBy("reliability", "signal_type").agg(F.count("*").alias("hits"))


# timeframes: the key of the SQL fragments is timeframe|code, so the shared helpers apply
_FRAMES = """tag AS (
 SELECT 'daily' AS timeframe, code AS sec, date AS bucket, * EXCLUDE (code) FROM bars UNION ALL
 SELECT 'weekly', code, date + CAST((12 - dayofweek(date)) % 7 AS INTEGER), * EXCLUDE (code) FROM bars UNION ALL
 SELECT 'monthly', code, last_day(date), * EXCLUDE (code) FROM bars),
 fr AS (SELECT timeframe, sec, timeframe || '|' || sec AS code, CAST(bucket AS DATE) AS date, max(high) AS high, min(low) AS low,
  arg_max(close, tag.date) AS close FROM tag GROUP BY 1, 2, 3, tag.bucket),
 numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY date) AS DOUBLE) AS i,
  count(*) OVER (PARTITION BY code) AS n_bars FROM fr)"""
_K = lambda n: f"(2.0 / {n + 1})"
_TF = [stage("t1", "numbered", {
    **{f"ma{n}": roll("avg", "close", n) for n in (5, 10, 20, 60)}, "d": f"close - {lag('close')}",
    "sd": f"CASE WHEN count(close) {over(20)} >= 20 THEN stddev_pop(close) {over(20)} END",
    "rsv": f"coalesce((close - ({roll('min', 'low', 9, 1)})) / nullif(({roll('max', 'high', 9, 1)}) - ({roll('min', 'low', 9, 1)}), 0) * 100, 50)"}),
    stage("t2", "t1", {"g": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "l": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END",
                       "boll_position": "CASE WHEN sd > 0 THEN (close - (ma20 - 2 * sd)) / (4 * sd) ELSE 0.5 END"})]
for _name, _specs in (("t3", {"e12": ("close", "plain", _K(12), 1), "e26": ("close", "plain", _K(26), 1), "kdj_k": ("rsv", "plain", "(1.0 / 3)", 1),
                              "ag": ("g", "plain", "(1.0 / 14)", 1), "al": ("l", "plain", "(1.0 / 14)", 1)}),):
    _TF += ewm_ctes("t2", _name, _specs)[0]
_TF.append(stage("t4", "t3", {"macd_dif": "e12 - e26"}))
_TF += ewm_ctes("t4", "t5", {"macd_dea": ("macd_dif", "plain", "0.2", 1), "kdj_d": ("kdj_k", "plain", "(1.0 / 3)", 1)})[0]
_TF.append(stage("t6", "t5", {"macd_hist": "2 * (macd_dif - macd_dea)", "rsi": "coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 50)",
                              "kdj_j": "3 * kdj_k - 2 * kdj_d"}))
_TF.append(stage("t7", "t6", {f"p_{x}": lag(x) for x in ("macd_dif", "macd_dea", "kdj_k", "kdj_d")}))
_TF.append("""vw AS (SELECT *, CASE WHEN n_bars < 5 THEN 'unknown' WHEN ma5 > ma20 AND ma20 > ma60 AND macd_dif > 0 AND close > ma20 THEN 'up'
 WHEN ma5 < ma20 AND ma20 < ma60 AND macd_dif < 0 AND close < ma20 THEN 'down' ELSE 'sideways' END AS trend, abs(close - ma20) / ma20 AS away
 FROM t7 WHERE i = n_bars)""")
_TF.append("""view1 AS (SELECT *, CASE WHEN n_bars < 5 THEN 'none' WHEN trend = 'up' AND away > 0.05 AND macd_hist > 0 THEN 'strong'
 WHEN trend = 'down' AND away > 0.05 AND macd_hist < 0 THEN 'strong' WHEN trend IN ('up', 'down') AND away < 0.02 THEN 'weak'
 WHEN trend = 'sideways' AND away < 0.015 THEN 'weak' ELSE 'medium' END AS strength,
 (kdj_j > 100 OR (kdj_k > 80 AND kdj_d > 80)) AS ob FROM vw)""")
TIMEFRAME_SQL = f"{_FRAMES}, {', '.join(_TF)}"
_SIG = {
    "macd_golden_cross": "p_macd_dif <= p_macd_dea AND macd_dif > macd_dea", "macd_death_cross": "p_macd_dif >= p_macd_dea AND macd_dif < macd_dea",
    "macd_positive": "macd_hist > 0", "macd_negative": "macd_hist <= 0", "rsi_overbought": "rsi > 70", "rsi_oversold": "rsi < 30",
    "band_upper": "boll_position > 0.9", "band_lower": "boll_position < 0.1", "kdj_overbought": "ob",
    "kdj_oversold": "NOT ob AND (kdj_j < 0 OR (kdj_k < 20 AND kdj_d < 20))", "kdj_golden_cross": "p_kdj_k <= p_kdj_d AND kdj_k > kdj_d",
    "kdj_death_cross": "p_kdj_k >= p_kdj_d AND kdj_k < kdj_d"}


def frames(spark, sf_dir, bars=None):
    bars = weekly_bars(spark, sf_dir) if bars is None else bars
    return T.timeframe_indicators(T.all_timeframes(bars.drop("turnover_rate")), weekly_rows(spark, sf_dir))


_IND = T.INDICATORS


@query("timeframe_indicators", f"""WITH {WEEKLY}, {TIMEFRAME_SQL} SELECT timeframe, sec AS code, CAST(date AS VARCHAR) AS date,
 {', '.join(f'round({x}, 4) + 0.0 AS {x}' for x in _IND)} FROM t7""")
def timeframe_indicators(spark, sf_dir):
    return report(frames(spark, sf_dir), ["timeframe", "code", "date"], _IND, 4)


@query("timeframe_view", f"""WITH {WEEKLY}, {TIMEFRAME_SQL} SELECT timeframe, sec AS code, CAST(date AS VARCHAR) AS date, trend, strength,
 {', '.join(f'round({x}, 4) + 0.0 AS {x}' for x in _IND)} FROM view1""")
def timeframe_view(spark, sf_dir):
    return report(T.latest_view(frames(spark, sf_dir)), ["timeframe", "code", "date", "trend", "strength"], _IND, 4)


@query("timeframe_signals", f"WITH {WEEKLY}, {TIMEFRAME_SQL} " + " UNION ALL ".join(
    f"SELECT timeframe, sec AS code, CAST(date AS VARCHAR) AS date, '{k}' AS signal FROM view1 WHERE n_bars >= 5 AND ({c})" for k, c in _SIG.items()))
def timeframe_signals(spark, sf_dir):
    return report(T.signals_long(T.latest_view(frames(spark, sf_dir))), ["timeframe", "code", "date", "signal"], [])


_RES = """res AS (SELECT sec AS code, coalesce(max(trend) FILTER (timeframe = 'daily'), 'unknown') AS daily_trend,
 coalesce(max(trend) FILTER (timeframe = 'weekly'), 'unknown') AS weekly_trend,
 coalesce(max(trend) FILTER (timeframe = 'monthly'), 'unknown') AS monthly_trend FROM view1 GROUP BY 1),
 reso AS (SELECT *, daily_trend = 'up' AND monthly_trend = 'up' AS bullish, daily_trend = 'down' AND monthly_trend = 'down' AS bearish,
 daily_trend = 'up' AND weekly_trend = 'up' AND monthly_trend = 'up' AS all_bullish,
 daily_trend = 'down' AND weekly_trend = 'down' AND monthly_trend = 'down' AS all_bearish FROM res)"""


@query("timeframe_resonance", f"WITH {WEEKLY}, {TIMEFRAME_SQL}, {_RES} SELECT * FROM reso")
def timeframe_resonance(spark, sf_dir):
    return T.resonance(T.latest_view(frames(spark, sf_dir)))


_DIV = """dv AS (SELECT timeframe, sec, n_bars - i + 1 AS back, close, macd_dif, rsi FROM t7 WHERE n_bars >= 30 AND n_bars - i < 60),
 dg AS (SELECT timeframe, sec, max(close) FILTER (back > 5) AS ph, min(close) FILTER (back > 5) AS pl, max(close) FILTER (back <= 5) AS nh,
  min(close) FILTER (back <= 5) AS nl, count(*) FILTER (back > 5) AS np,
  max(macd_dif) FILTER (back = 1) AS now_m, arg_max(macd_dif, (close, back)) FILTER (back > 5) AS top_m, arg_min(macd_dif, (close, -back)) FILTER (back > 5) AS bot_m,
  max(rsi) FILTER (back = 1) AS now_r, arg_max(rsi, (close, back)) FILTER (back > 5) AS top_r, arg_min(rsi, (close, -back)) FILTER (back > 5) AS bot_r
  FROM dv GROUP BY 1, 2),
 dvg AS (SELECT timeframe, sec AS code, 'top' AS type, 'MACD' AS indicator FROM dg WHERE np >= 10 AND nh > ph AND now_m < top_m UNION ALL
 SELECT timeframe, sec, 'bottom', 'MACD' FROM dg WHERE np >= 10 AND nl < pl AND now_m > bot_m UNION ALL
 SELECT timeframe, sec, 'top', 'RSI' FROM dg WHERE np >= 10 AND nh > ph AND now_r < top_r UNION ALL
 SELECT timeframe, sec, 'bottom', 'RSI' FROM dg WHERE np >= 10 AND nl < pl AND now_r > bot_r)"""


@query("timeframe_divergence", f"WITH {WEEKLY}, {TIMEFRAME_SQL}, {_DIV} SELECT * FROM dvg")
def timeframe_divergence(spark, sf_dir):
    return T.divergences(frames(spark, sf_dir))


# levels
_REC = """rk AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY code) AS n,
 CAST(row_number() OVER (PARTITION BY code ORDER BY date) AS INTEGER) AS pos FROM bars)"""
_FIB = f"""f1 AS (SELECT code, max(high) AS hi, min(low) AS lo, max(close) FILTER (back = 1) AS cur,
 avg(close) FILTER (back > least(n, 120) - least(n, 120) // 2) AS a, avg(close) FILTER (back <= least(n, 120) - least(n, 120) // 2) AS b, count(*) AS k
 FROM rk WHERE back <= 120 GROUP BY code),
 f2 AS (SELECT code, cur, ratio, CASE WHEN b >= a THEN hi - ratio * (hi - lo) ELSE lo + ratio * (hi - lo) END AS p
 FROM f1, (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in L.FIB_RATIOS)}]) AS ratio) WHERE k >= 2 AND hi > lo),
 fib AS (SELECT code, ratio, round(p, 4) AS price, CASE WHEN p > cur THEN 'resistance' ELSE 'support' END AS type FROM f2)"""
PRICE_OUT = "round(price, 3) + 0.0 AS price"


@query("levels_fibonacci", f"WITH {WEEKLY}, {_REC}, {_FIB} SELECT code, ratio, type, {PRICE_OUT} FROM fib")
def levels_fibonacci(spark, sf_dir):
    return report(L.fibonacci(weekly_bars(spark, sf_dir)), ["code", "ratio", "type"], ["price"], 3)


def _ext_sql():
    parts = []
    for i, (w, s) in enumerate(L.EXTREME_STRENGTH.items()):
        k = max(2, w // 2)
        for j, (x, fn, op, side) in enumerate((("high", "max", ">", "prior_high"), ("low", "min", "<", "prior_low"))):
            b = f"{fn}({x}) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
            a = f"{fn}({x}) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
            parts.append(f"SELECT code, round({x}, 4) AS price, '{side}_{w}' AS label, '{s}' AS strength, '{side}' AS method, "
                         f"[0, {i}, {j}, pos] AS rank FROM (SELECT *, {b} AS bb, {a} AS aa FROM rk) WHERE n >= {2 * k + 1} AND {x} {op} bb AND {x} {op} aa")
    return "prior AS (" + " UNION ALL ".join(parts) + ")"


_MAS = "lm AS (SELECT *, " + ", ".join(f"{roll('avg', 'close', n)} AS m{n}" for n in L.MA_STRENGTH) + \
       f", {roll('avg', 'close', 20)} AS bm, {roll('stddev_samp', 'close', 20)} AS bs FROM rk), ml AS (" + " UNION ALL ".join(
    f"SELECT code, round(m{n}, 4) AS price, 'ma_{n}' AS label, '{s}' AS strength, 'ma_{n}' AS method, [1, {n}, 0, 0] AS rank FROM lm WHERE back = 1 AND m{n} IS NOT NULL"
    for n, s in L.MA_STRENGTH.items()) + ")"
_BANDS = "bl AS (" + " UNION ALL ".join(
    f"SELECT code, round({e}, 4) AS price, 'band_{k}' AS label, '{s}' AS strength, 'bollinger_{k}' AS method, [3, {i}, 0, 0] AS rank FROM lm WHERE back = 1 AND {e} IS NOT NULL"
    for i, (k, e, s) in enumerate((("upper", "bm + 2 * bs", "medium"), ("lower", "bm - 2 * bs", "medium"), ("middle", "bm", "weak")))) + ")"
_RND = "r1 AS (SELECT code, close AS cur FROM rk WHERE back = 1), r2 AS (" + " UNION ALL ".join(
    f"SELECT code, floor(cur / {k}) * {k} + {d} AS price, {k} AS step, '{s}' AS strength, {i} AS i FROM r1"
    for i, (k, s) in enumerate(L.ROUND_STRENGTH.items()) for d in (0, k)) + """),
 rl AS (SELECT code, CAST(price AS DOUBLE) AS price, 'round_' || step AS label, strength, 'round_number' AS method, [4, i, 0, 0] AS rank
 FROM r2 WHERE price > 0 QUALIFY row_number() OVER (PARTITION BY code, price ORDER BY list_position(['weak', 'medium', 'strong', 'very_strong'], strength) DESC, i) = 1)"""
_ZONE = """z1 AS (SELECT code, (high + low + close) / 3 AS tp, volume FROM rk WHERE back <= 60),
 z2 AS (SELECT *, min(tp) OVER w AS lo, max(tp) OVER w AS hi, count(*) OVER w AS k, sum(volume) OVER w AS tot FROM z1 WINDOW w AS (PARTITION BY code)),
 z3 AS (SELECT code, CAST(least(floor((tp - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, sum(volume) AS v, min(lo) AS lo, min(hi) AS hi, min(tot) AS tot
  FROM z2 WHERE k >= 20 AND hi > lo AND tot > 0 GROUP BY 1, 2),
 zl AS (SELECT code, round(lo + (bin + 0.5) * (hi - lo) / 20, 4) AS price, 'volume_zone' AS label, CASE WHEN v / (tot / 20) >= 2.5 THEN 'very_strong'
  WHEN v / (tot / 20) >= 2.0 THEN 'strong' ELSE 'medium' END AS strength, 'volume_zone' AS method, [5, bin, 0, 0] AS rank FROM z3 WHERE v / (tot / 20) >= 1.5)"""
_FL = "fl AS (SELECT code, price, 'fib_' || ratio AS label, 'medium' AS strength, 'fibonacci' AS method, [2, CAST(ratio * 1000 AS INTEGER), 0, 0] AS rank FROM fib WHERE ratio NOT IN (0, 1))"
_ALL = f"{_REC}, {_FIB}, {_ext_sql()}, {_MAS}, {_BANDS}, {_RND}, {_ZONE}, {_FL}, alll AS (" + " UNION ALL ".join(
    f"SELECT code, price, label, strength, method, rank FROM {t}" for t in ("prior", "ml", "fl", "bl", "rl", "zl")) + ")"
LEVEL_COLS = ["code", "label", "strength", "method"]


@query("levels_all", f"WITH {WEEKLY}, {_ALL} SELECT code, label, strength, method, {PRICE_OUT} FROM alll")
def levels_all(spark, sf_dir):
    return report(L.all_levels(weekly_bars(spark, sf_dir)), LEVEL_COLS, ["price"], 3)


MERGE_SQL = f"""{_ALL},
 so AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY price, rank) AS k, list_position(['weak', 'medium', 'strong', 'very_strong'], strength) AS sr FROM alll),
 fold AS (SELECT code, k, price, label, strength, method, sr, 1 AS grp FROM so WHERE k = 1 UNION ALL
  SELECT so.code, so.k, CASE WHEN near AND so.sr <= f.sr THEN f.price ELSE so.price END, CASE WHEN near AND so.sr <= f.sr THEN f.label ELSE so.label END,
  CASE WHEN near AND so.sr <= f.sr THEN f.strength ELSE so.strength END, CASE WHEN near AND so.sr <= f.sr THEN f.method ELSE so.method END,
  CASE WHEN near AND so.sr <= f.sr THEN f.sr ELSE so.sr END, CASE WHEN near THEN f.grp ELSE f.grp + 1 END
  FROM (SELECT f0.*, s0.k AS nk, abs(s0.price - f0.price) <= greatest(abs(f0.price) * 0.001, 0.01) AS near FROM fold f0 JOIN so s0 ON s0.code = f0.code AND s0.k = f0.k + 1) f
  JOIN so ON so.code = f.code AND so.k = f.nk),
 merged AS (SELECT code, price, label, strength, method FROM fold QUALIFY row_number() OVER (PARTITION BY code, grp ORDER BY k DESC) = 1),
 cur AS (SELECT code, close AS current FROM rk WHERE back = 1),
 split AS (SELECT merged.*, current, CASE WHEN price > current + greatest(current * 0.001, 0.01) THEN 'resistance'
  WHEN price < current - greatest(current * 0.001, 0.01) THEN 'support' END AS side FROM merged JOIN cur USING (code)),
 near AS (SELECT code, min(current) AS current, min(price) FILTER (side = 'resistance') AS nearest_resistance, max(price) FILTER (side = 'support') AS nearest_support,
  count(*) FILTER (side = 'resistance') AS n_resistance, count(*) FILTER (side = 'support') AS n_support FROM split WHERE side IS NOT NULL GROUP BY code)"""


def split(bars):
    return L.split_levels(L.merge_levels(L.all_levels(bars)), L.current_prices(bars))


@query("levels_merged", f"WITH RECURSIVE {WEEKLY}, {MERGE_SQL} SELECT code, label, strength, method, side, {PRICE_OUT} FROM split WHERE side IS NOT NULL")
def levels_merged(spark, sf_dir):
    return report(split(weekly_bars(spark, sf_dir)), [*LEVEL_COLS, "side"], ["price"], 3)


@query("levels_nearest", f"""WITH RECURSIVE {WEEKLY}, {MERGE_SQL} SELECT code, n_resistance, n_support, round(current, 3) + 0.0 AS current,
 round(nearest_resistance, 3) + 0.0 AS nearest_resistance, round(nearest_support, 3) + 0.0 AS nearest_support FROM near""")
def levels_nearest(spark, sf_dir):
    return report(L.nearest_levels(split(weekly_bars(spark, sf_dir))), ["code", "n_resistance", "n_support"],
                  ["current", "nearest_resistance", "nearest_support"], 3)


VOLUME_SQL = f"""v1 AS (SELECT *, {lag('close')} AS prev, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY code) AS n FROM bars),
 v2 AS (SELECT *, CASE WHEN back < least(n, 20) THEN close - prev END AS ret FROM v1 WHERE back <= 20),
 v3 AS (SELECT code, max(n) AS n, coalesce(avg(volume) FILTER (ret > 0), 0) AS up, coalesce(avg(volume) FILTER (ret < 0), 0) AS dn,
  avg(volume) FILTER (back <= 5) / nullif(avg(volume) FILTER (back BETWEEN 6 AND 15), 0) AS ch FROM v2 GROUP BY code),
 vol AS (SELECT code, CASE WHEN n < 10 THEN NULL WHEN up > 0 AND dn > 0 THEN up / dn WHEN up > 0 THEN 2.0 WHEN dn > 0 THEN 0.3 ELSE 1.0 END AS up_down_volume_ratio,
  CASE WHEN n < 15 THEN 'unknown' WHEN ch > 1.2 THEN 'increasing' WHEN ch < 0.8 THEN 'decreasing' ELSE 'stable' END AS volume_trend FROM v3)"""


@query("volume_measures", f"WITH {WEEKLY}, {VOLUME_SQL} SELECT code, volume_trend, round(up_down_volume_ratio, 6) + 0.0 AS up_down_volume_ratio FROM vol")
def volume_measures(spark, sf_dir):
    return report(L.volume_measures(weekly_bars(spark, sf_dir)), ["code", "volume_trend"], ["up_down_volume_ratio"])


# board prefixes and ST flags: codes are renumbered so that all three limits occur
@query("limit_counts", f"""WITH {WEEKLY}, x AS (SELECT CASE CAST(substr(code, 1, 6) AS INTEGER) % 3 WHEN 0 THEN '300' WHEN 1 THEN '688' ELSE '000' END || substr(code, 4) AS code,
 date, close, {lag('close')} AS pre_close, CAST(substr(code, 1, 6) AS INTEGER) % 5 = 0 AS is_st FROM bars),
 y AS (SELECT *, CASE WHEN substr(code, 1, 3) IN ('300', '301', '688') THEN 0.2 WHEN is_st THEN 0.05 ELSE 0.1 END AS lim, (close - pre_close) / pre_close AS mv,
 row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM x)
SELECT code, round(max(lim), 4) + 0.0 AS limit, count(*) FILTER (mv >= lim - 0.001) AS limit_ups, count(*) FILTER (mv <= -lim + 0.001) AS limit_downs,
 coalesce(bool_or(mv >= lim - 0.02) FILTER (back = 1), false) AS near_limit FROM y WHERE back <= 20 GROUP BY code""")
def limit_counts(spark, sf_dir):
    num = F.substring("code", 1, 6).cast("int")
    head = F.when(num % 3 == 0, "300").when(num % 3 == 1, "688").otherwise("000")
    panel = weekly_bars(spark, sf_dir).withColumn("pre_close", col_lag("close"))
    panel = panel.select(F.concat(head, F.substring("code", 4, 100)).alias("code"), "date", "close", "pre_close", (num % 5 == 0).alias("is_st"))
    return report(L.limit_counts(panel), ["code", "limit_ups", "limit_downs", "near_limit"], [("limit", 4)])

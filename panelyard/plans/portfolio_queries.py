"""Curve metrics, signal portfolios, weights, attribution and risk.

Every code's weekly close is one equity curve; the market's average price is the benchmark.
"""

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.columns import change_pct
from ..operators import cleaning as C, curves as CU, pit as PT, portfolio as PF, process as PR, risk as RK
from .evaluation_queries import D, factor_panel, FP
from .factor_queries import lag, out as outs, over, rank_sql, roll, stage
from .registry import query
from .tables import INDUSTRY, WEEKLY, industries, report, table, weekly_bars, weekly_splits

KEY = "strategy_id"


def curves(spark, sf_dir):
    return weekly_bars(spark, sf_dir).select(F.col("code").alias(KEY), "date", F.col("close").alias("equity"))


def market_curve(spark, sf_dir):
    return weekly_bars(spark, sf_dir).groupBy("date").agg((F.sum("amount") / F.sum("volume")).alias("equity"))


CURVE = f"""c0 AS (SELECT code, date, close AS equity FROM bars),
 {stage('c1', 'c0', {'ret': f"equity / nullif({lag('equity')}, 0) - 1", 'peak': f'max(equity) {over()}', 'pos': f'row_number() {over()}'})},
 {stage('c2', 'c1', {'dd': 'equity / peak - 1', 'lr': 'ln(1 + ret)'})}, {stage('c3', 'c2', {'cl': f'CASE WHEN ret IS NOT NULL THEN sum(lr) {over()} END'})},
 c4 AS (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY code) AS ql, quantile_cont(ret, 0.95) OVER (PARTITION BY code) AS qh FROM c3),
 g0 AS (SELECT code, count(*) AS n_points, count(ret) AS n_returns, arg_min(equity, date) AS f, arg_max(equity, date) AS l, avg(ret) AS m, stddev_samp(ret) AS sd,
  min(dd) AS max_drawdown, stddev_samp(ret) FILTER (ret < 0) AS dn, count(*) FILTER (ret < 0) AS ndn, sqrt(avg(power(least(ret, 0), 2)) FILTER (ret IS NOT NULL)) AS drms,
  avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0 END) AS win_rate, coalesce(skewness(ret), 0) AS skewness, coalesce(kurtosis(ret), 0) AS kurtosis,
  max(ret) AS best_day, min(ret) AS worst_day, min(ql) AS ql, min(qh) AS qh, avg(ret) FILTER (ret <= ql) AS tail, sum(ret) FILTER (ret > 0) AS gain, -sum(ret) FILTER (ret < 0) AS loss,
  coalesce(sqrt(avg(dd * dd) FILTER (dd < 0)), 0) AS ulcer_index, avg(abs(dd)) AS add_, power(corr(pos, cl) FILTER (cl IS NOT NULL), 2) AS stability_r2 FROM c4 GROUP BY code),
 {stage('g1', 'g0', {'total_return': 'l / f - 1', 'annual_return': 'power(l / f, 252.0 / n_points) - 1', 'annual_return_by_returns': 'power(l / f, 252.0 / n_returns) - 1',
  'volatility': 'sd * sqrt(252)', 'ex': 'm * 252 - 0.03'})},
 {stage('g2', 'g1', {'sharpe': 'ex / volatility', 'sharpe_compound': '(annual_return_by_returns - 0.03) / volatility', 'sortino': 'CASE WHEN ndn >= 2 THEN ex / (dn * sqrt(252)) ELSE 0 END',
  'sortino_compound': '(annual_return_by_returns - 0.03) / (dn * sqrt(252))', 'sortino_rms': 'ex / (drms * sqrt(252))', 'calmar': 'annual_return / abs(max_drawdown)',
  'var_95': 'CASE WHEN n_returns >= 20 THEN -ql ELSE 0 END', 'cvar_95': 'CASE WHEN n_returns >= 20 THEN -tail ELSE 0 END', 'omega': 'gain / loss', 'gain_to_pain': 'gain / loss',
  'profit_factor': 'gain / loss', 'upi': '(annual_return_by_returns - 0.03) / ulcer_index', 'serenity': '(annual_return_by_returns - 0.03) / add_', 'tail_ratio': 'abs(qh / ql)',
  'sr': '(m - 0.03 / 252) / sd * sqrt(252)'})},
 {stage('g3', 'g2', {'sp': '(1 + 0.5 * sharpe * sharpe - skewness * sharpe + (kurtosis - 3) / 4 * sharpe * sharpe) / (n_returns - 1)',
  'best': f'{CU.expected_max_sharpe(10)!r} * sqrt(1.0 / n_returns)',
  'den': '1 - skewness * sr + (CASE WHEN kurtosis <= 0 THEN 3.0001 ELSE kurtosis + 3 END - 1) / 4 * sr * sr'})},
 met AS (SELECT *, CASE WHEN sp > 0 THEN (sharpe - best) / sqrt(sp) ELSE sharpe - best END AS deflated_sharpe, CASE WHEN den > 0 THEN sr / sqrt(den) ELSE 0 END AS deflated_sharpe_moment FROM g3)"""


@query("curve_metrics", f"WITH {WEEKLY}, {CURVE} SELECT code AS strategy_id, n_points, n_returns, {outs(CU.METRICS, 5)} FROM met")
def curve_metrics(spark, sf_dir):
    return report(CU.all_metrics(curves(spark, sf_dir)), [KEY, "n_points", "n_returns"], CU.METRICS, 5)


@query("drawdown_series", f"WITH {WEEKLY}, {CURVE} SELECT code AS strategy_id, CAST(date AS VARCHAR) AS date, round(dd, 6) + 0.0 AS drawdown FROM c2")
def drawdown_series(spark, sf_dir):
    return report(CU.curve_rows(curves(spark, sf_dir)), [KEY, "date"], ["drawdown"])


@query("drawdown_summary", f"""WITH {WEEKLY}, {CURVE}, r0 AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) {over()} AS run FROM c2),
 r1 AS (SELECT code, run, min(dd) AS depth, count(*) AS days FROM r0 WHERE dd < 0 GROUP BY 1, 2)
SELECT code AS strategy_id, count(*) AS dd_count, max(days) AS max_duration, CAST(1 AS BIGINT) AS max_recovery, round(avg(depth), 6) + 0.0 AS avg_depth, round(min(depth), 6) + 0.0 AS max_depth FROM r1 GROUP BY code""")
def drawdown_summary(spark, sf_dir):
    d = CU.drawdown_summary(curves(spark, sf_dir))
    d = d.withColumn("max_recovery", F.col("max_recovery").cast("long"))
    return report(d, [KEY, "dd_count", "max_duration", "max_recovery"], ["avg_depth", "max_depth"])


_MON = f"mo AS (SELECT code, year(date) AS year, month(date) AS month, exp(sum(lr)) - 1 AS r FROM c2 WHERE ret IS NOT NULL GROUP BY 1, 2, 3)"


@query("monthly_returns", f"WITH {WEEKLY}, {CURVE}, {_MON} SELECT code AS strategy_id, CAST(year AS INTEGER) AS year, " + ", ".join(
    f"round(max(r) FILTER (month = {m}), 6) + 0.0 AS m{m:02d}" for m in range(1, 13)) + " FROM mo GROUP BY 1, 2")
def monthly_returns(spark, sf_dir):
    return report(CU.monthly_table(curves(spark, sf_dir)), [KEY, "year"], [f"m{m:02d}" for m in range(1, 13)])


BENCH = f"""b0 AS (SELECT 'benchmark' AS code, date, sum(amount) / sum(volume) AS equity FROM bars GROUP BY date),
 {stage('b1', 'b0', {'ret': f"equity / {lag('equity')} - 1", 'dd': f'equity / max(equity) {over()} - 1'})},
 bm AS (SELECT arg_max(equity, date) / arg_min(equity, date) - 1 AS benchmark_return, stddev_samp(ret) * sqrt(252) AS benchmark_volatility, min(dd) AS benchmark_max_drawdown FROM b1),
 al AS (SELECT c2.code, c2.ret AS p, b1.ret AS b FROM c2 JOIN b1 USING (date) WHERE c2.ret IS NOT NULL AND b1.ret IS NOT NULL),
 ag AS (SELECT code, count(*) AS n_common, avg(p) AS mp, avg(b) AS mb, covar_samp(p, b) / var_samp(b) AS beta, stddev_samp(p - b) AS te, avg(p) FILTER (b > 0) / avg(b) FILTER (b > 0) AS up_capture,
  avg(p) FILTER (b < 0) / avg(b) FILTER (b < 0) AS down_capture FROM al GROUP BY code)"""
_BM = ["beta", "alpha_capm", "alpha_backtest", "alpha_extended", "information_ratio", "up_capture", "down_capture", "benchmark_return", "benchmark_volatility",
       "benchmark_max_drawdown", "excess_return"]


@query("benchmark_metrics", f"""WITH {WEEKLY}, {CURVE}, {BENCH}, j AS (SELECT ag.*, bm.*, annual_return, total_return FROM ag JOIN met USING (code), bm),
 k AS (SELECT *, 252 * ((mp - 0.03 / 252) - beta * (mb - 0.03 / 252)) AS alpha_capm, annual_return - beta * benchmark_return AS alpha_backtest,
 mp * 252 - (0.03 + beta * (mb * 252 - 0.03)) AS alpha_extended, (mp - mb) * 252 / (te * sqrt(252)) AS information_ratio, total_return - benchmark_return AS excess_return FROM j)
SELECT code AS strategy_id, n_common, {outs(_BM, 5)} FROM k""")
def benchmark_metrics(spark, sf_dir):
    return report(CU.benchmark_metrics(curves(spark, sf_dir), market_curve(spark, sf_dir)), [KEY, "n_common"], _BM, 5)


SEG = """sg AS (SELECT code, floor((pos - 2) / 100) AS s, avg(ret) AS m, stddev_samp(ret) AS sd FROM c2 WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 AND stddev_samp(ret) > 0),
 seg AS (SELECT code, count(*) AS segment_count, CASE WHEN count(*) >= 2 THEN stddev_samp((power(1 + m, 252) - 1) / (sd * sqrt(252))) ELSE 0 END AS seg_ir_std FROM sg GROUP BY code)"""


# weekly closes jump too much to compound 252 times, so segments use a 60-week mean
SMOOTH = CURVE.replace("close AS equity", f"{roll('avg', 'close', 60, 1)} AS equity")


def smooth_curves(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir)
    return bars.select(F.col("code").alias(KEY), "date", R.mean("close", 60, 1).alias("equity"))


@query("segment_consistency", f"WITH {WEEKLY}, {SMOOTH}, {SEG} SELECT code AS strategy_id, segment_count, round(ln(1 + seg_ir_std), 4) + 0.0 AS log_spread FROM seg")
def segment_consistency(spark, sf_dir):
    s = CU.segment_consistency(smooth_curves(spark, sf_dir), 100)
    return report(s.withColumn("log_spread", F.log1p("seg_ir_std")), [KEY, "segment_count"], [("log_spread", 4)])


SIGNAL = f"sgn AS (SELECT code, date, CASE WHEN {rank_sql('volume')} > 0.8 THEN 1 ELSE 0 END AS signal FROM bars)"


def volume_signal(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("code", "date", "volume")
    return PR.top_signal(bars, "volume", splits=weekly_splits(spark, sf_dir)).select("code", "date", "signal")


@query("signal_changes", f"WITH {WEEKLY}, {SIGNAL}, d AS (SELECT code, signal - {lag('signal')} AS d FROM sgn) SELECT code, count(*) FILTER (d <> 0) AS trade_count FROM d GROUP BY code")
def signal_changes(spark, sf_dir):
    s = volume_signal(spark, sf_dir).withColumn(KEY, F.col("code"))
    return PF.signal_changes(s, (KEY,)).withColumnRenamed(KEY, "code")


@query("strategy_verdict", f"""WITH {WEEKLY}, {SMOOTH}, {SEG}, {SIGNAL}, d AS (SELECT code, signal - {lag('signal')} AS d FROM sgn), tc AS (SELECT code, count(*) FILTER (d <> 0) AS trade_count FROM d GROUP BY code),
 j AS (SELECT met.code, concat_ws(',', CASE WHEN sharpe < 0.8 THEN 'sharpe' END, CASE WHEN calmar < 0.5 THEN 'calmar' END, CASE WHEN abs(max_drawdown) > 0.35 THEN 'max_drawdown' END,
 CASE WHEN trade_count < 50 THEN 'trades' END, CASE WHEN segment_count >= 2 AND seg_ir_std > 0.5 THEN 'segments' END) AS failed_gates, trade_count, segment_count FROM met JOIN seg USING (code) JOIN tc USING (code))
SELECT code AS strategy_id, failed_gates, trade_count, segment_count, CASE WHEN failed_gates <> '' THEN 'rejected' ELSE 'candidate' END AS state FROM j""")
def strategy_verdict(spark, sf_dir):
    c = smooth_curves(spark, sf_dir)
    trades = PF.signal_changes(volume_signal(spark, sf_dir).withColumn(KEY, F.col("code")), (KEY,))
    v = CU.judge(CU.all_metrics(c), CU.segment_consistency(c, 100), trades)
    return v.select(KEY, F.concat_ws(",", "failed_gates").alias("failed_gates"), "trade_count", "segment_count", "state")


@query("tradable_signals", f"""WITH {WEEKLY}, {SIGNAL}, p AS (SELECT code, date, (close / {lag('close')} - 1) * 100 AS ch FROM bars)
SELECT code, CAST(date AS VARCHAR) AS date, signal, NOT (signal > 0 AND coalesce(ch >= 9.9, false)) AS can_trade FROM sgn JOIN p USING (code, date)""")
def tradable_signals(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("code", "date", "close").withColumn("change_pct", change_pct("close", R.lag("close")))
    return report(PF.tradable(volume_signal(spark, sf_dir), C.flag_limits(bars)), ["code", "date", "signal", "can_trade"], [])


_PORT = f"""nh AS (SELECT date, count(*) AS n FROM sgn WHERE signal > 0 GROUP BY date),
 pj AS (SELECT sgn.code, sgn.date, coalesce(lead(close) OVER w / close - 1, 0) AS nr, CASE WHEN signal > 0 THEN 1.0 / n ELSE 0 END AS wt FROM sgn JOIN bars USING (code, date) LEFT JOIN nh ON nh.date = sgn.date WINDOW w AS (PARTITION BY sgn.code ORDER BY sgn.date)),
 pm AS (SELECT *, abs(wt - coalesce({lag('wt')}, 0)) AS mv FROM pj),
 pr AS (SELECT date, sum(wt * nr) AS gross_return, sum(mv) AS traded_weight, count(*) FILTER (wt > 0) AS n_held, sum(mv) * {PF.COMMISSION + PF.SLIPPAGE + PF.STAMP_TAX / 2!r} AS cost FROM pm GROUP BY date)"""
_PR = ["gross_return", "net_return", "traded_weight", "cost"]


@query("signal_portfolio_returns", f"WITH {WEEKLY}, {SIGNAL}, {_PORT}, z AS (SELECT *, gross_return - cost AS net_return FROM pr) SELECT CAST(date AS VARCHAR) AS date, n_held, {outs(_PR)} FROM z")
def signal_portfolio_returns(spark, sf_dir):
    return report(PF.portfolio_returns(volume_signal(spark, sf_dir), weekly_bars(spark, sf_dir)), ["date", "n_held"], _PR)


@query("cost_drag", f"""WITH {WEEKLY}, {SIGNAL}, {_PORT}, z AS (SELECT ln(1 + gross_return) AS g, ln(1 + gross_return - cost) AS n FROM pr)
SELECT round(sum(g), 6) + 0.0 AS log_gross, round(sum(n), 6) + 0.0 AS log_net FROM z""")
def cost_drag(spark, sf_dir):
    # weekly returns compound far beyond a report's range, hence logarithms
    d = PF.cost_drag(PF.portfolio_returns(volume_signal(spark, sf_dir), weekly_bars(spark, sf_dir)))
    return report(d.select(F.log1p("gross_total_return").alias("log_gross"), F.log1p("net_total_return").alias("log_net")), [], ["log_gross", "log_net"])


_COST = ["fill_price", "amount", "commission", "stamp_tax", "transfer_fee", "total_cost"]


@query("trade_costs", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_extendedprice / l_quantity / 1000 AS price, l_quantity * 100 AS shares FROM lineitem),
 u AS (SELECT *, price * CASE WHEN side = 'sell' THEN 1 - 0.001 ELSE 1 + 0.001 END AS fill_price FROM t), v AS (SELECT *, fill_price * shares AS amount FROM u),
 w AS (SELECT *, greatest(amount * 0.00025, 5.0) AS commission, CASE WHEN side = 'sell' THEN amount * 0.001 ELSE 0 END AS stamp_tax, amount * 0.00002 AS transfer_fee FROM v),
 z AS (SELECT *, commission + stamp_tax + transfer_fee AS total_cost FROM w) SELECT l_orderkey, l_linenumber, l_suppkey, side, {outs(_COST, 4)} FROM z""")
def trade_costs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("price"), (F.col("l_quantity") * 100).alias("shares"))
    return report(PF.trade_costs(li), ["l_orderkey", "l_linenumber", "l_suppkey", "side"], _COST, 4)


_TGT = "tg AS (SELECT code, arg_max(close, date) AS price, arg_max(volume, date) AS v, CAST(floor(arg_max(amount, date)) AS BIGINT) % 40 AS k FROM bars GROUP BY code), tw AS (SELECT *, v / sum(v) OVER () AS weight FROM tg)"


def targets(spark, sf_dir):
    """Target weights by newest volume; holdings from the newest amount."""
    t = C.latest_row(weekly_bars(spark, sf_dir)).select("code", F.col("close").alias("price"), F.col("volume").alias("v"), (F.col("amount").cast("long") % 40).alias("k"))
    total = t.agg(F.sum("v").alias("_t"))
    return t.crossJoin(F.broadcast(total)).withColumn("weight", F.col("v") / F.col("_t"))


@query("rebalance_orders", f"""WITH {WEEKLY}, {_TGT}, h AS (SELECT code, k * 100 AS shares, (k // 2) * 100 AS available FROM tw WHERE k > 5),
 j AS (SELECT tw.code, price, coalesce(shares, 0) AS sh, coalesce(available, coalesce(shares, 0)) AS av, CAST(floor(100000000 * weight / price / 100) * 100 AS BIGINT) AS t FROM tw LEFT JOIN h USING (code)),
 o AS (SELECT code, price, CASE WHEN t > sh THEN CASE WHEN t - sh >= 100 THEN 'buy' END WHEN t < av THEN CASE WHEN av - t >= 100 THEN 'sell' END END AS side, t, sh, av FROM j)
SELECT code, side, CASE WHEN side = 'buy' THEN t - sh ELSE av - t END AS volume, round(price, 6) + 0.0 AS price FROM o WHERE side IS NOT NULL""")
def rebalance_orders(spark, sf_dir):
    t = targets(spark, sf_dir)
    h = t.where("k > 5").select("code", (F.col("k") * 100).alias("shares"), (F.floor(F.col("k") / 2) * 100).alias("available"))
    return report(PF.rebalance_orders(t.select("code", "weight", "price"), h, 1e8), ["code", "side", "volume"], ["price"])


@query("weights_equal", f"WITH {WEEKLY}, c AS (SELECT DISTINCT code FROM bars) SELECT code, round(1.0 / count(*) OVER (), 8) + 0.0 AS weight FROM c")
def weights_equal(spark, sf_dir):
    return report(PF.equal_weights(weekly_bars(spark, sf_dir).select("code").distinct()), ["code"], [("weight", 8)])


# weekly returns of nations: complete on almost every week, so that covariance has dates
NATION = f"""nb AS (SELECT n_name AS code, date_trunc('week', l_shipdate)::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_extendedprice) AS amount
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), nr AS (SELECT code, date, amount, close / {lag('close')} - 1 AS ret FROM nb)"""


def nation_returns(spark, sf_dir):
    li, su, na = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    week = F.date_trunc("week", "l_shipdate").cast("date")
    per = li.groupBy("l_suppkey", week.alias("date")).agg(F.sum("l_extendedprice").alias("a"), F.sum("l_quantity").alias("q"))
    geo = su.join(na, su.s_nationkey == na.n_nationkey).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("code"))
    nb = per.join(geo, "l_suppkey").groupBy("code", "date").agg((F.sum("a") / F.sum("q")).alias("close"), F.sum("a").alias("amount"))
    return nb.select("code", "date", "amount", R.pct_change("close").alias("ret"))


@query("expected_returns", f"""WITH {NATION}, a AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) - 1 AS age FROM nr WHERE ret IS NOT NULL),
 m AS (SELECT date, avg(ret) AS mk FROM nr GROUP BY date), pm AS (SELECT exp(sum(ln(1 + mk)) * 52 / count(mk)) - 1 AS p FROM m),
 b AS (SELECT code, covar_pop(ret, mk) / var_pop(mk) AS beta FROM nr JOIN m USING (date) WHERE ret IS NOT NULL GROUP BY code)
SELECT code, round(exp(sum(ln(1 + ret)) * 52 / count(ret)) - 1, 5) + 0.0 AS mean_historical, round(ln(power(1 + sum(power(1 - 2.0 / 101, age) * ret) / sum(power(1 - 2.0 / 101, age)), 52)), 5) + 0.0 AS ema_log,
 round(0.02 + min(beta) * (min(p) - 0.02), 5) + 0.0 AS capm FROM a JOIN b USING (code), pm GROUP BY code""")
def expected_returns(spark, sf_dir):
    r = nation_returns(spark, sf_dir)
    mean = PF.expected_returns(r, "mean_historical", 52).withColumnRenamed("expected", "mean_historical")
    ema = PF.expected_returns(r, "ema_historical", 52, 100).select("code", F.log1p("expected").alias("ema_log"))
    capm = PF.expected_returns(r, "capm", 52).withColumnRenamed("expected", "capm")
    return report(mean.join(ema, "code").join(capm, "code"), ["code"], ["mean_historical", "ema_log", "capm"], 5)


@query("alpha_expected", f"""WITH {FP}, l AS (SELECT code, {rank_sql('reversal_20d')} AS a FROM fp WHERE date = (SELECT max(date) FROM fp))
SELECT c.code, round(coalesce(a, 0), 6) + 0.0 AS expected FROM (SELECT DISTINCT code FROM fp) c LEFT JOIN l USING (code)""")
def alpha_expected(spark, sf_dir):
    df = factor_panel(spark, sf_dir).select("code", "date", "reversal_20d")
    scored = PR.fuse(df, ["reversal_20d"], None, weekly_splits(spark, sf_dir))
    scored = scored.withColumn("alpha_score", F.when(F.col("reversal_20d").isNotNull(), F.col("alpha_score")))
    return report(PF.alpha_expected(df.select("code").distinct(), scored), ["code"], ["expected"])


@query("covariance_matrix", f"""WITH {NATION}, d AS (SELECT date FROM nr WHERE ret IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT code) FROM nr WHERE ret IS NOT NULL)),
 k AS (SELECT nr.* FROM nr JOIN d USING (date)) SELECT a.code AS code_a, b.code AS code_b, round(covar_samp(a.ret, b.ret), 7) + 0.0 AS covariance FROM k a JOIN k b ON a.date = b.date AND a.code <= b.code GROUP BY 1, 2""")
def covariance_matrix(spark, sf_dir):
    # small cells so that several blocks are multiplied
    return report(PF.covariance(nation_returns(spark, sf_dir), 4000), ["code_a", "code_b"], ["covariance"], 7)


_NW = "nw AS (SELECT code, sum(amount) / (SELECT sum(amount) FROM nr) AS weight FROM nr GROUP BY code)"


def nation_weights(r):
    total = r.agg(F.sum("amount").alias("_t"))
    return r.groupBy("code").agg(F.sum("amount").alias("_a")).crossJoin(F.broadcast(total)).select("code", (F.col("_a") / F.col("_t")).alias("weight"))


@query("portfolio_tail_risk", f"""WITH {NATION}, {_NW}, pr AS (SELECT date, sum(ret * weight) AS r FROM nr JOIN nw USING (code) WHERE ret IS NOT NULL GROUP BY date), q AS (SELECT quantile_cont(r, 0.05) AS v FROM pr)
SELECT round(v, 6) + 0.0 AS value_at_risk, round((SELECT avg(r) FROM pr WHERE r <= v), 6) + 0.0 AS cvar FROM q""")
def portfolio_tail_risk(spark, sf_dir):
    r = nation_returns(spark, sf_dir)
    return report(PF.portfolio_tail(PF.weighted_returns(r.where("ret is not null"), nation_weights(r))), [], ["value_at_risk", "cvar"])


@query("weight_constraints", f"WITH {NATION}, {_NW} SELECT max(weight) <= 0.1 AS max_single_weight, abs(sum(weight) - 1) < 0.001 AS weights_sum_one FROM nw")
def weight_constraints(spark, sf_dir):
    return RK.check_weights(nation_weights(nation_returns(spark, sf_dir)))


@query("industry_exposure", f"WITH {WEEKLY}, {_TGT}, {INDUSTRY} SELECT industry, round(sum(weight), 6) + 0.0 AS exposure FROM tw JOIN ind USING (code) GROUP BY 1")
def industry_exposure(spark, sf_dir):
    return report(PF.industry_exposure(targets(spark, sf_dir).select("code", "weight"), industries(spark, sf_dir)), ["industry"], ["exposure"])


_TW = f"""wts AS (SELECT r_name AS strategy_id, n_name AS code, date_trunc('week', l_shipdate)::DATE AS date, sum(l_extendedprice) AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
 ww AS (SELECT strategy_id, code, date, a / sum(a) OVER (PARTITION BY strategy_id, date) AS w FROM wts)"""


def region_weights(spark, sf_dir):
    """Weekly share of each nation in its region's amount; nations drop in and out."""
    li, su, na, re_ = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    geo = su.join(na.join(re_, na.n_regionkey == re_.r_regionkey), F.col("s_nationkey") == F.col("n_nationkey"))
    per = (li.groupBy("l_suppkey", F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(F.sum("l_extendedprice").alias("a"))
           .join(geo.select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias(KEY), F.col("n_name").alias("code")), "l_suppkey")
           .groupBy(KEY, "code", "date").agg(F.sum("a").alias("a")))
    total = per.groupBy(KEY, "date").agg(F.sum("a").alias("t"))
    return per.join(total, [KEY, "date"]).select(KEY, "code", "date", (F.col("a") / F.col("t")).alias("weight"))


@query("turnover_stats", f"""WITH {_TW}, g AS (SELECT s.strategy_id, s.code, d.date, coalesce(w, 0) AS w FROM (SELECT DISTINCT strategy_id, code FROM ww) s JOIN (SELECT DISTINCT strategy_id, date FROM ww) d ON s.strategy_id = d.strategy_id
 LEFT JOIN ww ON ww.strategy_id = s.strategy_id AND ww.code = s.code AND ww.date = d.date), m AS (SELECT strategy_id, date, abs(w - lag(w) OVER (PARTITION BY strategy_id, code ORDER BY date)) AS d FROM g),
 t AS (SELECT strategy_id, date, sum(d) / 2 AS t FROM m WHERE d IS NOT NULL GROUP BY 1, 2) SELECT strategy_id, round(avg(t), 6) + 0.0 AS avg_daily_turnover, round(avg(t) * 252, 4) + 0.0 AS annual_turnover FROM t GROUP BY 1""")
def turnover_stats(spark, sf_dir):
    return report(CU.turnover_stats(region_weights(spark, sf_dir)), [KEY], ["avg_daily_turnover", ("annual_turnover", 4)])


_TRD = """tr AS (SELECT l_returnflag AS strategy_id, l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS action,
 CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (l_discount - l_tax) END AS pnl, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS n FROM lineitem),
 t2 AS (SELECT *, lag(action) OVER w AS b, lag(date) OVER w AS d0 FROM tr WINDOW w AS (PARTITION BY strategy_id, code ORDER BY n))"""


@query("trade_stats", f"""WITH {_TRD} SELECT strategy_id, count(*) AS total_trades, count(*) FILTER (action = 'buy') AS buy_count, count(*) FILTER (action = 'sell') AS sell_count,
 round(count(*) FILTER (pnl > 0) / count(pnl), 6) + 0.0 AS win_rate, round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0), 6) + 0.0 AS profit_factor,
 round(avg(date - d0) FILTER (action = 'sell' AND b = 'buy'), 6) + 0.0 AS avg_holding_days FROM t2 GROUP BY 1""")
def trade_stats(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias(KEY), F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("seq"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("action"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"))
    t = t.withColumn("_blk", F.floor(F.col("seq.l_orderkey") / 65536))
    return report(CU.trade_stats(t, blocks=("date", "_blk")), [KEY, "total_trades", "buy_count", "sell_count"], ["win_rate", "profit_factor", "avg_holding_days"])


BRIN = f"""bw AS (SELECT s.r_name AS industry, date, sum(amount) AS a, sum(CASE WHEN code < 'NATION_2' THEN amount ELSE 0 END) AS pa, avg(ret) AS rb, avg(ret) FILTER (code < 'NATION_2') AS rp
 FROM nr JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) s ON s.n_name = nr.code WHERE ret IS NOT NULL GROUP BY 1, 2),
 bx AS (SELECT date, industry, pa / nullif(sum(pa) {D}, 0) AS wp, a / sum(a) {D} AS wb, rp, rb FROM bw), by_ AS (SELECT * FROM bx WHERE rp IS NOT NULL AND wp IS NOT NULL)"""


def brinson_rows(spark, sf_dir):
    """Portfolio: nations named below NATION_2; benchmark: all; industries are the regions."""
    na, re_ = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    geo = na.join(re_, na.n_regionkey == re_.r_regionkey).select(F.col("n_name").alias("code"), F.col("r_name").alias("industry"))
    mine = F.col("code") < "NATION_2"
    r = nation_returns(spark, sf_dir).where("ret is not null").join(geo, "code")
    per = r.groupBy("date", "industry").agg(F.sum("amount").alias("a"), F.sum(F.when(mine, F.col("amount")).otherwise(0.0)).alias("pa"),
                                            F.avg("ret").alias("rb"), F.avg(F.when(mine, F.col("ret"))).alias("rp"))
    total = per.groupBy("date").agg(F.sum("a").alias("ta"), F.sum("pa").alias("tp"))
    j = per.join(total, "date").where("rp is not null and tp > 0")
    return j.select("date", "industry", (F.col("pa") / F.col("tp")).alias("wp"), (F.col("a") / F.col("ta")).alias("wb"), "rp", "rb")


_BR = ["allocation", "selection", "interaction", "total_excess"]
_BRSQL = "br AS (SELECT date, sum((wp - wb) * {base}) AS allocation, sum(wb * (rp - rb)) AS selection, sum((wp - wb) * (rp - rb)) AS interaction, sum(wp * rp - wb * rb) AS direct FROM by_ JOIN (SELECT date, sum(wb * rb) AS tb FROM by_ GROUP BY date) USING (date) GROUP BY date), bs AS (SELECT *, allocation + selection + interaction AS total_excess FROM br)"


def _brinson_query(name, mode, base):
    @query(name, f"WITH {NATION}, {BRIN}, {_BRSQL.format(base=base)} SELECT CAST(date AS VARCHAR) AS date, abs(total_excess - direct) <= 1e-6 AS closes, {outs(_BR)} FROM bs")
    def run(spark, sf_dir):
        return report(PF.brinson(brinson_rows(spark, sf_dir), mode), ["date", "closes"], _BR)


_brinson_query("brinson_classic", "classic", "rb")
_brinson_query("brinson_fachler", "fachler", "(rb - tb)")
_BSUM = [f"{x}_cumulative" for x in _BR] + [f"{x}_mean" for x in _BR[:3]]


@query("brinson_summary", f"WITH {NATION}, {BRIN}, {_BRSQL.format(base='rb')} SELECT count(*) AS n_periods, " + ", ".join(
    [f"round(sum({x}), 6) + 0.0 AS {x}_cumulative" for x in _BR] + [f"round(avg({x}), 6) + 0.0 AS {x}_mean" for x in _BR[:3]]) + " FROM bs")
def brinson_summary(spark, sf_dir):
    return report(PF.brinson_summary(PF.brinson(brinson_rows(spark, sf_dir))), ["n_periods"], _BSUM)


# risk
_ORD = """od AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS ep, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_extendedprice / l_quantity AS price,
 CAST(l_quantity * CASE WHEN l_linenumber = 7 THEN 10 ELSE 100 END AS BIGINT) AS shares, CAST(l_quantity * 1000 AS BIGINT) AS held_shares, l_returnflag = 'R' AND l_linenumber = 1 AS is_limit_up,
 l_returnflag = 'A' AND l_linenumber = 2 AS is_limit_down, l_extendedprice / l_quantity * (1 + l_tax) AS vwap FROM lineitem)"""
ORDER_RULES = """ru AS (SELECT *, CASE WHEN NOT (price > 0 AND shares > 0) THEN 'invalid' WHEN shares % 100 <> 0 THEN 'lot_size' WHEN is_limit_up AND side = 'buy' THEN 'limit_up' WHEN is_limit_down AND side = 'sell' THEN 'limit_down'
 WHEN price * shares / 300000000 > 0.02 THEN 'amount_ratio' WHEN CASE WHEN side = 'buy' THEN (held_shares * price + price * shares) / (300000000 + price * shares) ELSE (held_shares * price - price * shares) / (300000000 - price * shares) END > 0.1 THEN 'single_weight'
 WHEN abs(price - vwap) / vwap > 0.05 THEN 'price_deviation' ELSE 'passed' END AS rule FROM od)"""


def orders(spark, sf_dir):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lot = F.when(F.col("l_linenumber") == 7, 10).otherwise(100)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("ep"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        price.alias("price"), (F.col("l_quantity") * lot).cast("long").alias("shares"), (F.col("l_quantity") * 1000).cast("long").alias("held_shares"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("is_limit_up"),
        ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 2)).alias("is_limit_down"), (price * (1 + F.col("l_tax"))).alias("vwap"))


@query("order_risk_rules", f"WITH {_ORD}, {ORDER_RULES} SELECT l_orderkey, l_linenumber, rule, round(ep, 2) + 0.0 AS ep, CASE WHEN rule = 'passed' THEN 'info' ELSE 'block' END AS level FROM ru")
def order_risk_rules(spark, sf_dir):
    return report(RK.check_orders(orders(spark, sf_dir), 3e8), ["l_orderkey", "l_linenumber", "rule", "level"], [("ep", 2)])


PRULES = f"""{_TGT}, {INDUSTRY}, pf AS (SELECT code, weight * 1.02 AS weight FROM tw), tt AS (SELECT code, 1.0 / count(*) OVER () AS w FROM tw),
 pa AS (SELECT (SELECT sum(abs(weight)) FROM pf) AS gross, (SELECT 1 - sum(weight) FROM pf) AS cash, (SELECT max(e) FROM (SELECT sum(weight) AS e FROM pf JOIN ind USING (code) GROUP BY industry)) AS top,
  (SELECT sum(abs(w - weight)) / 2 FROM pf JOIN tt USING (code)) AS turn),
 pd AS (SELECT 'portfolio.leverage' AS rule, 'block' AS level, gross AS value FROM pa WHERE gross > 1 + 1e-6 UNION ALL SELECT 'portfolio.cash_negative', 'block', cash FROM pa WHERE cash < -1e-6 UNION ALL
  SELECT 'portfolio.cash_buffer', 'warn', cash FROM pa WHERE cash < 0.05 UNION ALL SELECT 'portfolio.industry_concentration', 'block', top FROM pa WHERE top > 0.3 UNION ALL
  SELECT 'portfolio.turnover', 'warn', turn FROM pa WHERE turn > 0.5)"""


def portfolio_decisions(spark, sf_dir):
    t = targets(spark, sf_dir)
    heavy = t.select("code", (F.col("weight") * 1.02).alias("weight"))
    return RK.check_portfolio(heavy, PF.equal_weights(t.select("code")), industries(spark, sf_dir))


@query("portfolio_risk_rules", f"WITH {WEEKLY}, {PRULES} SELECT rule, level, false AS passed, round(value, 6) + 0.0 AS value FROM pd")
def portfolio_risk_rules(spark, sf_dir):
    return report(portfolio_decisions(spark, sf_dir), ["rule", "level", "passed"], ["value"])


BRK = f"""k1 AS (SELECT code, date, ret, CASE WHEN count(lr) {over(5)} >= 5 THEN exp(sum(lr) {over(5)}) - 1 END AS wk, sum(CASE WHEN ret < 0 THEN 0 ELSE 1 END) {over()} AS run FROM c2 WHERE ret IS NOT NULL),
 k2 AS (SELECT code, min(ret) AS wd, min(wk) AS ww FROM k1 GROUP BY code), k3 AS (SELECT code, max(n) AS ld FROM (SELECT code, run, count(*) AS n FROM k1 WHERE ret < 0 GROUP BY 1, 2) GROUP BY code),
 kd AS (SELECT code, 'circuit_breaker.daily_loss' AS rule, wd AS value FROM k2 WHERE wd < -0.03 UNION ALL SELECT code, 'circuit_breaker.weekly_loss', ww FROM k2 WHERE ww < -0.05 UNION ALL
  SELECT code, 'circuit_breaker.consecutive_loss', CAST(ld AS DOUBLE) FROM k3 WHERE ld >= 5)"""


@query("loss_breakers", f"WITH {WEEKLY}, {CURVE}, {BRK} SELECT code AS strategy_id, rule, 'block' AS level, false AS passed, round(value, 6) + 0.0 AS value FROM kd")
def loss_breakers(spark, sf_dir):
    return report(RK.loss_breakers(curves(spark, sf_dir)), [KEY, "rule", "level", "passed"], ["value"])


@query("risk_report", f"""WITH {WEEKLY}, {CURVE}, {BRK}, {PRULES}, {_ORD}, {ORDER_RULES}, al AS (SELECT 'block' AS level, false AS passed FROM kd UNION ALL SELECT level, false FROM pd UNION ALL SELECT CASE WHEN rule = 'passed' THEN 'info' ELSE 'block' END, rule = 'passed' FROM ru
 UNION ALL SELECT 'info', true) SELECT count(*) FILTER (NOT passed AND level = 'block') AS n_blocked, count(*) FILTER (NOT passed AND level = 'warn') AS n_warn, count(*) FILTER (passed) AS n_passed, true AS blocked FROM al""")
def risk_report(spark, sf_dir):
    health = RK.data_decisions(PT.data_health(weekly_bars(spark, sf_dir), "2001-10-31"))
    return RK.risk_report(RK.loss_breakers(curves(spark, sf_dir)), portfolio_decisions(spark, sf_dir), RK.check_orders(orders(spark, sf_dir), 3e8), health)


@query("portfolio_stop", f"""WITH {WEEKLY}, {CURVE} SELECT code AS strategy_id, CAST(date AS VARCHAR) AS date, round(ret, 6) + 0.0 AS daily_return, ret <= -0.02 AS triggered FROM c2 WHERE ret IS NOT NULL""")
def portfolio_stop(spark, sf_dir):
    navs = curves(spark, sf_dir).select(KEY, "date", F.col("equity").alias("current_nav"), R.lag("equity", 1, key=KEY).alias("start_nav")).where("start_nav is not null")
    return report(RK.portfolio_stop(navs), [KEY, "date", "triggered"], ["daily_return"])


@query("code_stops", f"""WITH {WEEKLY}, l AS (SELECT code, date, close, coalesce({lag('close', 19)}, first_value(close) {over()}) AS entry_price FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)
SELECT code, round(entry_price, 4) + 0.0 AS entry_price, round(close, 4) + 0.0 AS close, round((close - entry_price) / entry_price, 6) + 0.0 AS move, (close - entry_price) / entry_price <= -0.08 AS stop FROM l""")
def code_stops(spark, sf_dir):
    return report(RK.code_stops(weekly_bars(spark, sf_dir).select("code", "date", "close")), ["code", "stop"], [("entry_price", 4), ("close", 4), "move"])

"""Ledger analysis: lineitem rows as trades of the supplier's code."""

from pyspark.sql import functions as F

from ..operators import ledger as LG
from .factor_queries import out as outs
from .registry import query
from .tables import code_of, report, table


def trades(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    sell = c("l_linestatus") == "F"
    day = c("l_shipdate").cast("date")
    ident = F.concat_ws("-", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), "l_orderkey", "l_linenumber",
                        c("l_quantity").cast("long"), F.round(c("l_extendedprice") * 100).cast("long"))
    return li.select(
        ident.alias("execution_id"), day.alias("trade_date"), code_of("l_suppkey").alias("code"),
        F.when(sell, "sell").otherwise("buy").alias("side"), (c("l_quantity") * 100).cast("long").alias("shares"),
        (c("l_extendedprice") / c("l_quantity")).alias("price"), (c("l_extendedprice") * 0.025).alias("commission"),
        F.when(sell, c("l_extendedprice") * 0.1).otherwise(0.0).alias("stamp_tax"), (c("l_extendedprice") * c("l_tax")).alias("slippage_cost"),
        F.lit(0).cast("long").alias("position_after_shares"), (500000 - c("l_extendedprice")).alias("cash_after"),
        (1000000 + c("l_extendedprice")).alias("nav_after"), (c("l_discount") < 0.095).alias("confirmed"),
        c("l_shipdate").alias("created_at"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("seq"))


T = """tr AS (SELECT CAST(l_suppkey AS VARCHAR) || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || l_orderkey || '-' || l_linenumber || '-' || CAST(l_quantity AS BIGINT) || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS execution_id,
 CAST(l_shipdate AS DATE) AS trade_date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SH' AS code, CASE WHEN l_linestatus = 'F' THEN 'sell' ELSE 'buy' END AS side, CAST(l_quantity * 100 AS BIGINT) AS shares,
 l_extendedprice / l_quantity AS price, l_extendedprice * 0.025 AS commission, CASE WHEN l_linestatus = 'F' THEN l_extendedprice * 0.1 ELSE 0 END AS stamp_tax, l_extendedprice * l_tax AS slippage_cost,
 500000 - l_extendedprice AS cash_after, 1000000 + l_extendedprice AS nav_after, l_discount < 0.095 AS confirmed, l_orderkey * 8 + l_linenumber AS seq, l_orderkey, l_linenumber FROM lineitem)"""
RANGES = f"""{T}, r0 AS (SELECT *, CAST(sum(CASE WHEN side = 'buy' THEN shares ELSE 0 END) OVER w AS BIGINT) AS cb, CAST(sum(CASE WHEN side = 'sell' THEN shares ELSE 0 END) OVER w AS BIGINT) AS cs
  FROM tr WHERE confirmed WINDOW w AS (PARTITION BY code ORDER BY trade_date, seq, execution_id)),
 r1 AS (SELECT *, greatest(0, max(cs - cb) OVER w) AS ov FROM r0 WINDOW w AS (PARTITION BY code ORDER BY trade_date, seq, execution_id)),
 r2 AS (SELECT *, coalesce(lag(ov) OVER (PARTITION BY code ORDER BY trade_date, seq, execution_id), 0) AS ov0 FROM r1),
 rg AS (SELECT *, CASE WHEN side = 'buy' THEN cb ELSE cs - ov END AS hi, CASE WHEN side = 'buy' THEN cb - shares ELSE cs - shares - ov0 END AS lo, cb - (cs - ov) AS pos FROM r2)"""
TRIPS = f"""{RANGES}, seg AS (SELECT DISTINCT code, p FROM (SELECT code, lo AS p FROM rg WHERE hi > lo UNION ALL SELECT code, hi FROM rg WHERE hi > lo)), m AS (SELECT b.code, b.execution_id AS buy_id, s.execution_id AS sell_id, b.trade_date AS buy_date, s.trade_date AS sell_date, b.seq AS buy_seq, s.seq AS sell_seq, b.price AS buy_price, s.price AS sell_price,
  least(b.hi, s.hi) - greatest(b.lo, s.lo) AS shares, b.shares AS bs, s.shares AS ss, b.commission AS bc, s.commission AS sc, s.stamp_tax AS st, b.slippage_cost AS bl, s.slippage_cost AS sl
  FROM seg ASOF JOIN (SELECT * FROM rg WHERE side = 'buy' AND hi > lo) b ON seg.code = b.code AND seg.p >= b.lo ASOF JOIN (SELECT * FROM rg WHERE side = 'sell' AND hi > lo) s ON seg.code = s.code AND seg.p >= s.lo
  WHERE seg.p < b.hi AND seg.p < s.hi),
 m2 AS (SELECT *, (sell_price - buy_price) * shares AS gross_pnl, bc * shares / bs + sc * shares / ss AS commission, st * shares / ss AS stamp_tax, bl * shares / bs + sl * shares / ss AS slippage_cost FROM m),
 m3 AS (SELECT *, gross_pnl - commission - stamp_tax - slippage_cost AS net_pnl FROM m2),
 trips AS (SELECT *, net_pnl / (buy_price * shares) AS return_pct, CAST(greatest(sell_date - buy_date, 1) AS INTEGER) AS holding_days, net_pnl > 0 AS is_win FROM m3)"""
_COST = ["gross_pnl", "commission", "stamp_tax", "slippage_cost", "net_pnl"]


@query("ledger_round_trips", f"""WITH {TRIPS} SELECT code, buy_id, sell_id, CAST(buy_date AS VARCHAR) AS buy_date, CAST(sell_date AS VARCHAR) AS sell_date, CAST(shares AS BIGINT) AS shares, holding_days, is_win, {outs(_COST, 2)}, {outs(['return_pct'])} FROM trips""")
def ledger_round_trips(spark, sf_dir):
    # small blocks and buckets, so that the cuts are exercised
    t = LG.round_trips(trades(spark, sf_dir), 4096, 20000)
    return report(t, ["code", "buy_id", "sell_id", "buy_date", "sell_date", "shares", "holding_days", "is_win"], [(x, 2) for x in _COST] + ["return_pct"])


_TS = ["total_commission", "total_stamp_tax", "total_slippage", "total_cost"]


@query("ledger_transaction_stats", f"""WITH {T}, z AS (SELECT count(*) AS total_trades, count(*) FILTER (side = 'buy') AS total_buys, count(*) FILTER (side = 'sell') AS total_sells, sum(commission) AS total_commission, sum(stamp_tax) AS total_stamp_tax,
 sum(slippage_cost) AS total_slippage, count(DISTINCT code) AS unique_stocks, sum(commission) + sum(stamp_tax) + sum(slippage_cost) AS total_cost FROM tr) SELECT total_trades, total_buys, total_sells, unique_stocks, {outs(_TS, 2)} FROM z""")
def ledger_transaction_stats(spark, sf_dir):
    return report(LG.transaction_stats(trades(spark, sf_dir)), ["total_trades", "total_buys", "total_sells", "unique_stocks"], _TS, 2)


_RS = ["win_rate", "avg_return_pct", "profit_factor", "avg_holding_days"]


@query("ledger_round_trip_stats", f"""WITH {TRIPS}, z AS (SELECT count(*) AS total_round_trips, count(*) FILTER (is_win) AS win_count, count(*) FILTER (NOT is_win) AS loss_count, sum(net_pnl) AS total_net_pnl, avg(return_pct) * 100 AS avg_return_pct,
 avg(net_pnl) FILTER (is_win) AS avg_win, avg(net_pnl) FILTER (NOT is_win) AS avg_loss, sum(net_pnl) FILTER (is_win) / abs(sum(net_pnl) FILTER (NOT is_win)) AS profit_factor, avg(holding_days) AS avg_holding_days,
 count(*) FILTER (is_win) / count(*) AS win_rate FROM trips) SELECT total_round_trips, win_count, loss_count, {outs(_RS, 5)}, {outs(['total_net_pnl', 'avg_win', 'avg_loss'], 1)} FROM z""")
def ledger_round_trip_stats(spark, sf_dir):
    s = LG.round_trip_stats(LG.round_trips(trades(spark, sf_dir)))
    return report(s, ["total_round_trips", "win_count", "loss_count"], [(x, 5) for x in _RS] + [(x, 1) for x in ("total_net_pnl", "avg_win", "avg_loss")])


@query("ledger_pnl_by_code", f"""WITH {TRIPS}, z AS (SELECT code, sum(net_pnl) AS total_pnl, count(*) AS trade_count, count(*) FILTER (is_win) AS win_count, avg(return_pct) * 100 AS avg_return_pct, count(*) FILTER (is_win) / count(*) * 100 AS win_rate
 FROM trips GROUP BY code) SELECT code, trade_count, win_count, {outs(['total_pnl'], 1)}, {outs(['avg_return_pct', 'win_rate'], 5)} FROM z""")
def ledger_pnl_by_code(spark, sf_dir):
    p = LG.pnl_by_code(LG.round_trips(trades(spark, sf_dir)))
    return report(p, ["code", "trade_count", "win_count"], [("total_pnl", 1), ("avg_return_pct", 5), ("win_rate", 5)])


@query("ledger_execution_quality", f"""WITH {T}, z AS (SELECT sum(price * shares) AS total_turnover, sum(commission) + sum(stamp_tax) + sum(slippage_cost) AS total_cost, avg(price * shares) AS avg_trade_size, max(price * shares) AS max_trade_size,
 (sum(commission) + sum(stamp_tax) + sum(slippage_cost)) / sum(price * shares) * 10000 AS cost_ratio_bps, sum(slippage_cost) / sum(price * shares) * 10000 AS slippage_ratio_bps FROM tr)
SELECT {outs(['total_turnover'], 0)}, {outs(['total_cost', 'avg_trade_size', 'max_trade_size'], 2)}, {outs(['cost_ratio_bps', 'slippage_ratio_bps'])} FROM z""")
def ledger_execution_quality(spark, sf_dir):
    q = LG.execution_quality(trades(spark, sf_dir))
    return report(q, [], [("total_turnover", 0), ("total_cost", 2), ("avg_trade_size", 2), ("max_trade_size", 2), "cost_ratio_bps", "slippage_ratio_bps"])


NAV = f"{T}, nav AS (SELECT trade_date AS date, arg_max(nav_after, (seq, execution_id)) AS nav FROM tr GROUP BY 1)"


@query("ledger_nav_series", f"WITH {NAV} SELECT CAST(date AS VARCHAR) AS date, round(nav, 2) + 0.0 AS nav FROM nav")
def ledger_nav_series(spark, sf_dir):
    return report(LG.nav_series(trades(spark, sf_dir)), ["date"], [("nav", 2)])


PERIODS = {"1997 crisis": ("1997-07-02", "1998-01-12"), "1998 default": ("1998-08-17", "1998-10-08"), "2000 burst": ("2000-03-10", "2000-12-20"), "outside": ("2015-06-12", "2015-08-26")}


@query("ledger_stress_periods", f"""WITH {NAV}, p(period, a, b) AS (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, (a, b) in PERIODS.items())}),
 x AS (SELECT period, date, nav, nav / max(nav) OVER (PARTITION BY period ORDER BY date) - 1 AS dd FROM nav JOIN p ON date BETWEEN a AND b)
SELECT period, round((arg_max(nav, date) / arg_min(nav, date) - 1) * 100, 6) + 0.0 AS return_pct, round(min(dd) * 100, 6) + 0.0 AS max_drawdown_pct FROM x GROUP BY period HAVING count(*) >= 2""")
def ledger_stress_periods(spark, sf_dir):
    return report(LG.stress_performance(LG.nav_series(trades(spark, sf_dir)), PERIODS), ["period"], ["return_pct", "max_drawdown_pct"])


@query("ledger_streaks", f"""WITH {TRIPS}, fo AS (SELECT code, min((sell_date, sell_seq, code)) AS f FROM trips GROUP BY code),
 o AS (SELECT is_win, row_number() OVER (ORDER BY f, sell_date, sell_seq, sell_id, buy_date, buy_seq, buy_id) AS n FROM trips JOIN fo USING (code)),
 g AS (SELECT is_win, n - row_number() OVER (PARTITION BY is_win ORDER BY n) AS k FROM o), c AS (SELECT is_win, k, count(*) AS n FROM g GROUP BY 1, 2)
SELECT max(n) FILTER (is_win) AS max_win_streak, max(n) FILTER (NOT is_win) AS max_loss_streak FROM c""")
def ledger_streaks(spark, sf_dir):
    return LG.streaks(LG.round_trips(trades(spark, sf_dir)), 4096)


_POS = f"""WITH RECURSIVE {RANGES}, od AS (SELECT *, CASE WHEN side = 'sell' THEN greatest(hi - lo, 0) END AS mv, row_number() OVER (PARTITION BY code ORDER BY trade_date, seq, execution_id) AS k FROM rg),
 st AS (SELECT code, k, CASE WHEN side = 'buy' THEN price * shares ELSE 0.0 END AS v, pos FROM od WHERE k = 1 UNION ALL
  SELECT od.code, od.k, CASE WHEN side = 'buy' THEN st.v + price * shares WHEN st.pos > 0 THEN st.v * (1 - mv / st.pos) ELSE st.v END, od.pos FROM st JOIN od ON od.code = st.code AND od.k = st.k + 1),
 ls AS (SELECT code, v, pos FROM st QUALIFY row_number() OVER (PARTITION BY code ORDER BY k DESC) = 1),
 fr AS (SELECT code, sum(shares) AS f FROM rg WHERE side = 'buy' AND trade_date = (SELECT max(trade_date) FROM tr) GROUP BY code)
SELECT code, CAST(pos AS BIGINT) AS shares, CAST(greatest(pos - coalesce(f, 0), 0) AS BIGINT) AS available, round(v / pos, 4) + 0.0 AS avg_cost FROM ls LEFT JOIN fr USING (code) WHERE pos > 0"""


@query("ledger_positions", _POS)
def ledger_positions(spark, sf_dir):
    return report(LG.positions(trades(spark, sf_dir), 4096), ["code", "shares", "available"], [("avg_cost", 4)])


@query("ledger_account_totals", f"""WITH {T} SELECT round(arg_max(cash_after, (trade_date, seq, execution_id)), 2) + 0.0 AS cash, round(arg_max(nav_after, (trade_date, seq, execution_id)), 2) + 0.0 AS nav, CAST(max(trade_date) AS VARCHAR) AS last_trade_date FROM tr""")
def ledger_account_totals(spark, sf_dir):
    return report(LG.account_totals(trades(spark, sf_dir)), ["last_trade_date"], ["cash", "nav"], 2)


@query("ledger_settlement_violations", f"""WITH {RANGES}, v AS (SELECT *, sum(CASE WHEN side = 'buy' THEN shares ELSE 0 END) OVER (PARTITION BY code, trade_date ORDER BY seq, execution_id) AS td FROM rg),
 w AS (SELECT *, greatest(pos + greatest(hi - lo, 0) - td, 0) AS free FROM v WHERE side = 'sell')
SELECT execution_id, code, CAST(trade_date AS VARCHAR) AS trade_date, shares, CAST(free AS BIGINT) AS available_before,
 concat_ws(',', CASE WHEN td > 0 THEN 'bought_same_day' END, CASE WHEN shares > free THEN 'above_available' END) AS violations FROM w WHERE td > 0 OR shares > free""")
def ledger_settlement_violations(spark, sf_dir):
    v = LG.settlement_violations(trades(spark, sf_dir), 4096).withColumn("violations", F.concat_ws(",", "violations"))
    return report(v, ["execution_id", "code", "trade_date", "shares", "available_before", "violations"], [])


# raw records with every kind of defect, chosen by key
_BAD = """bad AS (SELECT execution_id, CASE WHEN l_orderkey % 11 = 0 THEN replace(code, '.SH', '.XX') ELSE code END AS code, CASE WHEN l_orderkey % 13 = 0 THEN 'hold' ELSE side END AS side, shares + CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END AS shares,
 CASE WHEN l_orderkey % 19 = 0 THEN -price ELSE price END AS price, commission - CASE WHEN l_orderkey % 23 = 0 THEN 1000000 ELSE 0 END AS commission, confirmed, trade_date, seq, l_orderkey FROM tr),
 viol AS (SELECT *, concat_ws(',', CASE WHEN l_orderkey % 11 = 0 THEN 'code' END, CASE WHEN side = 'hold' THEN 'side' END, CASE WHEN shares % 100 <> 0 THEN 'shares' END, CASE WHEN price <= 0 THEN 'price' END, CASE WHEN commission < 0 THEN 'fees' END,
 CASE WHEN NOT confirmed THEN 'confirmed' END) AS violations FROM bad)"""


def flawed(spark, sf_dir):
    t = trades(spark, sf_dir)
    key = F.floor(F.col("seq") / 8)   # the order key
    every = lambda n: key % n == 0
    return t.withColumns({
        "code": F.when(every(11), F.replace("code", F.lit(".SH"), F.lit(".XX"))).otherwise(F.col("code")),
        "side": F.when(every(13), F.lit("hold")).otherwise(F.col("side")), "shares": F.col("shares") + F.when(every(17), 1).otherwise(0),
        "price": F.when(every(19), -F.col("price")).otherwise(F.col("price")), "commission": F.col("commission") - F.when(every(23), 1e6).otherwise(0.0)})


@query("ledger_validation", f"WITH {T}, {_BAD} SELECT execution_id, violations FROM viol WHERE violations <> ''")
def ledger_validation(spark, sf_dir):
    _, bad = LG.split_valid(flawed(spark, sf_dir))
    return bad.select("execution_id", F.concat_ws(",", "violations").alias("violations"))


@query("ledger_append", f"""WITH {T}, {_BAD} SELECT execution_id, CAST(trade_date AS VARCHAR) AS trade_date FROM viol WHERE violations = '' AND trade_date >= DATE '2000-01-01' AND execution_id NOT IN (SELECT execution_id FROM tr WHERE trade_date < DATE '2000-07-01')""")
def ledger_append(spark, sf_dir):
    batch = flawed(spark, sf_dir).where("trade_date >= date'2000-01-01'")
    history = trades(spark, sf_dir).where("trade_date < date'2000-07-01'")
    return report(LG.new_records(batch, history), ["execution_id", "trade_date"], [])


@query("ledger_json_scan", f"""WITH {T} SELECT CASE WHEN l_orderkey % 29 = 0 THEN 'bad' ELSE side END AS kind, count(*) AS n, CAST(sum(CASE WHEN l_orderkey % 29 = 0 THEN 0 ELSE shares END) AS BIGINT) AS shares FROM tr GROUP BY 1""")
def ledger_json_scan(spark, sf_dir):
    t = trades(spark, sf_dir)
    text = F.to_json(F.struct(*[c for c in t.columns if c != "seq"]))
    lines = t.select(F.when(F.floor(F.col("seq") / 8) % 29 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"))
    good, bad = LG.parse_lines(lines)
    rows = good.select(F.col("side").alias("kind"), "shares").unionByName(bad.select(F.lit("bad").alias("kind"), F.lit(0).cast("long").alias("shares")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))

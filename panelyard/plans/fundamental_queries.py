"""As-of joins, quality checks, valuation and industry comparison.

Quarterly reports are lineitem sums by supplier and quarter, public 45 days after the
quarter; a quarter whose line count divides by seven has no disclosure date.
"""

from pyspark.sql import functions as F, Window

from ..functions.columns import exact_sum
from ..operators import cleaning as C, fundamentals as FU, pit as PT
from .factor_queries import over, roll
from .registry import query
from .tables import INDUSTRY, WEEKLY, code_of, industries, line_order, report, table, weekly_bars, weekly_splits

FIELDS = ["roe", "roa", "gross_margin", "net_margin", "revenue_growth", "profit_growth", "debt_ratio", "current_ratio",
          "quick_ratio", "ocf", "pe_ttm", "pb", "ps_ttm", "dv_ratio"]


def reports(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    end = F.last_day(F.add_months(F.date_trunc("quarter", day).cast("date"), 2))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    q = li.groupBy(F.col("l_suppkey").alias("code"), end.alias("report_date")).agg(
        exact_sum("l_extendedprice").alias("rev"), F.sum("l_quantity").alias("qty"),
        exact_sum(F.col("l_extendedprice") * F.col("l_discount")).alias("disc"),
        exact_sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"), F.count(F.lit(1)).alias("n"),
        F.max_by(price, line_order(li)).alias("p"))
    q = q.withColumn("code", code_of("code")).withColumn("net", F.col("tax") - 0.6 * F.col("disc"))
    w = Window.partitionBy("code").orderBy("report_date")
    c = F.col
    zero = lambda x: F.nullif(x, F.lit(0.0))
    return q.select(
        "code", "report_date", F.when(c("n") % 7 != 0, F.date_add("report_date", 45)).alias("disclosure_date"),
        (1000 * c("net") / c("rev")).alias("roe"), (400 * c("net") / c("rev")).alias("roa"),
        (100 * (1 - 4 * c("disc") / c("rev"))).alias("gross_margin"), (100 * c("net") / c("rev")).alias("net_margin"),
        (100 * (c("rev") / F.lag("rev", 4).over(w) - 1)).alias("revenue_growth"),
        (100 * (c("net") - F.lag("net", 4).over(w)) / zero(F.abs(F.lag("net", 4).over(w)))).alias("profit_growth"),
        (100 * c("disc") / zero(c("disc") + c("tax"))).alias("debt_ratio"), (c("tax") / zero(c("disc"))).alias("current_ratio"),
        (0.8 * c("tax") / zero(c("disc"))).alias("quick_ratio"), (0.9 * c("net")).alias("ocf"),
        (c("p") * c("qty") / zero(10 * c("net"))).alias("pe_ttm"), (c("p") * c("qty") / c("rev")).alias("pb"),
        (c("p") * c("qty") / (c("rev") + c("tax"))).alias("ps_ttm"), (100 * c("disc") / c("rev")).alias("dv_ratio"))


REPORTS = """q0 AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SH' AS code,
 CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date, sum(l_extendedprice) AS rev, sum(l_quantity) AS qty,
 sum(l_extendedprice * l_discount) AS disc, sum(l_extendedprice * l_tax) AS tax, count(*) AS n,
 arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS p FROM lineitem GROUP BY 1, 2),
 q1 AS (SELECT *, tax - 0.6 * disc AS net FROM q0),
 fin AS (SELECT code, report_date, CASE WHEN n % 7 <> 0 THEN report_date + 45 END AS disclosure_date, 1000 * net / rev AS roe, 400 * net / rev AS roa,
 100 * (1 - 4 * disc / rev) AS gross_margin, 100 * net / rev AS net_margin, 100 * (rev / lag(rev, 4) OVER w - 1) AS revenue_growth,
 100 * (net - lag(net, 4) OVER w) / nullif(abs(lag(net, 4) OVER w), 0) AS profit_growth, 100 * disc / nullif(disc + tax, 0) AS debt_ratio,
 tax / nullif(disc, 0) AS current_ratio, 0.8 * tax / nullif(disc, 0) AS quick_ratio, 0.9 * net AS ocf, p * qty / nullif(10 * net, 0) AS pe_ttm,
 p * qty / rev AS pb, p * qty / (rev + tax) AS ps_ttm, 100 * disc / rev AS dv_ratio FROM q1 WINDOW w AS (PARTITION BY code ORDER BY report_date))"""


def r4(names, places=4):
    return ", ".join(f"round({n}, {places}) + 0.0 AS {n}" for n in names)


@query("quarterly_reports", f"WITH {REPORTS} SELECT code, CAST(report_date AS VARCHAR) AS report_date, CAST(disclosure_date AS VARCHAR) AS disclosure_date, {r4(FIELDS, 3)} FROM fin")
def quarterly_reports(spark, sf_dir):
    return report(reports(spark, sf_dir), ["code", "report_date", "disclosure_date"], FIELDS, 3)


ASOF = "1999-06-30"


@query("pit_filter", f"WITH {REPORTS} SELECT code, CAST(report_date AS VARCHAR) AS report_date, {r4(['roe'])} FROM fin WHERE disclosure_date <= DATE '{ASOF}'")
def pit_filter(spark, sf_dir):
    return report(PT.pit_filter(reports(spark, sf_dir), ASOF), ["code", "report_date"], ["roe"], 4)


@query("pit_violations", f"""WITH {REPORTS} SELECT code, CAST(report_date AS VARCHAR) AS report_date, CAST(disclosure_date - DATE '{ASOF}' AS INTEGER) AS days_ahead
 FROM fin WHERE disclosure_date > DATE '{ASOF}'""")
def pit_violations(spark, sf_dir):
    return report(PT.pit_violations(reports(spark, sf_dir), ASOF), ["code", "report_date", "days_ahead"], [])


@query("pit_guard_counts", f"""WITH {REPORTS} SELECT 'factors' AS caller, count(*) AS before, count(*) FILTER (disclosure_date <= DATE '{ASOF}') AS after FROM fin""")
def pit_guard_counts(spark, sf_dir):
    return PT.guard_counts(reports(spark, sf_dir), ASOF, "factors")


_FF = {**FU.FINANCIAL_FACTORS, **FU.VALUATION_FACTORS}
ASOF_SQL = """best AS (SELECT b.code, b.date, arg_max(f, f.report_date) AS f FROM bars b LEFT JOIN fin f ON f.code = b.code AND f.disclosure_date <= b.date GROUP BY 1, 2)"""


@query("factors_financial_asof", f"""WITH {WEEKLY}, {REPORTS}, {ASOF_SQL} SELECT code, CAST(date AS VARCHAR) AS date, CAST(f.report_date AS VARCHAR) AS report_period,
 {', '.join(f'round(f.{src}, 3) + 0.0 AS {out}' for out, src in _FF.items())} FROM best""")
def factors_financial_asof(spark, sf_dir):
    panel = weekly_bars(spark, sf_dir).select("code", "date")
    return report(FU.financial_factors(panel, reports(spark, sf_dir)), ["code", "date", "report_period"], list(_FF), 3)


@query("factor_delayed_quarterly", f"""WITH {WEEKLY}, {REPORTS}, best AS (SELECT b.code, b.date, arg_max(f, f.report_date) AS f FROM bars b
 LEFT JOIN fin f ON f.code = b.code AND f.disclosure_date + 1 <= b.date GROUP BY 1, 2)
SELECT code, CAST(date AS VARCHAR) AS date, round(f.profit_growth, 3) + 0.0 AS earnings_surprise_q FROM best""")
def factor_delayed_quarterly(spark, sf_dir):
    panel, facts = weekly_bars(spark, sf_dir).select("code", "date"), reports(spark, sf_dir)
    shown = F.date_add(PT.announce_date(facts, "disclosure_date"), 1)
    return report(PT.asof_join(panel, facts, {"earnings_surprise_q": "profit_growth"}, shown), ["code", "date"], ["earnings_surprise_q"], 3)


@query("factors_valuation_percentile", f"""WITH {WEEKLY}, {REPORTS}, {ASOF_SQL}, v AS (SELECT code, date, f.pe_ttm AS pe, f.pb AS pb FROM best),
 l AS (SELECT *, list(pe) FILTER (pe IS NOT NULL) {over()} AS ps, list(pb) FILTER (pb IS NOT NULL) {over()} AS bs FROM v)
SELECT code, CAST(date AS VARCHAR) AS date, {', '.join(f'''round(CASE WHEN {x} IS NOT NULL THEN (len(list_filter({l}, lambda v: v < {x})) +
 (len(list_filter({l}, lambda v: v = {x})) + 1) / 2.0) / len({l}) END, 6) + 0.0 AS {o}''' for x, l, o in (('pe', 'ps', 'pe_percentile'), ('pb', 'bs', 'pb_percentile')))} FROM l""")
def factors_valuation_percentile(spark, sf_dir):
    panel = weekly_bars(spark, sf_dir).select("code", "date")
    out = FU.valuation_percentile_factors(panel, reports(spark, sf_dir))
    return report(out, ["code", "date"], ["pe_percentile", "pb_percentile"])


DATES = ["1997-03-31", "1998-09-30", "2000-12-29"]


@query("asof_snapshots", f"""WITH {REPORTS}, g AS (SELECT code, ad FROM (SELECT DISTINCT code FROM fin), (SELECT unnest([{', '.join(f"DATE '{d}'" for d in DATES)}]) AS ad)),
 best AS (SELECT g.code, g.ad, arg_max(f, f.report_date) AS f FROM g LEFT JOIN fin f ON f.code = g.code AND f.report_date + 60 <= g.ad GROUP BY 1, 2)
SELECT code, CAST(ad AS VARCHAR) AS asof_date, CAST(f.report_date AS VARCHAR) AS report_period, round(f.roe, 3) + 0.0 AS roe FROM best""")
def asof_snapshots(spark, sf_dir):
    facts = reports(spark, sf_dir)
    shown = PT.announce_date(facts, None, 60)   # no announcement column: period plus a fixed delay
    return report(PT.asof_snapshot(facts, ["roe"], DATES, shown), ["code", "asof_date", "report_period"], ["roe"], 3)


@query("factors_capital_flow", f"""WITH {WEEKLY}, fl AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SH' AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
 sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_extendedprice END) AS main_net_inflow,
 sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) AS north_net_inflow FROM lineitem GROUP BY 1, 2),
 f5 AS (SELECT *, {roll('avg', 'main_net_inflow', 5, 1)} AS main_net_inflow_5d FROM fl)
SELECT code, CAST(date AS VARCHAR) AS date, {r4(['main_net_inflow', 'main_net_inflow_5d', 'north_net_inflow'], 2)} FROM bars LEFT JOIN f5 USING (code, date)""")
def factors_capital_flow(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flows = li.groupBy(code_of("l_suppkey").alias("code"), F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))).alias("main_net_inflow"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).otherwise(0.0)).alias("north_net_inflow"))
    panel = weekly_bars(spark, sf_dir).select("code", "date")
    return report(FU.capital_flow_factors(panel, flows), ["code", "date"], ["main_net_inflow", "main_net_inflow_5d", "north_net_inflow"], 2)


@query("factors_events", f"""WITH {WEEKLY}, e AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SH' AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
 count(*) FILTER (l_quantity >= 49 AND l_returnflag = 'R') AS c, sum(CASE WHEN l_quantity < 49 THEN 0 WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_extendedprice END) AS b,
 CAST(sum(CASE WHEN l_quantity > 2 THEN 0 WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN -1 ELSE 0 END) AS BIGINT) AS ch, sum(l_discount) AS co FROM lineitem GROUP BY 1, 2)
SELECT bars.code, CAST(bars.date AS VARCHAR) AS date, CAST(sum(c) OVER w AS BIGINT) AS lhb_count_5d, round(sum(b) OVER w, 2) + 0.0 AS lhb_net_buy, ch AS top_holder_change,
 round(co, 4) + 0.0 AS holder_concentration FROM bars JOIN e ON bars.code = e.code AND bars.date = e.date WINDOW w AS (PARTITION BY bars.code ORDER BY bars.date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def factors_events(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"code": code_of("l_suppkey"), "date": F.date_trunc("week", "l_shipdate").cast("date")})
    signed = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))
    large, small = F.col("l_quantity") >= 49, F.col("l_quantity") <= 2
    top = li.select("code", "date", (large & (F.col("l_returnflag") == "R")).alias("has_data"), F.when(large, signed).otherwise(0.0).alias("net_buy"))
    holders = li.select("code", "date", F.when(small & (F.col("l_returnflag") == "R"), "增持").when(
        small & (F.col("l_returnflag") == "A"), "减持").otherwise("不变").alias("change_type"), F.col("l_discount").alias("hold_ratio"))
    panel = weekly_bars(spark, sf_dir).select("code", "date")
    out = FU.holder_factors(FU.top_list_factors(panel, top), holders)
    return report(out, ["code", "date", "lhb_count_5d", "top_holder_change"], [("lhb_net_buy", 2), ("holder_concentration", 4)])


GATE_DAY = "2001-11-12"


@query("quality_gate", f"""WITH {WEEKLY}, {REPORTS}, x AS (SELECT CAST(greatest(DATE '{GATE_DAY}' - max(date), 0) AS INTEGER) AS freshness_days FROM bars),
 w AS (SELECT count(*) AS pit_warnings FROM fin WHERE disclosure_date > DATE '{GATE_DAY}')
SELECT '' AS missing_core, 'shareholder' AS missing_optional, freshness_days, pit_warnings, CASE WHEN freshness_days > 10 THEN 'abort' WHEN freshness_days > 5 OR pit_warnings > 0 THEN 'degraded' ELSE 'normal' END AS mode,
 CASE WHEN freshness_days > 10 THEN 'data too old' WHEN freshness_days > 5 THEN 'data ageing' WHEN pit_warnings > 0 THEN 'undisclosed rows' ELSE 'all checks passed' END AS reason FROM x, w""")
def quality_gate(spark, sf_dir):
    facts = reports(spark, sf_dir)
    verdict = PT.quality_gate({"daily": weekly_bars(spark, sf_dir), "financial": facts, "shareholder": None}, GATE_DAY,
                              PT.pit_violations(facts, GATE_DAY), core=("daily", "financial"), dates={"financial": "report_date"})
    return verdict.withColumns({c: F.concat_ws(",", c) for c in ("missing_core", "missing_optional")})


@query("data_health", f"""WITH {WEEKLY}, x AS (SELECT *, CASE WHEN volume < 10 THEN NULL ELSE close END AS c2 FROM bars)
SELECT CAST(DATE '{GATE_DAY}' - max(date) AS INTEGER) AS age_days, count(*) FILTER (c2 IS NULL) AS bad_close, count(*) FILTER (open IS NULL) AS bad_open,
 count(*) FILTER (volume IS NULL) AS bad_volume, DATE '{GATE_DAY}' - max(date) > 5 AS stale, count(*) FILTER (c2 IS NULL) = 0 AS finite FROM x""")
def data_health(spark, sf_dir):
    # thin weeks stand for broken prices: NaN in one column
    bars = weekly_bars(spark, sf_dir).withColumn("close", F.when(F.col("volume") < 10, F.lit(float("nan"))).otherwise(F.col("close")))
    return PT.data_health(bars, GATE_DAY, ("open", "close", "volume"))


@query("pit_coverage", f"""WITH {WEEKLY}, {REPORTS}, {ASOF_SQL}, v AS (SELECT date, f.roe AS roe, f.revenue_growth AS revenue_growth FROM best)
SELECT 'roe' AS factor, 45 AS declared_delay, round(avg(CASE WHEN roe IS NOT NULL THEN 1.0 ELSE 0 END), 6) + 0.0 AS coverage,
 CAST(min(date) FILTER (roe IS NOT NULL) - min(date) AS INTEGER) AS observed_lag_days, min(date) FILTER (roe IS NOT NULL) - min(date) >= 45 AS is_consistent FROM v
UNION ALL SELECT 'revenue_growth', 500, round(avg(CASE WHEN revenue_growth IS NOT NULL THEN 1.0 ELSE 0 END), 6) + 0.0,
 CAST(min(date) FILTER (revenue_growth IS NOT NULL) - min(date) AS INTEGER), min(date) FILTER (revenue_growth IS NOT NULL) - min(date) >= 500 FROM v""")
def pit_coverage(spark, sf_dir):
    facts = reports(spark, sf_dir)
    joined = PT.asof_join(weekly_bars(spark, sf_dir).select("code", "date"), facts, ["roe", "revenue_growth"], PT.announce_date(facts, "disclosure_date"))
    return report(PT.coverage_report(joined, {"roe": 45, "revenue_growth": 500}), ["factor", "declared_delay", "observed_lag_days", "is_consistent"], ["coverage"])


@query("pit_early_codes", f"WITH {WEEKLY} SELECT code, CAST(min(date) AS VARCHAR) AS first_date FROM bars WHERE volume > 60 GROUP BY code HAVING min(date) < DATE '1995-06-30' - 60")
def pit_early_codes(spark, sf_dir):
    heavy = weekly_bars(spark, sf_dir).select("code", "date", F.when(F.col("volume") > 60, F.col("volume")).alias("heavy"))
    return report(PT.early_codes(heavy, "heavy", "1995-06-30"), ["code", "first_date"], [])


@query("split_leak_check", f"""WITH {WEEKLY}, a AS (SELECT * FROM bars WHERE date < DATE '1999-01-01'), b AS (SELECT * FROM bars WHERE date >= DATE '1999-01-10')
SELECT CAST((SELECT min(date) FROM b) - (SELECT max(date) FROM a) AS INTEGER) AS gap_days, (SELECT count(DISTINCT a.date) FROM a JOIN b USING (date)) AS shared_dates, 'short_gap' AS issues""")
def split_leak_check(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("date")
    out = PT.split_leaks(bars.where("date < date'1999-01-01'"), bars.where("date >= date'1999-01-10'"), 30)
    return out.select("gap_days", "shared_dates", F.concat_ws(",", "issues").alias("issues"))


_VAL = """vh AS (SELECT code, report_date AS date, unnest(['pe_ttm', 'pb', 'ps_ttm', 'dv_ratio']) AS metric, unnest([pe_ttm, pb, ps_ttm, dv_ratio]) AS value FROM fin),
 vk AS (SELECT *, max(date) OVER w AS ref, arg_max(value, date) OVER w AS now FROM vh WHERE value IS NOT NULL AND (metric = 'dv_ratio' OR value > 0) WINDOW w AS (PARTITION BY code, metric)),
 vp AS (SELECT code, metric, min(now) AS current_value, (count(*) FILTER (value < now) + 0.5 * count(*) FILTER (value = now)) / count(*) * 100 AS percentile,
  median(value) AS median, max(value) AS max, min(value) AS min, count(*) AS samples FROM vk WHERE date >= ref - INTERVAL 60 MONTH GROUP BY 1, 2)"""
_PCT_COLS = ["current_value", "percentile", "median", "max", "min"]


def valuation(spark, sf_dir, known=None):
    known = reports(spark, sf_dir) if known is None else known
    return FU.valuation_percentiles(known.withColumnRenamed("report_date", "date"))


@query("valuation_percentile", f"""WITH {REPORTS}, {_VAL} SELECT code, metric, samples, CASE WHEN percentile < 25 THEN 'low' WHEN percentile <= 75 THEN 'fair' ELSE 'high' END AS verdict,
 {r4(_PCT_COLS)} FROM vp""")
def valuation_percentile(spark, sf_dir):
    return report(valuation(spark, sf_dir), ["code", "metric", "samples", "verdict"], _PCT_COLS, 4)


@query("valuation_ranked", f"WITH {REPORTS}, {_VAL} SELECT code, {r4(['percentile'])} FROM vp WHERE metric = 'pe_ttm' ORDER BY percentile NULLS LAST, code")
def valuation_ranked(spark, sf_dir):
    pe = FU.valuation_percentiles(reports(spark, sf_dir).withColumnRenamed("report_date", "date"), ["pe_ttm"])
    return report(pe.orderBy(F.col("percentile").asc_nulls_last(), "code"), ["code"], ["percentile"], 4)


@query("valuation_score", f"""WITH {REPORTS}, {_VAL}, s AS (SELECT code, avg(CASE WHEN metric = 'dv_ratio' THEN percentile ELSE 100 - percentile END) AS score FROM vp GROUP BY code)
SELECT code, CASE WHEN score >= 75 THEN 'cheap' WHEN score >= 50 THEN 'fairly_cheap' WHEN score >= 25 THEN 'fairly_rich' ELSE 'rich' END AS verdict, {r4(['score'])} FROM s""")
def valuation_score(spark, sf_dir):
    return report(FU.valuation_score(valuation(spark, sf_dir)), ["code", "verdict"], ["score"], 4)


_HIGH = ", ".join(f"'{m}'" for m, (h, _) in FU.METRICS.items() if h)
_VALM = ", ".join(f"'{m}'" for m, (_, c) in FU.METRICS.items() if c == "valuation")
RANKING = f"""snap AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY code ORDER BY report_date DESC) = 1),
 si AS (SELECT snap.*, industry FROM snap JOIN ind USING (code) QUALIFY count(*) OVER (PARTITION BY industry) > 1),
 ml AS (SELECT code, industry, unnest([{', '.join(f"'{m}'" for m in FU.METRICS)}]) AS metric, unnest([{', '.join(FU.METRICS)}]) AS value FROM si),
 mk AS (SELECT *, CASE WHEN metric IN ({_HIGH}) THEN -value ELSE value END AS signed FROM ml WHERE value IS NOT NULL),
 mr AS (SELECT *, rank() OVER (PARTITION BY industry, metric ORDER BY signed) AS rank, count(*) OVER m AS total,
  (sum(value) OVER m - value) / nullif(count(*) OVER m - 1, 0) AS peer_mean FROM mk WINDOW m AS (PARTITION BY industry, metric)),
 rkg AS (SELECT *, (total - rank) / total * 100 AS percentile, signed < CASE WHEN metric IN ({_HIGH}) THEN -peer_mean ELSE peer_mean END AS ahead,
  signed > CASE WHEN metric IN ({_HIGH}) THEN -peer_mean ELSE peer_mean END AS behind FROM mr)"""


def ranking(spark, sf_dir):
    snap = C.latest_row(reports(spark, sf_dir), "code", "report_date").join(industries(spark, sf_dir), "code")
    return FU.industry_ranking(snap, splits=weekly_splits(spark, sf_dir))


@query("industry_ranking", f"""WITH {REPORTS}, {INDUSTRY}, {RANKING} SELECT code, industry, metric, rank, total, CASE WHEN percentile >= 60 THEN 'advantage'
 WHEN percentile <= 40 THEN 'disadvantage' WHEN ahead THEN 'advantage' WHEN behind THEN 'disadvantage' ELSE 'neutral' END AS view, {r4(['value', 'percentile', 'peer_mean'], 3)} FROM rkg""")
def industry_ranking(spark, sf_dir):
    return report(ranking(spark, sf_dir), ["code", "industry", "metric", "rank", "total", "view"], ["value", "percentile", "peer_mean"], 3)


@query("industry_summary", f"""WITH {REPORTS}, {INDUSTRY}, {RANKING}, c AS (SELECT code, count(*) FILTER (metric IN ({_VALM}) AND percentile >= 60) AS valuation_good,
 count(*) FILTER (metric IN ({_VALM}) AND percentile <= 40) AS valuation_bad, count(*) FILTER (metric NOT IN ({_VALM}) AND percentile >= 60) AS fundamental_good,
 count(*) FILTER (metric NOT IN ({_VALM}) AND percentile <= 40) AS fundamental_bad FROM rkg GROUP BY code),
 t AS (SELECT *, CASE WHEN fundamental_good > fundamental_bad THEN 'earnings above industry' WHEN fundamental_bad > fundamental_good THEN 'earnings below industry' END AS a,
 CASE WHEN valuation_bad > valuation_good THEN 'valuation high' WHEN valuation_good > valuation_bad THEN 'valuation low' END AS b FROM c)
SELECT * EXCLUDE (a, b), CASE WHEN a IS NULL AND b IS NULL THEN 'close to industry' WHEN a = 'earnings above industry' AND b = 'valuation high'
 THEN 'earnings above industry, but valuation high' ELSE concat_ws(', ', a, b) END AS summary FROM t""")
def industry_summary(spark, sf_dir):
    return FU.industry_summary(ranking(spark, sf_dir))

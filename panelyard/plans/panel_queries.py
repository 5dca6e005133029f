"""Scan, cleaning and resampling queries."""

import uuid

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.columns import change_pct, month_end, normalize_code, week_end
from ..functions.rolling import lag
from ..operators import cleaning as C
from ..session import materialize, shared_folder
from ..sources import panel as P
from .registry import query
from .tables import DAILY, INDUSTRY, WEEKLY, code_of, daily_bars, industries, report, r_sql, table, weekly_bars

PRICES = ["open", "high", "low", "close"]


@query("panel_weekly_bars", f"""WITH {WEEKLY} SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('open')}, {r_sql('high')},
 {r_sql('low')}, {r_sql('close')}, {r_sql('volume')}, {r_sql('amount', places=2)} FROM bars""")
def panel_weekly_bars(spark, sf_dir):
    return report(weekly_bars(spark, sf_dir), ["code", "date"], PRICES + ["volume", ("amount", 2)])


@query("panel_daily_bars", f"""WITH {DAILY} SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('open')}, {r_sql('high')},
 {r_sql('low')}, {r_sql('close')}, {r_sql('volume')}, {r_sql('amount', places=4)} FROM bars""")
def panel_daily_bars(spark, sf_dir):
    return report(daily_bars(spark, sf_dir), ["code", "date"], PRICES + ["volume", ("amount", 4)])


# master: list date and ST flag of a code, from its earliest raw row and the account balance
MASTER_SQL = """master AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SH' AS code,
 s_acctbal < 0 AS is_st, first_ship AS list_date
 FROM supplier LEFT JOIN (SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS first_ship FROM lineitem GROUP BY 1) x
 ON s_suppkey = l_suppkey)"""


def master(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").cast("date").alias("list_date"))
    su = table(spark, sf_dir, "supplier")
    return su.join(first, su.s_suppkey == first.l_suppkey, "left").select(
        code_of("s_suppkey").alias("code"), (F.col("s_acctbal") < 0).alias("is_st"), "list_date")


@query("clean_panel", f"""WITH {WEEKLY}, {MASTER_SQL},
 j AS (SELECT bars.*, is_st, list_date, date - list_date AS age FROM bars LEFT JOIN master USING (code)),
 k AS (SELECT *, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS change_pct FROM j
   WHERE (list_date IS NULL OR age >= 60) AND volume > 0 WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('close')}, {r_sql('change_pct')},
 coalesce(change_pct >= 9.9, false) AS is_limit_up, coalesce(change_pct <= -9.9, false) AS is_limit_down
FROM k WHERE NOT coalesce(is_st, false) AND close IS NOT NULL""")
def clean_panel(spark, sf_dir):
    bars, m = weekly_bars(spark, sf_dir), master(spark, sf_dir)
    df = C.filter_suspended(C.filter_new_listings(bars, m))
    df = df.withColumn("change_pct", change_pct("close", lag("close")))
    df = C.filter_st(C.flag_st(C.flag_limits(df), m))
    return report(df, ["code", "date", "is_limit_up", "is_limit_down"], ["close", "change_pct"])


@query("suspension_fill", f"""WITH {DAILY}, cal AS (SELECT DISTINCT date FROM bars),
 codes AS (SELECT code, min(date) AS a, max(date) AS b FROM bars GROUP BY code),
 grid AS (SELECT code, date FROM codes JOIN cal ON date BETWEEN a AND b)
SELECT grid.code, CAST(grid.date AS VARCHAR) AS date,
 round(last_value(close IGNORE NULLS) OVER w, 6) + 0.0 AS close,
 round(last_value(volume IGNORE NULLS) OVER w, 6) + 0.0 AS volume
FROM grid LEFT JOIN bars USING (code, date)
WINDOW w AS (PARTITION BY grid.code ORDER BY grid.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def suspension_fill(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).select("code", "date", "close", "volume")
    # every day between a code's first and last bar on which any code traded
    days = bars.select("date").distinct()
    spans = bars.groupBy("code").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    grid = (spans.select("code", F.explode(F.sequence("_a", "_b")).alias("date"))
            .join(days, "date", "left_semi"))
    filled = C.fill_suspended(grid.join(bars, ["code", "date"], "left"), ["close", "volume"])
    return report(filled, ["code", "date"], ["close", "volume"])


@query("code_normalize", """SELECT user_id, lpad(CAST(user_id AS VARCHAR), 6, '0') || '.' ||
 CASE user_id % 3 WHEN 0 THEN 'SZ' WHEN 1 THEN 'SH' ELSE 'BJ' END AS code FROM events GROUP BY 1""")
def code_normalize(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    digits = F.lpad(F.col("user_id").cast("string"), 6, "0")
    messy = (F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("sz"), digits))
             .when(F.col("user_id") % 3 == 1, F.concat(F.lit(" SH."), digits))
             .otherwise(F.concat(digits, F.lit(".bj "))))
    return ids.select("user_id", normalize_code(messy).alias("code"))


@query("accept_vendor_table", f"""WITH {DAILY}, k AS (SELECT *,
 (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100 AS change_pct
 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('change_pct')},
 coalesce(change_pct >= 9.9, false) AS is_limit_up, coalesce(change_pct <= -9.9, false) AS is_limit_down,
 false AS is_st FROM k""")
def accept_vendor_table(spark, sf_dir):
    vendor = daily_bars(spark, sf_dir).select(
        F.col("code").alias("ts_code"), F.date_format("date", "yyyyMMdd").alias("trade_date"),
        *PRICES, F.col("volume").alias("vol"))
    df = P.accept_table(P.standardize_columns(vendor))
    return report(df, ["code", "date", "is_limit_up", "is_limit_down", "is_st"], ["change_pct"])


_ADJ = """adj AS (SELECT code, date, 1 + volume / 100 AS adj_factor FROM bars WHERE dayofyear(date) % 3 <> 0),
 base AS (SELECT code, arg_max(adj_factor, date) AS last_f, arg_min(adj_factor, date) AS first_f FROM adj GROUP BY code)"""


@query("adjusted_prices", f"""WITH {WEEKLY}, {_ADJ}
SELECT bars.code, CAST(bars.date AS VARCHAR) AS date,
 round(close * coalesce(coalesce(adj_factor, last_f) / last_f, 1), 6) + 0.0 AS close_qfq,
 round(close * coalesce(coalesce(adj_factor, first_f) / first_f, 1), 6) + 0.0 AS close_hfq
FROM bars LEFT JOIN adj USING (code, date) LEFT JOIN base USING (code)""")
def adjusted_prices(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("code", "date", "close", "volume")
    # weeks whose day of year divides by three have no published factor
    factors = bars.where(F.dayofyear("date") % 3 != 0).select(
        "code", "date", (1 + F.col("volume") / 100).alias("adj_factor"))
    both = bars.select("code", "date", F.col("close").alias("close_qfq"), F.col("close").alias("close_hfq"))
    out = C.adjust_prices(both, factors, "qfq", ["close_qfq"])
    out = C.adjust_prices(out, factors, "hfq", ["close_hfq"])
    return report(out, ["code", "date"], ["close_qfq", "close_hfq"])


@query("resample_week_month", f"""WITH {DAILY},
 w AS (SELECT code, 'week' AS timeframe, CAST(date_trunc('week', date) AS DATE) + 4 AS d0, * EXCLUDE (code) FROM bars),
 w2 AS (SELECT *, CASE WHEN date > d0 THEN d0 + 7 ELSE d0 END AS bucket FROM w),
 m2 AS (SELECT code, 'month' AS timeframe, last_day(date) AS bucket, * EXCLUDE (code) FROM bars),
 u AS (SELECT code, timeframe, bucket, date, open, high, low, close, volume, amount FROM w2
  UNION ALL SELECT code, timeframe, bucket, date, open, high, low, close, volume, amount FROM m2)
SELECT code, timeframe, CAST(bucket AS VARCHAR) AS date, round(arg_min(open, date), 6) + 0.0 AS open,
 round(max(high), 6) + 0.0 AS high, round(min(low), 6) + 0.0 AS low, round(arg_max(close, date), 6) + 0.0 AS close,
 round(sum(volume), 6) + 0.0 AS volume, round(sum(amount), 4) + 0.0 AS amount, count(*) AS bars
FROM u GROUP BY 1, 2, 3""")
def resample_week_month(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    week = C.resample(bars, week_end("date")).withColumn("timeframe", F.lit("week"))
    month = C.resample(bars, month_end("date")).withColumn("timeframe", F.lit("month"))
    return report(week.unionByName(month), ["code", "timeframe", "date", "bars"],
                  PRICES + ["volume", ("amount", 4)])


@query("latest_rows", f"""WITH {WEEKLY}, last AS (SELECT * FROM bars QUALIFY row_number() OVER
 (PARTITION BY code ORDER BY date DESC) = 1)
SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('close')}, date = (SELECT max(date) FROM bars) AS is_newest FROM last""")
def latest_rows(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("code", "date", "close")
    newest = C.latest_date(bars).select("code", F.lit(True).alias("is_newest"))
    out = C.latest_row(bars).join(newest, "code", "left").withColumn("is_newest", F.coalesce("is_newest", F.lit(False)))
    return report(out, ["code", "date", "is_newest"], ["close"])


@query("last_five_bars", f"""WITH {DAILY} SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('close')} FROM bars
 QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 5""")
def last_five_bars(spark, sf_dir):
    return report(C.last_n(daily_bars(spark, sf_dir).select("code", "date", "close"), 5), ["code", "date"], ["close"])


@query("first_event_per_user", """SELECT user_id, event_type, event_id FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def first_event_per_user(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return C.drop_repeats(ev, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("membership_semi", f"""WITH {WEEKLY} SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('close')} FROM bars
 WHERE date IN (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')
 AND code IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SH' FROM supplier WHERE s_acctbal > 0)""")
def membership_semi(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("code", "date", "close")
    days = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.date_trunc("week", "o_orderdate").cast("date").alias("date"))
    codes = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(code_of("s_suppkey").alias("code"))
    return report(C.semi(C.semi(bars, days, ["date"]), codes, ["code"]), ["code", "date"], ["close"])


@query("panel_profile", f"""WITH {WEEKLY} SELECT count(*) AS n_rows, count(DISTINCT code) AS n_codes,
 count(DISTINCT date) AS n_dates, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM bars""")
def panel_profile(spark, sf_dir):
    return weekly_bars(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.countDistinct("code").alias("n_codes"),
        F.countDistinct("date").alias("n_dates"), F.min("date").cast("string").alias("first_date"),
        F.max("date").cast("string").alias("last_date"))


@query("factor_store_scan", f"""WITH {WEEKLY}, f AS (SELECT code, date, close / open - 1 AS day_ret,
 (high - low) / close AS span FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')
SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('day_ret')}, {r_sql('span')} FROM f""")
def factor_store_scan(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir)
    wide = bars.select("code", "date", (F.col("close") / F.col("open") - 1).alias("day_ret"),
                       ((F.col("high") - F.col("low")) / F.col("close")).alias("span"))
    names = ["day_ret", "span"]
    long = P.unpivot_factors(wide, names).withColumn("factor_value", F.col("factor_value").cast("string"))
    scanned = P.read_factor_store(long, "1997-01-01", "1999-12-31")
    return report(P.pivot_factors(scanned, names), ["code", "date"], names)


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("panel_store_windows", f"""WITH {WEEKLY}, st AS (SELECT code, date, close, CASE WHEN year(date) = (SELECT max(year(date)) FROM bars) THEN volume * 2 ELSE volume END AS volume FROM bars),
 rg AS (SELECT *, close / lag(close) OVER w - 1 AS ret, avg(volume) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS volume_5 FROM st WHERE date >= DATE '1996-06-01' WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('ret')}, {r_sql('volume_5')} FROM rg""")
def panel_store_windows(spark, sf_dir):
    """Bars stored once by year and code, the last year replaced, then windows by code over a date range."""
    bars = materialize(weekly_bars(spark, sf_dir).select("code", "date", "close", "volume"))
    name = f"store_{uuid.uuid4().hex}"
    P.write_store(bars, name, _folder(spark, "store"), 8)
    last = bars.agg(F.max(F.year("date")).alias("_last"))
    P.update_store(bars.join(F.broadcast(last), F.year("date") == F.col("_last")).drop("_last").withColumn("volume", F.col("volume") * 2), name, 8)
    df = P.read_store(spark, name, ["code", "date", "close", "volume"], start="1996-06-01")
    df = df.withColumns({"ret": R.pct_change("close"), "volume_5": R.mean("volume", 5, 1)})
    return report(df, ["code", "date"], ["ret", "volume_5"])


@query("panel_range_read", f"""WITH {WEEKLY} SELECT code, CAST(date AS VARCHAR) AS date, {r_sql('close')} FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""")
def panel_range_read(spark, sf_dir):
    """Bars written by year and read back: two columns, two years, in order of date and code."""
    path = _folder(spark, "panel")
    P.write_panel(weekly_bars(spark, sf_dir), path)
    return P.sorted_output(report(P.read_panel(spark, path, ["code", "date", "close"], "1995-01-01", "1996-12-31"), ["code", "date"], ["close"]), "date", "code")


@query("side_table_json", f"""WITH {WEEKLY}, {INDUSTRY} SELECT industry, CAST(count(DISTINCT code) AS BIGINT) AS n_codes, {r_sql('avg(close)', 'mean_close')} FROM bars JOIN ind USING (code) GROUP BY industry""")
def side_table_json(spark, sf_dir):
    """A side table written as JSON and joined to the bars."""
    path = _folder(spark, "side")
    P.write_json(industries(spark, sf_dir), path)
    side = spark.read.schema("code string, industry string").json(path)
    parquet = _folder(spark, "side")
    side.write.parquet(parquet)
    joined = weekly_bars(spark, sf_dir).join(P.read_side_table(spark, parquet, side.schema), "code")
    return report(joined.groupBy("industry").agg(F.countDistinct("code").alias("n_codes"), F.avg("close").alias("mean_close")), ["industry", "n_codes"], ["mean_close"])

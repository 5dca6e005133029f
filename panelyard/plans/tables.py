"""Panels derived from the driver tables, in Spark and as SQL fragments.

weekly bars  lineitem by supplier and week, price = extended price / quantity
daily bars   events by user and day
Prices, shares and dates come from the tables; nothing is generated.
"""

from pyspark.sql import functions as F

from ..functions.columns import packed_order, rounded
from ..functions.sections import splits_for
from ..sources.panel import to_bars

# every row of lineitem in one order
LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


def line_order(li):
    """LINE_ORDER of the rows of ``li`` as one number; as a struct where that takes more than 38 digits.

    One aggregate over the five columns tells how many digits each takes. Prices and quantities
    count in hundredths, if all are whole hundredths, and times in seconds, if all are whole seconds.
    """
    time = F.col("l_shipdate").cast("timestamp")
    cents = {x: F.round(F.col(x) * 100).try_cast("long") for x in ("l_extendedprice", "l_quantity")}
    parts = {**{x: F.col(x) for x in LINE_ORDER}, **cents, "l_shipdate": F.unix_micros(time)}
    every = lambda cond: F.coalesce(F.bool_and(cond), F.lit(True))
    seen = li.agg(*[f(x).alias(n + k) for k, x in parts.items() for n, f in (("least_", F.min), ("most_", F.max))],
                  every(F.coalesce(cents["l_extendedprice"] / 100 == F.col("l_extendedprice"), F.col("l_extendedprice").isNull())
                        & F.coalesce(cents["l_quantity"] / 100 == F.col("l_quantity"), F.col("l_quantity").isNull())).alias("hundredths"),
                  every(parts["l_shipdate"] % 1_000_000 == 0).alias("seconds")).first()
    least, most = ({k: seen[n + k] or 0 for k in LINE_ORDER} for n in ("least_", "most_"))
    if seen["seconds"]:
        parts["l_shipdate"] = F.unix_seconds(time)
        least["l_shipdate"], most["l_shipdate"] = least["l_shipdate"] // 1_000_000, most["l_shipdate"] // 1_000_000
    digits = {k: len(str(most[k] - least[k])) for k in LINE_ORDER}
    if not seen["hundredths"] or sum(digits.values()) > 38:
        return F.struct(*LINE_ORDER)
    return packed_order(*[(parts[k].cast("decimal(20,0)") - F.lit(str(least[k])).cast("decimal(20,0)"), digits[k]) for k in LINE_ORDER])


def event_order():
    return packed_order((F.unix_micros(F.col("ts").cast("timestamp")), 17), ("event_id", 18))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(x):
    return F.concat(F.lpad(F.col(x).cast("string"), 6, "0"), F.lit(".SH"))


def weekly_bars(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    # grouped by the number, which sorts and hashes faster than the text made of it
    bars = to_bars(li, F.col("l_suppkey"), F.date_trunc("week", "l_shipdate"),
                   F.col("l_extendedprice") / F.col("l_quantity"),
                   F.col("l_quantity"), F.col("l_extendedprice"), line_order(li))
    return bars.withColumns({"code": code_of("code"), "turnover_rate": F.col("volume") / 50.0})


def daily_bars(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    bars = to_bars(ev, F.col("user_id"), F.to_date("ts"), F.col("value"),
                   F.lit(1.0), F.col("value"), event_order())
    return bars.withColumn("code", code_of("code"))


def weekly_splits(spark, sf_dir):
    return splits_for(table(spark, sf_dir, "lineitem"), "l_suppkey")


def weekly_rows(spark, sf_dir):
    """No code has more weekly bars than weeks lie between the first and the last line; reads one column."""
    days = F.datediff(F.max("l_shipdate").cast("date"), F.min("l_shipdate").cast("date"))
    return (table(spark, sf_dir, "lineitem").agg(days.alias("days")).first()["days"] or 0) // 7 + 2


def daily_splits(spark, sf_dir):
    return splits_for(table(spark, sf_dir, "events"), "user_id")


def industries(spark, sf_dir):
    """code, industry: the supplier's region."""
    na, re_ = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    su = table(spark, sf_dir, "supplier")
    geo = na.join(re_, na.n_regionkey == re_.r_regionkey).select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("industry"))
    return su.join(geo, "s_nationkey").select(code_of("s_suppkey").alias("code"), "industry")


WEEKLY = """bars AS (
 SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SH' AS code,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, sum(l_quantity) / 50.0 AS turnover_rate
 FROM lineitem GROUP BY 1, 2)"""

DAILY = """bars AS (
 SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') || '.SH' AS code, CAST(ts AS DATE) AS date,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount
 FROM events GROUP BY 1, 2)"""

INDUSTRY = """ind AS (
 SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SH' AS code, r_name AS industry
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def r_sql(expr, name=None, places=6):
    """Rounded expression in SQL; the sum turns -0.0 into 0.0."""
    return f"round({expr}, {places}) + 0.0 AS {name or expr}"


def report(df, keys, values, places=6):
    """Final projection of a query: text dates, rounded values."""
    kinds = dict(df.dtypes)
    out = [F.col(k).cast("string").alias(k) if kinds[k] == "date" else F.col(k) for k in keys]
    for v in values:
        name, p = (v, places) if isinstance(v, str) else v
        out.append(rounded(name, p).alias(name))
    return df.select(*out)

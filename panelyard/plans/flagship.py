"""Flagship query: does reversal predict returns?"""

from ..functions import rolling as R
from ..operators import evaluate as E
from .registry import query
from .tables import WEEKLY, report, weekly_bars, weekly_splits

SQL_PAIRS = """p AS (SELECT code, date,
  -(close / lag(close, 20) OVER (PARTITION BY code ORDER BY date) - 1) AS f,
  lead(close, 5) OVER (PARTITION BY code ORDER BY date) / close - 1 AS r FROM bars),
 q AS (SELECT * FROM p WHERE f IS NOT NULL AND r IS NOT NULL),
 k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY f)
    + (count(*) OVER (PARTITION BY date, f) - 1) / 2.0 AS rf,
   rank() OVER (PARTITION BY date ORDER BY r) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0 AS rr FROM q),
 ic AS (SELECT date, corr(rf, rr) AS ic, count(*) AS n_obs FROM k GROUP BY date
   HAVING count(*) >= 10 AND min(rf) < max(rf) AND min(rr) < max(rr))"""


def reversal_pairs(spark, sf_dir):
    bars = weekly_bars(spark, sf_dir).select("code", "date", "close")
    return bars.select("code", "date", (-R.pct_change("close", 20)).alias("reversal_20d"),
                       R.forward_return("close", 5).alias("ret_forward_5d"))


@query("ic_spearman_series", f"""WITH {WEEKLY}, {SQL_PAIRS}
SELECT CAST(date AS VARCHAR) AS date, n_obs, round(ic, 6) + 0.0 AS ic FROM ic""")
def ic_spearman_series(spark, sf_dir, min_obs=10):
    pairs = reversal_pairs(spark, sf_dir)
    series = E.ic_series(pairs, "reversal_20d", "ret_forward_5d", "spearman", min_obs, weekly_splits(spark, sf_dir))
    return report(series, ["date", "n_obs"], ["ic"])


@query("ic_flagship", f"""WITH {WEEKLY}, {SQL_PAIRS}
SELECT count(*) AS n_dates, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_std,
 round(avg(ic) / stddev_samp(ic), 6) + 0.0 AS ic_ir,
 round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS positive_ratio,
 round(avg(ic) * sqrt(count(*)) / stddev_samp(ic), 6) + 0.0 AS t_stat FROM ic""")
def flagship(spark, sf_dir, min_obs=10):
    pairs = reversal_pairs(spark, sf_dir)
    series = E.ic_series(pairs, "reversal_20d", "ret_forward_5d", "spearman", min_obs, weekly_splits(spark, sf_dir))
    return report(E.ic_stats(series), ["n_dates"], ["ic_mean", "ic_std", "ic_ir", "positive_ratio", "t_stat"])

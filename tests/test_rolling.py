"""Row windows against pandas; the convention numbers are those of the blueprint."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions import columns as C, rolling as R
from panelyard.operators import expressions as X, factors as FA
from conftest import to_pandas


def per_code(pdf, fn):
    return pdf.groupby("code", group_keys=False).apply(fn)


@pytest.mark.parametrize("n,mp", [(5, None), (20, 10), (3, 1)])
def test_mean_and_std_need_min_obs(panel, panel_pdf, n, mp):  # M1, M2, M3
    got = to_pandas(panel.withColumns({"m": R.mean("close", n, mp), "s": R.std("close", n, mp)}), "code", "date")
    roll = panel_pdf.groupby("code")["close"].rolling(n, min_periods=mp or n)
    np.testing.assert_allclose(got["m"], roll.mean().to_numpy(), atol=1e-9)
    np.testing.assert_allclose(got["s"], roll.std().to_numpy(), atol=1e-9)


def test_rank_pct_of_last_value(panel, panel_pdf):  # M5
    got = to_pandas(panel.withColumn("r", R.rank_pct("volume", 10, 5)), "code", "date")
    want = panel_pdf.groupby("code")["volume"].rolling(10, min_periods=5).rank(pct=True)
    np.testing.assert_allclose(got["r"], want.to_numpy(), atol=1e-12)


def test_zero_base_gives_null(spark):  # M6, M7
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 2.0, 3.0])], "code string, date int, close double")
    got = [r["p"] for r in df.withColumn("p", R.pct_change("close")).orderBy("date").collect()]
    assert got == [None, None, 0.5]


def test_unbiased_moments(panel, panel_pdf):  # M10
    w = R.Windows()
    cols = {"s": w.skew("close", 20, 10), "k": w.kurt("close", 20, 10)}
    got = to_pandas(w.apply(panel, cols), "code", "date")
    roll = panel_pdf.groupby("code")["close"].rolling(20, min_periods=10)
    np.testing.assert_allclose(got["s"], roll.skew().to_numpy(), atol=1e-6)
    np.testing.assert_allclose(got["k"], roll.kurt().to_numpy(), atol=1e-5)


def test_rolling_correlation_skips_constant_side(spark):
    rows = [("a", i, float(i), 1.0 if i < 5 else float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "code string, date int, x double, y double")
    got = to_pandas(df.withColumn("c", R.corr("x", "y", 5)), "date")
    assert np.isnan(got["c"][4])
    want = pd.Series([r[2] for r in rows]).rolling(5).corr(pd.Series([r[3] for r in rows]))
    np.testing.assert_allclose(got["c"][6:], want[6:], atol=1e-9)


def test_weeks_end_on_friday(spark):  # M13
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-03-31')) as d").withColumn("w", C.week_end("d"))
    pdf = to_pandas(df, "d")
    want = pd.to_datetime(pdf["d"]).dt.to_period("W-FRI").dt.end_time.dt.date
    assert list(pdf["w"]) == list(want)


def test_codes_and_dates_are_normalized(spark):
    df = spark.createDataFrame([("SZ.002594", "20240105"), ("sz002594", "2024-01-05"), (" 002594.SZ ", "junk")], "c string, d string")
    rows = df.select(C.normalize_code("c").alias("c"), C.parse_date("d").alias("d")).collect()
    assert {r["c"] for r in rows} == {"002594.SZ"}
    assert [str(r["d"]) for r in rows] == ["2024-01-05", "2024-01-05", "None"]


def test_future_rows_do_not_change_the_past(spark, panel_pdf):
    cut = panel_pdf["date"].unique()[60]
    changed = panel_pdf.copy()
    changed.loc[changed["date"] > cut, ["close", "high", "low", "volume"]] *= 3
    out = []
    for pdf in (panel_pdf, changed):
        df = FA.technical_factors(FA.panel_factors(spark.createDataFrame(pdf)))
        out.append(to_pandas(df.where(F.col("date") <= F.lit(cut)), "code", "date")[FA.TECHNICAL_FACTORS + FA.PANEL_FACTORS])
    pd.testing.assert_frame_equal(*out)


def test_factor_set_orders_and_refuses_cycles(panel):
    made = X.FactorSet().add("b", lambda: F.col("a") * 2, ["a"]).add("a", lambda: F.col("close") + 1)
    assert made.levels() == [["a"], ["b"]]
    assert made.compute(panel).where("b <> 2 * (close + 1)").count() == 0
    with pytest.raises(ValueError, match="circular"):
        X.FactorSet().add("a", lambda: F.lit(1), ["b"]).add("b", lambda: F.lit(1), ["a"]).levels()
    with pytest.raises(ValueError, match="unknown"):
        X.operator("NOPE")


def test_reversal_presets_are_negated(panel):
    got = X.compute_presets(panel, ["momentum_5d", "reversal_5d"], splits=1).where("momentum_5d is not null")
    n = got.agg(F.max(F.abs(F.col("momentum_5d") - F.col("reversal_5d")))).first()[0]
    assert n > 0.5   # opposite ends of the section


def test_one_shuffle_for_a_whole_factor_set(panel):
    plan = FA.extended_factors(panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(code") == 1

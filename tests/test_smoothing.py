"""Recursive indicators against pandas and against plain loops."""

import numpy as np
import pandas as pd
import pytest

import plain_recursion as P
from panelyard.operators import fundamentals as FU, indicators as I, smoothing as S
from conftest import to_pandas


def test_adjusted_and_plain_ewm(panel, panel_pdf):  # M8
    got = to_pandas(S.smooth(panel.select("code", "date", "close"), {"a": ("close", 0.2, True, 3), "b": ("close", 0.2, False, 1)}), "code", "date")
    g = panel_pdf.groupby("code")["close"]
    np.testing.assert_allclose(got["a"], g.transform(lambda x: x.ewm(alpha=0.2, min_periods=3).mean()), atol=1e-10)
    np.testing.assert_allclose(got["b"], g.transform(lambda x: x.ewm(alpha=0.2, adjust=False).mean()), atol=1e-10)


def test_nulls_age_the_weights():
    x = np.array([1.0, np.nan, np.nan, 2.0, 3.0])
    num = den = 0.0
    want = []
    for v in x:
        num, den = num * 0.5, den * 0.5
        if not np.isnan(v):
            num, den = num + v, den + 1
        want.append(num / den)
    np.testing.assert_allclose(P.ewm(x, 0.5), want)


def test_seeded_starts_with_the_mean():
    x = np.array([np.nan, 1.0, 2.0, 3.0, 5.0, 8.0])
    got = P.seeded(x, 3)
    assert np.isnan(got[:3]).all() and got[3] == 2.0
    assert got[4] == pytest.approx(2.0 + 0.5 * 3.0) and got[5] == pytest.approx(3.5 + 0.5 * 4.5)


def test_rsi_windows_differ(panel):
    got = to_pandas(S.add_recursive(panel.select("code", "date", "high", "low", "close"), S.EXTENDED), "code", "date").dropna()
    assert not np.allclose(got["rsi_6"], got["rsi_24"])
    assert got[["rsi_6", "rsi_14", "rsi_24"]].to_numpy().min() >= 0 and got["rsi_6"].max() <= 100
    np.testing.assert_allclose(got["kdj_j"], 3 * got["kdj_k"] - 2 * got["kdj_d"], atol=1e-9)


def test_kaufman_follows_its_definition():
    rng = np.random.default_rng(1)
    x = 10 + np.cumsum(rng.normal(size=60))
    got, n = P.kaufman(x, 10), 10
    value = x[n - 1]
    for i in range(n, 60):
        path = np.abs(np.diff(x[i - n:i + 1])).sum()
        sc = (abs(x[i] - x[i - n]) / path * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        value = value + sc * (x[i] - value)
        assert got[i] == pytest.approx(value)


def test_parabolic_stop_stays_on_its_side():
    up = np.arange(1.0, 60.0)
    stop = S.stop_and_reverse(up + 0.5, up - 0.5)
    assert (stop[2:] < (up - 0.5)[2:]).all() and (np.diff(stop[2:]) >= 0).all()
    turn = np.r_[up, up[::-1]]
    stop = S.stop_and_reverse(turn + 0.5, turn - 0.5)
    assert stop[-1] > turn[-1] + 0.5   # above the price in the fall


def test_indicator_registry(panel):
    assert len(I.list_indicators()) == 81   # every indicator the blueprint lists with a rule
    with pytest.raises(ValueError, match="unknown"):
        I.indicators(panel, ["nope"])
    with pytest.raises(ValueError, match="missing"):
        I.indicators(panel.drop("high"), ["atr"])
    out = I.indicators(panel.select("code", "date", "open", "high", "low", "close", "volume"), ["macd", "ma_5", "macd_hist"])
    assert out.columns[-3:] == ["macd", "ma_5", "macd_hist"]


def test_linear_regression_line(panel, panel_pdf):
    got = to_pandas(I.indicators(panel, ["linearreg", "linearreg_slope", "tsf", "wma"]), "code", "date")
    one = panel_pdf[panel_pdf["code"] == "000003.SH"]["close"].to_numpy()
    rows = got[got["code"] == "000003.SH"].reset_index(drop=True)
    b, a = np.polyfit(np.arange(14), one[20:34], 1)
    assert rows["linearreg_slope"][33] == pytest.approx(b) and rows["linearreg"][33] == pytest.approx(a + 13 * b)
    assert rows["tsf"][33] == pytest.approx(a + 14 * b)
    assert rows["wma"][40] == pytest.approx(np.average(one[11:41], weights=np.arange(1, 31)))


@pytest.fixture(scope="module")
def holes_pdf(panel_pdf):
    """The panel with unknown prices, a flat stretch, a code that starts late and one with few rows."""
    out = panel_pdf.drop(columns=["turnover_rate"]).copy()
    rng = np.random.default_rng(3)
    for c in ("high", "low", "close", "volume"):
        out.loc[rng.random(len(out)) < 0.04, c] = np.nan
    first = out["code"] == "000001.SH"
    out.loc[first & (out["date"] < pd.Timestamp("2024-01-20").date()), ["high", "low", "close"]] = np.nan
    flat = (out["code"] == "000002.SH") & (out["date"] > pd.Timestamp("2024-03-01").date())
    out.loc[flat, ["high", "low", "close"]] = 7.0
    return pd.concat([out[out["code"] != "000005.SH"], out[out["code"] == "000005.SH"].head(8)], ignore_index=True)


@pytest.mark.parametrize("library", ["INDICATORS", "EXTENDED", "TECHNICAL"])
def test_library_equals_plain_pandas(spark, holes_pdf, library):
    recipes = getattr(S, library)
    df = spark.createDataFrame(holes_pdf.astype(object).where(holes_pdf.notna(), None), "code string, date date, open double, high double, low double, close double, volume double, amount double")
    got = to_pandas(S.add_recursive(df.select("code", "date", "high", "low", "close", "volume"), recipes), "code", "date")
    want = pd.concat([P.frame(g, getattr(P, library)) for _, g in holes_pdf.groupby("code")]).sort_values(["code", "date"]).reset_index(drop=True)
    for n in recipes:
        # in the flat stretch the RSI's range is rounding noise
        rows = got["code"] != "000002.SH" if n.startswith("stochrsi") else slice(None)
        np.testing.assert_allclose(got[n][rows].astype(float), want[n][rows], rtol=1e-9, atol=1e-9, err_msg=n)


def test_one_long_history(spark):
    """20,000 rows in one code: every block of steps is carried on."""
    n = 20_000
    rng = np.random.default_rng(5)
    x = np.round(100 + np.cumsum(rng.normal(size=n)), 3)
    x[n // 2:] = x[n // 2]          # flat for 10,000 rows: both sides of the RSI fade, their ratio does not
    pdf = pd.DataFrame({"code": "a", "date": pd.date_range("1960-01-01", periods=n).date, "close": x})
    got = to_pandas(S.add_recursive(spark.createDataFrame(pdf), {"slow": (("close",), S.mean(S.CLOSE, 1 / 500, False)), "rsi": (("close",), S.rsi(S.CLOSE, 24)), "ema": (("close",), S.ema(60))}), "date")
    np.testing.assert_allclose(got["slow"], P.ewm(x, 1 / 500, False), rtol=1e-10)
    np.testing.assert_allclose(got["ema"].astype(float), P.seeded(x, 60), rtol=1e-10)
    want = P.History(pdf).rsi(24)
    np.testing.assert_allclose(got["rsi"].astype(float), want, rtol=1e-8)


def test_own_history_rank_of_one_long_code(spark):
    n = 100_000
    x = np.random.default_rng(9).integers(0, 3000, n).astype(float)
    x[::97] = np.nan
    pdf = pd.DataFrame({"code": "a", "date": pd.to_datetime("1700-01-01") + pd.to_timedelta(np.arange(n), "h"), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", S.finite("x"))
    got = to_pandas(FU.own_history_rank(df, {"r": "x"}), "date")
    np.testing.assert_allclose(got["r"].astype(float), pd.Series(x).expanding().rank(pct=True), rtol=1e-12)


def test_own_history_rank_keeps_rows_and_names(spark):
    pdf = pd.DataFrame({"code": ["a"] * 4 + ["b"], "date": [1, 2, 3, 4, 1], "x": [2.0, 1.0, 2.0, 3.0, 5.0], "y": [1.0, 1.0, 1.0, 1.0, 1.0]})
    got = to_pandas(FU.own_history_rank(spark.createDataFrame(pdf), {"rx": "x", "ry": "y"}), "code", "date")
    assert got["rx"].tolist() == [1.0, 0.5, 2.5 / 3, 1.0, 1.0] and got["ry"].tolist() == [1.0, 0.75, 2 / 3, 0.625, 1.0]
    assert FU.own_history_rank(spark.createDataFrame([], "code string, date int, x double"), {"r": "x"}).count() == 0

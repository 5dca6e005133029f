"""Curves, portfolio, attribution and risk by hand and against numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelyard.operators import curves as CU, portfolio as PF, risk as RK

DAY = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(400)]


def curve(spark, values, name="s"):
    return spark.createDataFrame([(name, DAY[i], float(v)) for i, v in enumerate(values)], "strategy_id string, date date, equity double")


def test_returns_and_drawdown_by_hand(spark):
    m = CU.all_metrics(curve(spark, [100, 110, 99, 120]), risk_free=0.0).first()
    r = np.array([0.1, -0.1, 120 / 99 - 1])
    assert m.total_return == pytest.approx(0.2) and m.max_drawdown == pytest.approx(-0.1)
    assert m.annual_return == pytest.approx(1.2 ** (252 / 4) - 1) and m.annual_return_by_returns == pytest.approx(1.2 ** (252 / 3) - 1)
    assert m.sharpe == pytest.approx(r.mean() * 252 / (r.std(ddof=1) * np.sqrt(252)))
    assert m.sortino == 0.0   # a single losing day has no spread
    assert m.win_rate == pytest.approx(2 / 3) and m.omega == pytest.approx((r[0] + r[2]) / 0.1)
    assert m.var_95 == 0.0 and m.ulcer_index == pytest.approx(0.1)
    assert m.sortino_rms == pytest.approx(r.mean() * 252 / (np.sqrt((np.minimum(r, 0) ** 2).mean()) * np.sqrt(252)))


def test_tail_and_shape_against_numpy(spark):
    rng = np.random.default_rng(8)
    eq = 100 * np.cumprod(1 + rng.normal(0.001, 0.02, 300))
    m = CU.all_metrics(curve(spark, eq)).first()
    r = pd.Series(eq).pct_change().dropna()
    q = np.percentile(r, 5)
    assert m.var_95 == pytest.approx(-q) and m.cvar_95 == pytest.approx(-r[r <= q].mean())
    assert m.skewness == pytest.approx(r.skew()) and m.kurtosis == pytest.approx(r.kurt())
    assert m.tail_ratio == pytest.approx(abs(np.percentile(r, 95) / q))
    assert m.stability_r2 == pytest.approx(np.corrcoef(np.arange(299), np.log1p(r).cumsum())[0, 1] ** 2)


def test_many_curves_are_independent(spark):
    both = curve(spark, [100, 90, 120], "a").unionByName(curve(spark, [50, 60, 30], "b"))
    got = {r.strategy_id: r.total_return for r in CU.all_metrics(both).collect()}
    assert got == {"a": pytest.approx(0.2), "b": pytest.approx(-0.4)}


def test_drawdown_runs(spark):
    s = CU.drawdown_summary(curve(spark, [100, 90, 95, 101, 100, 99, 98, 102, 101])).first()
    assert (s.dd_count, s.max_duration, s.max_recovery) == (3, 3, 1)
    assert s.max_depth == pytest.approx(-0.1)
    assert CU.drawdown_summary(curve(spark, [1, 2, 3])).first().dd_count == 0


def test_segments_share_a_point(spark):
    rng = np.random.default_rng(1)
    eq = 100 * np.cumprod(1 + rng.normal(0.001, 0.01, 25))
    got = CU.segment_consistency(curve(spark, eq), 10).first()
    sharpes = []
    for a in range(0, 25, 10):
        r = pd.Series(eq[a:a + 11]).pct_change().dropna()
        if len(r) >= 2:
            sharpes.append(((1 + r.mean()) ** 252 - 1) / (r.std() * np.sqrt(252)))
    assert got.segment_count == len(sharpes) and got.seg_ir_std == pytest.approx(np.std(sharpes, ddof=1))


def test_spread_of_segments_beyond_a_double_fails_its_gate(spark):
    eq = [1.0, 10.0, 110.0, 1320.0, 1400.0, 1380.0, 1500.0, 1490.0, 1510.0]      # first segment: a mean of 11 a day, to the 252nd
    both = curve(spark, eq, "a").unionByName(curve(spark, [1.0, 1.1, 1.05, 1.2, 1.1, 1.3], "b"))
    seg = CU.segment_consistency(both, 3)
    spread = {r.strategy_id: r.seg_ir_std for r in seg.collect()}
    assert spread["a"] == float("inf") and 0 < spread["b"] < 1e9
    trades = spark.createDataFrame([("a", 60), ("b", 60)], "strategy_id string, trade_count long")
    failed = {r.strategy_id: r.failed_gates for r in CU.judge(CU.all_metrics(both), seg, trades).collect()}
    assert "segments" in failed["a"]


def test_turnover_sees_codes_that_leave_and_return(spark):
    w = {0: {"a": 1.0}, 1: {"b": 1.0}, 2: {"a": 0.5, "b": 0.5}, 3: {"a": 0.5, "b": 0.5}}
    rows = [("s", DAY[d], c, x) for d, m in w.items() for c, x in m.items()]
    got = CU.turnover_stats(spark.createDataFrame(rows, "strategy_id string, date date, code string, weight double")).first()
    assert got.avg_daily_turnover == pytest.approx((1.0 + 0.5 + 0.0) / 3)


def test_covariance_blocks_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 8))
    rows = [(f"c{j}", DAY[i], float(x[i, j])) for i in range(30) for j in range(8)] + [("c0", DAY[31], 1.0)]   # an incomplete date
    df = spark.createDataFrame(rows, "code string, date date, ret double")
    want = np.cov(x.T)
    for cells in (10_000, 60):
        got = {(r.code_a, r.code_b): r.covariance for r in PF.covariance(df, cells).collect()}
        assert len(got) == 36
        for (a, b), v in got.items():
            assert v == pytest.approx(want[int(a[1]), int(b[1])])


def test_brinson_closes(spark):
    rows = [(DAY[0], "x", 0.6, 0.5, 0.02, 0.01), (DAY[0], "y", 0.4, 0.5, -0.01, 0.0)]
    df = spark.createDataFrame(rows, "date date, industry string, wp double, wb double, rp double, rb double")
    c, f = PF.brinson(df).first(), PF.brinson(df, "fachler").first()
    assert c.closes and c.allocation == pytest.approx(0.1 * 0.01) and c.selection == pytest.approx(0.5 * 0.01 + 0.5 * -0.01)
    assert f.closes and f.allocation == pytest.approx(0.1 * 0.005 - 0.1 * -0.005)


def test_costs(spark):
    t = spark.createDataFrame([("buy", 10.0, 100), ("sell", 100.0, 1000)], "side string, price double, shares long")
    b, s = PF.trade_costs(t).orderBy("side").collect()
    assert b.fill_price == pytest.approx(10.01) and b.commission == 5.0 and b.stamp_tax == 0.0
    assert s.amount == pytest.approx(99900) and s.total_cost == pytest.approx(99900 * (0.00025 + 0.001 + 0.00002))


def test_order_rules_in_order(spark):
    rows = [("a", "buy", 0.0, 100, False, None), ("b", "buy", 5.0, 150, True, None), ("c", "buy", 5.0, 100, True, None),
            ("d", "buy", 500.0, 1000, False, None), ("e", "buy", 5.0, 100, False, 6.0), ("f", "sell", 5.0, 100, True, 5.1)]
    df = spark.createDataFrame(rows, "code string, side string, price double, shares long, is_limit_up boolean, vwap double")
    got = {r.code: r.rule for r in RK.check_orders(df, 1_000_000).collect()}
    assert got == {"a": "invalid", "b": "lot_size", "c": "limit_up", "d": "amount_ratio", "e": "price_deviation", "f": "passed"}


def test_loss_breakers(spark):
    calm, bad = [100 + i for i in range(10)], [100, 99, 98, 97, 96, 95, 94]
    df = curve(spark, calm, "calm").unionByName(curve(spark, bad, "bad"))
    got = {(r.strategy_id, r.rule) for r in RK.loss_breakers(df).collect()}
    assert got == {("calm", "circuit_breaker.passed"), ("bad", "circuit_breaker.weekly_loss"), ("bad", "circuit_breaker.consecutive_loss")}


def test_rebalance_in_lots(spark):
    t = spark.createDataFrame([("a", 0.5, 10.0), ("b", 0.0, 10.0), ("c", 0.001, 10.0)], "code string, weight double, price double")
    h = spark.createDataFrame([("b", 500, 300)], "code string, shares long, available long")
    got = {r.code: (r.side, r.volume) for r in PF.rebalance_orders(t, h, 10_000).collect()}
    assert got == {"a": ("buy", 500), "b": ("sell", 300)}


def test_trade_holding_days(spark):
    rows = [("s", "a", DAY[0], 1, "buy", None), ("s", "a", DAY[2], 2, "buy", None), ("s", "a", DAY[5], 3, "sell", 10.0),
            ("s", "a", DAY[6], 4, "sell", -4.0)]
    df = spark.createDataFrame(rows, "strategy_id string, code string, date date, seq long, action string, pnl double")
    got = CU.trade_stats(df).first()
    assert got.avg_holding_days == 3.0 and got.win_rate == 0.5 and got.profit_factor == 2.5

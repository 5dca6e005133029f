"""Readers, sinks, cleaning, point-in-time joins, quality gates."""

import datetime as dt
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from panelyard.functions.columns import exact_sum
from panelyard.operators import cleaning as C, dispatch as DP, fundamentals as FU, levels as LV, pit as PT
from panelyard.plans import tables
from panelyard.sources import panel as P

D = dt.date


def test_panel_roundtrip_prunes_columns_and_dates(spark, panel, tmp_path):
    P.write_panel(panel, str(tmp_path / "p"))
    back = P.read_panel(spark, str(tmp_path / "p"), ["code", "date", "close"], "2024-02-01", "2024-02-29")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "date" in plan.split("PushedFilters")[1]
    assert "ReadSchema: struct<code:string,date:date,close:double>" in plan
    assert back.count() == panel.where("date between '2024-02-01' and '2024-02-29'").count()
    P.write_json(back.limit(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_store_windows_need_no_exchange(spark, panel, tmp_path):
    rows = panel.select("code", "date", "close", "volume")
    rows = rows.union(rows.withColumn("date", F.date_sub("date", 366)))
    P.write_store(rows, "t_store", str(tmp_path / "s"), 4)
    P.update_store(rows.where("year(date) = 2024").withColumn("volume", F.lit(1.0)), "t_store", 4)
    spark.sql("DROP TABLE t_store")                     # an external table: its files stay
    P.open_store(spark, "t_store", str(tmp_path / "s"), 4)
    df = P.read_store(spark, "t_store", ["code", "date", "close", "volume"], "2024-02-01").withColumn("before", P.lag("close"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan and "PartitionFilters: [isnotnull(year" in plan
    assert df.where("volume <> 1").count() == 0 and df.count() == rows.where("date >= '2024-02-01'").count()
    assert P.read_store(spark, "t_store", end="2023-12-31").where("volume <> 1").count() == rows.where("date < '2024-01-01' and volume <> 1").count() > 0
    spark.sql("DROP TABLE t_store")


def test_csv_and_side_table(spark, panel, tmp_path):
    panel.select(*[f.name for f in P.PANEL.fields]).write.csv(str(tmp_path / "c"), header=True)
    assert P.read_csv_panel(spark, str(tmp_path / "c")).dtypes == [(f.name, f.dataType.simpleString()) for f in P.PANEL.fields]
    panel.limit(5).write.parquet(str(tmp_path / "s"))
    assert P.read_side_table(spark, str(tmp_path / "s")).count() == 5


def test_accept_table_checks_columns(spark, panel):
    with pytest.raises(ValueError, match="missing columns"):
        P.accept_table(panel.drop("volume"))
    out = P.accept_table(panel.withColumnRenamed("code", "ts_code"))
    assert {"change_pct", "is_limit_up", "is_limit_down", "is_st"} <= set(out.columns)


def test_factor_store_casts(spark):
    df = spark.createDataFrame([("a", "2024-01-02", "f", "1.5"), ("a", "2024-01-03", "f", "bad"), ("b", "2024-03-01", "f", "2")],
                               "code string, date string, factor_name string, factor_value string")
    rows = P.read_factor_store(df, "2024-01-01", "2024-01-31", ["a"]).collect()
    assert sorted((r.factor_value for r in rows), key=str) == [1.5, None]


def test_bars_take_first_and_last(spark):
    rows = [("a", D(2024, 1, 1), 2, 5.0, 1.0), ("a", D(2024, 1, 1), 1, 3.0, 2.0), ("a", D(2024, 1, 1), 3, 4.0, 1.0)]
    t = spark.createDataFrame(rows, "c string, d date, s int, p double, v double")
    b = P.to_bars(t, F.col("c"), F.col("d"), F.col("p"), F.col("v"), F.col("p") * F.col("v"), ["s"]).first()
    assert (b.open, b.high, b.low, b.close, b.volume, b.amount) == (3.0, 5.0, 3.0, 4.0, 4.0, 15.0)


def test_adjustment_modes(spark):
    px = spark.createDataFrame([("a", D(2024, 1, i), 10.0) for i in (1, 2, 3)], "code string, date date, close double")
    adj = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 3), 2.0)], "code string, date date, adj_factor double")
    get = lambda m: [r.close for r in C.adjust_prices(px, adj, m, ["close"]).orderBy("date").collect()]
    assert get("qfq") == [5.0, 10.0, 10.0] and get("hfq") == [10.0, 10.0, 20.0]


def test_new_listing_filter(spark):
    px = spark.createDataFrame([("a", D(2024, 3, 1)), ("b", D(2024, 3, 1)), ("c", D(2024, 3, 1))], "code string, date date")
    m = spark.createDataFrame([("a", D(2024, 1, 1)), ("b", D(2024, 2, 20))], "code string, list_date date")
    assert sorted(r.code for r in C.filter_new_listings(px, m).collect()) == ["a", "c"]


def facts(spark):
    return spark.createDataFrame([("a", "20230930", "20231020", 1.0), ("a", "20231231", "20240415", 2.0), ("a", "20230630", "20240420", 9.0),
                                  ("a", "20240331", None, 7.0)], "code string, report_date string, disclosure_date string, roe double")


def test_asof_takes_newest_published_period(spark):
    f = facts(spark)
    panel = spark.createDataFrame([("a", D(2023, 10, 1)), ("a", D(2023, 10, 20)), ("a", D(2024, 4, 15)), ("a", D(2024, 5, 1)), ("b", D(2024, 5, 1))], "code string, date date")
    got = {(r.code, r.date): r.roe for r in PT.asof_join(panel, f, ["roe"], PT.announce_date(f, "disclosure_date")).collect()}
    # a late disclosure of an older period does not replace a newer one
    assert got == {("a", D(2023, 10, 1)): None, ("a", D(2023, 10, 20)): 1.0, ("a", D(2024, 4, 15)): 2.0, ("a", D(2024, 5, 1)): 2.0, ("b", D(2024, 5, 1)): None}


def test_delay_replaces_a_missing_announcement(spark):
    f = facts(spark).drop("disclosure_date")
    panel = spark.createDataFrame([("a", D(2023, 11, 13)), ("a", D(2023, 11, 14))], "code string, date date")
    got = [r.roe for r in PT.asof_join(panel, f, ["roe"], PT.announce_date(f, None, 45)).orderBy("date").collect()]
    assert got == [9.0, 1.0]


def test_pit_filter_modes(spark):
    f = facts(spark)
    assert PT.pit_filter(f, "2024-01-01").count() == 1 and PT.pit_violations(f, "2024-01-01").count() == 2
    with pytest.raises(ValueError):
        PT.pit_filter(f.drop("disclosure_date"), "2024-01-01")
    assert PT.pit_filter(f.drop("disclosure_date"), "2024-01-01", strict=False).count() == 4
    kept, seen = PT.pit_guard(f, "2024-01-01", "test")
    assert kept.count() == 1 and seen.get == {"before": 4, "after": 1}


@pytest.mark.parametrize("day,warn,mode", [("2024-05-05", False, "normal"), ("2024-05-05", True, "degraded"), ("2024-05-08", False, "degraded"), ("2024-06-08", False, "abort")])
def test_quality_gate_states(spark, day, warn, mode):
    daily = spark.createDataFrame([("a", D(2024, 5, 1))], "code string, date date")
    bad = PT.pit_violations(facts(spark), "2024-01-01") if warn else None
    assert PT.quality_gate({"daily": daily}, day, bad).first()["mode"] == mode


def test_quality_gate_aborts_without_core(spark):
    r = PT.quality_gate({"daily": None, "financial": facts(spark)}, "2024-05-05", dates={"financial": "report_date"}).first()
    assert r["mode"] == "abort" and r["missing_core"] == ["daily"] and r["freshness_days"] == 999


def test_label_leaks():
    found = PT.label_leaks(["a", "fwd_ret", "y"], ["a", "fwd_ret", "y", "z"], "y")
    assert found == [("y", "label_in_features"), ("fwd_ret", "looks_forward"), ("z", "missing")]


def test_valuation_needs_positive_values(spark):
    rows = [("a", D(2024, m, 1), v) for m, v in ((1, 10.0), (2, -5.0), (3, 30.0), (4, 20.0))]
    r = FU.valuation_percentiles(spark.createDataFrame(rows, "code string, date date, pe_ttm double")).first()
    assert r.samples == 3 and r.current_value == 20.0 and r.percentile == pytest.approx(50.0) and r.median == 20.0 and r.verdict == "fair"


def test_peer_mean_leaves_the_company_out(spark):
    rows = [("a", "x", 10.0), ("b", "x", 20.0), ("c", "x", 40.0), ("d", "alone", 1.0)]
    snap = spark.createDataFrame(rows, "code string, industry string, roe double")
    for splits in (1, 4):
        got = {r.code: (r.rank, r.total, r.peer_mean, r.view) for r in FU.industry_ranking(snap, splits=splits).collect()}
        assert got == {"a": (3, 3, 30.0, "disadvantage"), "b": (2, 3, 25.0, "disadvantage"), "c": (1, 3, 15.0, "advantage")}


def test_rank_of_equal_sums_does_not_depend_on_the_order_of_rows(spark):
    parts = [0.1, 0.2, 0.3, 1234.7, 99999.91, 0.6]
    rows = [(c, x) for c, xs in (("a", parts), ("b", parts[::-1]), ("c", parts[3:] + parts[:3])) for x in xs]
    df = spark.createDataFrame(rows, "code string, x double").repartition(1).sortWithinPartitions("code")
    got = {r.s for r in df.groupBy("code").agg(exact_sum("x").alias("s")).collect()}
    assert got == {101235.81}
    odd = spark.createDataFrame([("n", float("nan")), ("n", 1.0), ("i", float("inf")), ("i", 2.0), ("h", 1e300), ("h", None), ("z", None),
                                 ("t", 1e-15), ("t", 2e-15)], "code string, x double")
    s = {r.code: r.s for r in odd.groupBy("code").agg(exact_sum("x").alias("s")).collect()}
    assert s["n"] != s["n"] and s["i"] == float("inf") and s["h"] == 1e300 and s["z"] is None and s["t"] == pytest.approx(3e-15)


def test_verdict_at_its_bound(spark):
    """Four percentiles that average exactly 25 in any order of addition."""
    pct = [15.7, 19.4, 0.8, 64.1]
    rows = [(f"c{i}", "dv_ratio", p) for i, order in enumerate(permutations(pct)) for p in order]
    df = spark.createDataFrame(rows, "code string, metric string, percentile double").repartition(1)
    assert {r.verdict for r in FU.valuation_score(df).collect()} == {"fairly_rich"}


def test_verdict_below_its_bound_in_every_order(spark):
    """The doubles of these percentiles come to less than 25 on average in any order of addition, as SQL adds them."""
    pct = [30.95238095238095, 7.142857142857142, 30.95238095238095, 30.95238095238095]
    rows = [(f"c{i}", "dv_ratio", p) for i, order in enumerate(permutations(pct)) for p in order]
    df = spark.createDataFrame(rows, "code string, metric string, percentile double")
    assert {r.verdict for r in FU.valuation_score(df).collect()} == {"rich"}


def test_two_values_have_the_sum_of_doubles(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.7), ("c", 0.1), ("c", 0.2), ("c", None)], "code string, x double")
    assert {r.code: r.s for r in df.groupBy("code").agg(exact_sum("x").alias("s")).collect()} == {"a": 0.1 + 0.2, "b": 0.7, "c": 0.1 + 0.2}


@pytest.mark.parametrize("big", [5, 2 ** 62])
@pytest.mark.parametrize("part", [0.25, 0.001])
def test_lines_of_equal_keys_are_ordered_by_price_and_quantity(spark, tmp_path, big, part):
    at = dt.datetime(2024, 1, 2)
    rows = [(1, big, 1, 10.0 + part, 2.0, at), (1, big, 1, 30.0, 2.0, at), (1, big, 1, 30.0, 4.0, at), (1, -big, 1, 30.0, 3.0, at), (1, big, 1, 20.0, 1.0, at)]
    li = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_shipdate timestamp")
    li.repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    bar = tables.weekly_bars(spark, str(tmp_path)).first()
    assert (bar.open, bar.close) == (10.0, 7.5)


def test_bars_that_share_code_and_date_are_taken_in_one_order(spark):
    rows = [("000001.SH", D(2024, 1, 2), 10.0, c, False) for c in (11.0, 9.0, 10.0)]
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(some, "code string, date date, pre_close double, close double, is_st boolean").coalesce(1)
        r = LV.limit_counts(df, 1).first()
        assert (r.limit_ups, r.limit_downs, r.near_limit) == (0, 1, False)


def test_categories_skip_missing_tables(spark, panel):
    out, done, skipped = DP.compute_categories(panel, {}, ("price_volume", "financial"))
    assert done == ["price_volume"] and list(skipped) == ["financial"] and "ret_20d" in out.columns
    with pytest.raises(ValueError):
        DP.compute_categories(panel, {}, ("nothing",))
    assert len(DP.FACTOR_META) == 49

"""Cross-sectional processing and evaluation against numpy and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions.distributions import t_p_value
from panelyard.operators import evaluate as E, learn as ML, process as P
from conftest import to_pandas


@pytest.fixture(scope="module")
def factors(spark):
    """50 codes x 12 days, five industries, gaps; the last day has only 20 codes."""
    rng = np.random.default_rng(11)
    rows = []
    for d in range(12):
        for i in range(50 if d < 11 else 20):
            size = rng.normal(22, 1)
            rows.append((f"{i:06d}.SZ", dt.date(2024, 1, 1) + dt.timedelta(days=d), size, f"ind{i % 5}" if i % 17 else None,
                         0.4 * size + (i % 5) + rng.normal(), None if rng.random() < 0.1 else rng.normal(), rng.normal()))
    schema = "code string, date date, lncap double, industry string, f0 double, f1 double, r double"
    df = spark.createDataFrame(rows, schema)
    return df.toPandas(), df.persist()


def dummies(part, industry):
    cols = [np.ones(len(part))] + [(industry == v).to_numpy(float) for v in sorted(industry.unique())]
    return np.column_stack(cols)


def test_neutralize_equals_least_squares(factors):
    pdf, df = factors
    got = to_pandas(P.neutralize(df, ["f0", "f1"]), "date", "code")
    for date, part in got.groupby("date"):
        x = np.column_stack([dummies(part, part["industry"].fillna("")), part["lncap"]])
        for f in ("f0", "f1"):
            y = part[f].fillna(0).to_numpy(float)
            want = y if len(part) < 30 else y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            np.testing.assert_allclose(part[f"{f}_neutral"], want, atol=1e-8)


def test_neutralize_valid_fits_known_rows_only(factors):
    pdf, df = factors
    got = to_pandas(P.neutralize_valid(df, ["f1"]), "date", "code")
    for date, part in got.groupby("date"):
        group = part["industry"].fillna(pdf["industry"].dropna().min())
        x = np.column_stack([dummies(part, group), part["lncap"]])
        ok = part["f1"].notna().to_numpy()
        b = np.linalg.lstsq(x[ok], part["f1"].to_numpy(float)[ok], rcond=None)[0]
        np.testing.assert_allclose(part["f1_neut"][ok], part["f1"].to_numpy(float)[ok] - x[ok] @ b, atol=1e-8)
        assert part["f1_neut"][~ok].isna().all()


@pytest.mark.parametrize("splits", [1, 6])
def test_winsorize(factors, splits):
    pdf, df = factors
    got = to_pandas(P.winsorize_mad(df, ["f1"], 1.0, splits), "date", "code")["f1"]
    src = pdf.sort_values(["date", "code"]).reset_index(drop=True)
    g = src.groupby("date")["f1"]
    med = g.transform("median")
    mad = (src["f1"] - med).abs().groupby(src["date"]).transform("median")
    np.testing.assert_allclose(got, src["f1"].clip(med - mad, med + mad), atol=1e-12)


@pytest.mark.parametrize("splits", [1, 6])
def test_spearman_equals_pandas(factors, splits):
    pdf, df = factors
    got = {r.date: r.ic for r in E.ic_series(df, "f1", "r", splits=splits).collect()}
    for date, part in pdf.groupby("date"):
        part = part.dropna(subset=["f1"])
        assert got[date] == pytest.approx(part["f1"].rank().corr(part["r"].rank()))


def test_constant_sections_are_left_out(spark):
    rows = [(dt.date(2024, 1, d), float(i), 1.0 if d == 1 else float(i * i)) for d in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "date date, f double, r double")
    assert [r.date.day for r in E.ic_series(df, "f", "r", "pearson").collect()] == [2]
    assert [r.date.day for r in E.ic_series(df, "f", "r", "spearman").collect()] == [2]


def test_matrix_equals_single_series(factors):
    _, df = factors
    both = {(r.factor, r.date): r.ic for r in E.ic_matrix_series(df, ["f0", "f1"], ["r"]).collect()}
    for f in ("f0", "f1"):
        for r in E.ic_series(df, f, "r", "pearson").collect():
            assert both[(f, r.date)] == pytest.approx(r.ic)


@pytest.mark.parametrize("splits", [1, 5])
def test_buckets_equal_qcut(factors, splits):
    pdf, df = factors
    got = to_pandas(E.quantile_buckets(df.select("code", "date", "f1"), "f1", splits=splits), "date", "code")
    src = pdf.dropna(subset=["f1"]).sort_values(["date", "code"])
    want = src.groupby("date")["f1"].transform(lambda x: pd.qcut(x, 5, labels=False, duplicates="drop")) + 1
    assert list(got["bucket"]) == list(want.astype(int))


def test_equal_edges_are_merged(spark):
    rows = [(f"c{i}", dt.date(2024, 1, 1), 0.0 if i < 8 else float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "code string, date date, f double")
    got = {r.code: r.bucket for r in E.quantile_buckets(df, "f").collect()}
    x = pd.Series({r[0]: r[2] for r in rows})
    want = pd.qcut(x, 5, labels=False, duplicates="drop") + 1
    assert got == want.to_dict()


def test_turnover_counts_codes(spark):
    d = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    top = {d[0]: "ab", d[1]: "bc", d[2]: "bc"}
    rows = [(x, day, 5) for day, m in top.items() for x in m]
    got = {r.date: r.turnover for r in E.top_bucket_turnover(spark.createDataFrame(rows, "code string, date date, bucket int")).collect()}
    assert got == {d[1]: pytest.approx(1 - 1 / 3), d[2]: 0.0}


def test_student_t_values():
    # two-sided points of the published t table
    np.testing.assert_allclose(t_p_value([2.228, 1.96, 12.706, 0.0], [10, 1e6, 1, 5]), [0.05, 0.05, 0.05, 1.0], atol=2e-4)


def test_lag_scan_p_values_match_the_statistic(spark, factors):
    _, df = factors
    scan = E.lag_scan(df.withColumn("close", F.exp("r")), "f0", (1, 2, 3), min_obs=10, splits=1).toPandas()
    np.testing.assert_allclose(scan["p_value"], t_p_value(scan["t_stat"], scan["n_dates"] - 1))


def test_bootstrap_separates_signal_from_noise(spark):
    rng = np.random.default_rng(2)
    rows = [(n, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(rng.normal(m, 0.05))) for n, m in (("good", 0.05), ("noise", 0.0)) for i in range(120)]
    df = spark.createDataFrame(rows, "factor string, date date, ic double")
    got = {r.factor: r for r in E.bootstrap_verdict(df, 300).collect()}
    assert got["good"].verdict == "ACCEPT" and got["good"].bootstrap_p < 0.05
    assert got["noise"].verdict == "REJECT" and got["noise"].bootstrap_p > 0.1
    again = {r.factor: r.bootstrap_p for r in E.bootstrap_verdict(df.repartition(7), 300).collect()}
    assert again == {k: v.bootstrap_p for k, v in got.items()}   # draws do not depend on the partitioning


def test_greedy_filter(spark):
    pairs = spark.createDataFrame([("aa", "b", 0.9), ("aa", "c", 0.1), ("b", "c", -0.8)], "a string, b string, corr double")
    kept = lambda strengths: sorted(r.factor for r in P.select_uncorrelated(pairs, strengths, 0.7).collect())
    stats = lambda **s: P.factor_strengths(["aa", "b", "c"], spark.createDataFrame(list(s.items()), "factor string, ic_ir double"))
    assert kept(P.factor_strengths(["aa", "b", "c"], spark=spark)) == ["b"]                  # longer name goes, a tie drops the later
    assert kept(stats(aa=0.5, b=0.4, c=-0.1)) == ["aa", "c"]
    assert kept(stats(aa=0.4, b=0.4, c=0.4)) == ["aa", "c"]


def test_filter_by_rounds_equals_one_after_the_other(spark):
    rng = np.random.default_rng(12)
    names = [f"f{i}" for i in range(30)]
    high = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < 0.12}
    strength = {n: float(rng.integers(0, 12)) for n in names}
    pairs = spark.createDataFrame([(a, b, 0.9 if (a, b) in high else 0.0) for i, a in enumerate(names) for b in names[i + 1:]], "a string, b string, corr double")
    want = []
    for n in sorted(names, key=lambda n: (-strength[n], names.index(n))):
        if not any((n, k) in high or (k, n) in high for k in want):
            want.append(n)
    table = P.factor_strengths(names, spark.createDataFrame(list(strength.items()), "factor string, ic_ir double"))
    assert sorted(r.factor for r in P.select_uncorrelated(pairs, table).collect()) == sorted(want)


def test_steps_check_columns(panel):
    P.register_step("double", lambda d: d.withColumn("close", F.col("close") * 2), ["close"])
    P.register_step("optional", lambda d: d.withColumn("x", F.lit(1)), ["absent"], critical=False)
    P.register_step("needed", lambda d: d, ["absent"])
    assert "x" not in P.run_steps(panel, ["double", "optional"]).columns
    with pytest.raises(ValueError, match="lacks columns"):
        P.run_steps(panel, ["needed"])
    with pytest.raises(ValueError, match="unknown step"):
        P.run_steps(panel, ["nothing"])


def test_folds_leave_a_gap(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(61)]
    folds = ML.fold_dates(spark.createDataFrame(days, "date date"), 5, 3).toPandas()
    for k, part in folds.groupby("fold"):
        train, valid = part[part["role"] == "train"]["date"], part[part["role"] == "validate"]["date"]
        assert (valid.min() - train.max()).days >= 4 and len(valid) in (9, 10)
    assert sorted(folds["fold"].unique()) == [0, 1, 2, 3, 4]


def test_models_and_search(spark):
    rng = np.random.default_rng(4)
    rows = []
    for d in range(40):
        for i in range(15):
            x = rng.normal()
            rows.append((f"c{i}", dt.date(2024, 1, 1) + dt.timedelta(days=d), x, rng.normal(), 2 * x + rng.normal(0, 0.3), int(x > 0)))
    t = spark.createDataFrame(rows, "code string, date date, a double, b double, forward_return double, label int")
    folds = ML.fold_dates(t.select("date"), 2, 1)
    p = ML.out_of_fold(t, folds, ["a", "b"], "linear", n_splits=2)
    got = ML.evaluate(p)
    assert got["accuracy"] > 0.9 and got["f1"] > 0.9 and got["ic"] > 0.8
    reg = ML.evaluate(ML.out_of_fold(t, folds, ["a", "b"], "linear", "regression", n_splits=2), "regression")
    assert reg["r2"] > 0.9 and reg["rmse"] == pytest.approx(reg["mse"] ** 0.5)
    best = ML.search(t, folds, ["a", "b"], {"maxDepth": [1, 3], "numTrees": [3]}, n_splits=2)
    assert best["score"] > 0.9 and best["params"]["numTrees"] == 3
    assert ML.prediction_signals(p.withColumn("prediction", F.col("forward_return")), splits=4).where("signal = 1").count() == pytest.approx(p.count() * 0.2, abs=1)

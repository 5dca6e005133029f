"""Sections cut into value ranges give exactly what one window gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions import sections as S
from conftest import to_pandas


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds most rows, one value a third of them; NULLs and a constant date too."""
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.normal(size=n)
    x[rng.random(n) < 0.35] = 0.25
    x[rng.random(n) < 0.05] = np.nan
    y = np.round(rng.normal(size=n), 1)
    date = np.where(rng.random(n) < 0.7, "2024-01-02", rng.choice(["2024-01-03", "2024-01-04"], n))
    pdf = pd.DataFrame({"id": np.arange(n), "date": pd.to_datetime(date).date, "x": x, "y": y})
    pdf.loc[pdf["date"] == pd.Timestamp("2024-01-04").date(), "y"] = 1.0
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df.persist()


@pytest.mark.parametrize("splits", [1, 7, 32])
def test_average_rank_equals_pandas(skewed, splits):
    pdf, df = skewed
    got = to_pandas(S.with_avg_rank(df, ["x", "y"], splits=splits), "id")
    for c in "xy":
        want = pdf.groupby("date")[c].rank(pct=True)
        np.testing.assert_allclose(got[f"{c}_rank"], want, rtol=0, atol=1e-12)


@pytest.mark.parametrize("splits", [1, 9])
def test_competition_rank(skewed, splits):
    pdf, df = skewed
    got = to_pandas(S.with_rank(df, "x", splits=splits), "id")
    np.testing.assert_allclose(got["rank"].astype(float), pdf.groupby("date")["x"].rank(method="min"))


@pytest.mark.parametrize("splits", [1, 5, 32])
def test_quantiles_interpolate_linearly(skewed, splits):
    pdf, df = skewed
    points = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]
    got = {r["date"]: r["q"] for r in S.quantiles(df, "x", points, splits=splits).collect()}
    for date, part in pdf.groupby("date"):
        np.testing.assert_allclose(got[date], np.nanpercentile(part["x"], np.array(points) * 100), atol=1e-12)


def test_whole_table_as_one_section(skewed):
    pdf, df = skewed
    got = S.quantiles(S.whole(df), "x", [0.8], by=(S.WHOLE,), splits=16).first()["q"][0]
    assert got == pytest.approx(np.nanpercentile(pdf["x"], 80))


@pytest.mark.parametrize("splits", [1, 4])
def test_stats_attach(skewed, splits):
    pdf, df = skewed
    got = to_pandas(S.with_stats(df, {"m": F.avg("x"), "s": F.stddev_samp("x")}, splits=splits), "id")
    np.testing.assert_allclose(got["m"], pdf.groupby("date")["x"].transform("mean"))
    np.testing.assert_allclose(got["s"], pdf.groupby("date")["x"].transform("std"))


@pytest.mark.parametrize("splits", [1, 4])
def test_dates_of_any_year(spark, splits):
    df = spark.sql("select * from values (date'2300-01-01', 1.0D), (date'0850-01-01', 3.0D), (date'2300-01-01', 2.0D) as t(date, x)")
    got = sorted((r.date.year, r.m, r.x_rank) for r in S.with_avg_rank(S.with_stats(df, {"m": F.avg("x")}, splits=splits), ["x"], splits=splits).collect())
    assert got == [(850, 3.0, 1.0), (2300, 1.5, 0.5), (2300, 1.5, 1.0)]


def test_splits_follow_the_number_of_codes(spark):
    df = spark.range(1000).withColumn("code", F.col("id") % 50)
    assert S.splits_for(df, "code") == 1
    assert S.splits_for(df, "code", rows_per_task=10) >= 5


def test_large_sections_never_sort_whole(skewed):
    _, df = skewed
    plan = S.with_avg_rank(df, ["x"], splits=8)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and "CartesianProduct" not in plan

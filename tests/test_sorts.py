"""Windows of one order share one sort: a task's memory follows its rows, not the number of outputs."""

import pytest
from pyspark.sql import functions as F

from panelyard.functions import sections as S
from panelyard.operators import evaluate as E, learn as ML, smoothing as M, timeframes as T


def sorts(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.count("Sort [")


@pytest.mark.parametrize("recipes", [M.EXTENDED, M.TECHNICAL, {k: M.INDICATORS[k] for k in ("ema_5", "macd_signal", "rsi", "adx")}])
def test_short_histories_need_one_sort_and_give_the_same(spark, panel, recipes, capsys):
    gaps = panel.withColumn("close", F.when(F.dayofmonth("date") % 7 != 3, F.col("close")))
    blocks, short = M.add_recursive(gaps, recipes), M.add_recursive(gaps, recipes, rows=90)
    assert sorts(short, capsys) == 1
    a, b = (x.orderBy("code", "date").select(*recipes).toPandas().astype(float) for x in (blocks, short))
    assert (a.isna() == b.isna()).all().all()
    assert (a.isna() | ((a - b).abs() <= 1e-9 * (1 + a.abs()))).all().all()


def test_long_histories_keep_their_blocks(panel, capsys):
    assert sorts(M.add_recursive(panel, M.EXTENDED, rows=100_000), capsys) > 1


def test_view_of_timeframes_reads_one_order(panel, capsys):
    bars = T.all_timeframes(panel.drop("turnover_rate"))
    assert sorts(T.latest_view(T.timeframe_indicators(bars, 90)), capsys) == sorts(bars, capsys) + 1


def test_rank_sorts_once_per_column(panel, capsys):
    assert sorts(S.with_avg_rank(panel, ["close", "volume"], splits=1), capsys) == 2


def test_rank_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (1, None), (2, -0.0), (2, 0.0)], "date int, x double")
    got = sorted((r.date, r.x is None, r.x or 0.0, r.x_rank) for r in S.with_avg_rank(df, ["x"], splits=1, pct=False).collect())
    assert got == [(1, False, 1.0, 1.0), (1, False, 2.0, 2.5), (1, False, 2.0, 2.5), (1, True, 0.0, None), (2, False, 0.0, 1.5), (2, False, 0.0, 1.5)]


def test_cells_of_a_rank_matrix_are_moved_by_number(panel, capsys):
    df = panel.withColumn("r", F.col("open") - F.col("close"))
    series = E.ic_matrix_series(df, ["close", "volume"], ["r"], "spearman", splits=1)
    assert {(r.factor, r.horizon) for r in series.select("factor", "horizon").distinct().collect()} == {("close", "r"), ("volume", "r")}
    assert dict(E.stack_pairs(df, [("close", "r")]).dtypes)["cell"] == "int"


def test_training_rows_are_computed_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(len(b))
            yield b
    t = spark.range(120).select(F.concat(F.lit("c"), F.col("id") % 4).alias("code"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("date"),
                                (F.col("id") % 7 / 1.0).alias("a"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 5 / 1.0).alias("forward_return"))
    t = t.mapInPandas(count, t.schema)
    folds = spark.createDataFrame([(0, "train", d) for d in range(10)] + [(0, "validate", d) for d in range(10, 20)], "fold int, role string, d int").select(
        "fold", "role", F.expr("date_add(date'2024-01-01', d)").alias("date"))
    p = ML.out_of_fold(t, folds, ["a"], "linear", n_splits=1)
    assert p.count() == 40 and p.count() == 40
    assert reads.value == 120

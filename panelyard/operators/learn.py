"""Training tables, purged folds, Spark ML models, out-of-fold predictions, signals."""

from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F, Window

from ..functions.rolling import forward_return
from ..functions.sections import DEFAULT_SPLITS, WHOLE, quantiles, whole, with_quantiles
from ..session import materialize, release

MODELS = {
    ("forest", "classification"): RandomForestClassifier, ("forest", "regression"): RandomForestRegressor,
    ("linear", "classification"): LogisticRegression, ("linear", "regression"): LinearRegression,
    ("boosted", "classification"): GBTClassifier, ("boosted", "regression"): GBTRegressor}


def training_table(features, prices, columns, period=20, splits=DEFAULT_SPLITS):
    """Features with the forward return and a label: 1 above the date's median return.

    Rows with an unknown feature or return are left out; the median is over all known returns.
    """
    fwd = prices.select("code", "date", forward_return("close", period).alias("forward_return"))
    j = features.select("code", "date", *columns).join(fwd, ["code", "date"]).where("forward_return is not null")
    j = with_quantiles(j, "forward_return", [0.5], splits=splits, name="_q")
    j = j.withColumn("label", F.when(F.col("forward_return") > F.col("_q")[0], 1).otherwise(0)).drop("_q")
    return j.na.drop(subset=list(columns))


def fold_dates(dates, n_splits=5, purge_days=0):
    """Expanding train dates and the validation block after them, per fold.

    dates: one column ``date``. There is one row per date, numbered in one window. Train dates within purge_days of the fold's end are left out.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("date")
    every = Window.partitionBy(F.lit(1))
    numbered = dates.select("date").distinct().withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(every)})
    size = F.floor(F.col("_n") / (n_splits + 1))
    d = numbered.withColumn("_size", size).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    end = F.col("_n") - (n_splits - F.col("fold")) * F.col("_size")
    d = d.withColumn("_end", end).where(F.col("_end") + 1 < F.col("_n"))
    ends = numbered.select(F.col("_i").alias("_end"), F.date_sub("date", purge_days).alias("_cut"))
    d = d.join(ends, "_end")
    train = (F.col("_i") < F.col("_end")) & (F.col("date") <= F.col("_cut"))
    start = F.col("_end") + 1
    valid = (F.col("_i") >= start) & (F.col("_i") < F.least(start + F.col("_size"), F.col("_n")))
    d = d.withColumn("role", F.when(train, "train").when(valid, "validate")).where("role is not null")
    return d.select("fold", "role", "date")


def with_folds(table, folds):
    """Rows with their fold and role."""
    return table.join(folds, "date")


def build(model, kind, columns, target, **params):
    learner = MODELS[(model, kind)](featuresCol="_x", labelCol=target, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_x"), learner])


def out_of_fold(table, folds, columns, model="forest", kind="classification", target=None, n_splits=5, **params):
    """Predictions of every validation row by the model of its own fold.

    Every fit reads its rows several times, so the table is stored once and only for the fits,
    the small table of folds too, and the predictions for what follows.
    """
    target = target or ("label" if kind == "classification" else "forward_return")
    kept = list(dict.fromkeys((target, "forward_return")))
    own = [materialize(folds)] + ([] if hasattr(table, "stored_at") else [materialize(table.select("code", "date", *dict.fromkeys([*kept, *columns])))])
    stored, folds = own[1] if len(own) > 1 else table, own[0]
    rows = with_folds(stored, folds).withColumn(target, F.col(target).cast("double"))
    parts = []
    for k in range(n_splits):
        train, valid = (rows.where((F.col("fold") == k) & (F.col("role") == r)) for r in ("train", "validate"))
        fitted = build(model, kind, columns, target, **params).fit(train)
        parts.append(fitted.transform(valid).select("code", "date", "fold", *kept, "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out)
    release(*own)
    return out


def evaluate(predictions, kind="classification", target=None):
    """Accuracy and weighted F1, or mse, rmse and r2; and the correlation with the return."""
    from ..functions.rolling import correlation
    target = target or ("label" if kind == "classification" else "forward_return")
    if kind == "classification":
        e = MulticlassClassificationEvaluator(labelCol=target)
        out = {"accuracy": e.setMetricName("accuracy").evaluate(predictions), "f1": e.setMetricName("weightedFMeasure").evaluate(predictions)}
    else:
        e = RegressionEvaluator(labelCol=target)
        out = {m: e.setMetricName(m).evaluate(predictions) for m in ("mse", "rmse", "r2")}
    out["ic"] = predictions.agg(correlation("prediction", target).alias("ic")).first()["ic"]
    return out


def search(table, folds, columns, grid, model="forest", kind="classification", n_splits=5):
    """Parameters with the best mean score over the folds (accuracy, or -rmse)."""
    best = None
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        p = out_of_fold(table, folds, columns, model, kind, n_splits=n_splits, **params)
        score = [evaluate(p.where(F.col("fold") == k), kind)["accuracy" if kind == "classification" else "rmse"] for k in range(n_splits)]
        mean = sum(score) / len(score) * (1 if kind == "classification" else -1)
        if best is None or mean > best[0]:
            best = (mean, params)
    return {"score": best[0], "params": best[1]}


def prediction_signals(predictions, column="prediction", cut=0.8, splits=DEFAULT_SPLITS):
    """signal 1 above the pooled quantile of all predictions."""
    q = quantiles(whole(predictions), column, [cut], by=(WHOLE,), splits=splits, name="_q").drop(WHOLE)
    j = predictions.crossJoin(F.broadcast(q))   # one-row quantile
    return j.withColumn("signal", F.when(F.col(column) > F.col("_q")[0], 1).otherwise(0)).drop("_q")

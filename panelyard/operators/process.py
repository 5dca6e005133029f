"""Cross-sectional processing: winsorize, standardize, fill, neutralize, combine.

Steps are DataFrame -> DataFrame functions for ``df.transform``; ``run_steps`` checks the
columns each step needs. ``splits`` is explained in functions.sections.
"""

from pyspark.sql import functions as F

from ..functions.columns import clip, safe_div
from ..functions.rolling import correlation, fill_forward
from ..functions.sections import DEFAULT_SPLITS, with_avg_rank, with_medians, with_quantiles, with_stats
from ..session import materialize


def winsorize_mad(df, columns, k=3.0, splits=DEFAULT_SPLITS):
    """Clip to median ± k MAD per date; unchanged where MAD is zero."""
    df = with_medians(df, columns, splits=splits, suffix="__med")
    df = df.withColumns({f"{x}__dev": F.abs(F.col(x) - F.col(f"{x}__med")) for x in columns})
    df = with_medians(df, [f"{x}__dev" for x in columns], splits=splits, suffix="__mad")
    made = {}
    for x in columns:
        med, mad = F.col(f"{x}__med"), F.col(f"{x}__dev__mad")
        made[x] = F.when(mad > 0, clip(x, med - k * mad, med + k * mad)).otherwise(F.col(x))
    return df.withColumns(made).drop(*[f"{x}__{s}" for x in columns for s in ("med", "dev", "dev__mad")])


def winsorize_quantile(df, columns, low=0.01, high=0.99, splits=DEFAULT_SPLITS):
    for x in columns:
        df = with_quantiles(df, x, [low, high], splits=splits, name="_q")
        df = df.withColumn(x, clip(x, F.col("_q")[0], F.col("_q")[1])).drop("_q")
    return df


def standardize(df, columns, method="zscore", splits=DEFAULT_SPLITS):
    """z-score (zero spread: centred only) or min-max (flat: 0); NULL becomes 0."""
    aggs = {}
    for x in columns:
        aggs.update({f"_m_{x}": F.avg(x), f"_s_{x}": F.stddev_samp(x)} if method == "zscore"
                    else {f"_lo_{x}": F.min(x), f"_hi_{x}": F.max(x)})
    df = with_stats(df, aggs, splits=splits)
    out = {}
    for x in columns:
        if method == "zscore":
            centred = F.col(x) - F.col(f"_m_{x}")
            v = F.when(F.coalesce(f"_s_{x}", F.lit(0.0)) == 0, centred).otherwise(safe_div(centred, f"_s_{x}"))
        else:
            v = safe_div(F.col(x) - F.col(f"_lo_{x}"), F.col(f"_hi_{x}") - F.col(f"_lo_{x}"))
        out[x] = F.coalesce(v, F.lit(0.0))
    return df.withColumns(out).drop(*aggs)


def fill_missing(df, columns, method="rank_pct", splits=DEFAULT_SPLITS):
    """rank_pct: ranks with 0.5 for NULL; mean, zero; ffill: last known per code, then 0."""
    if method == "rank_pct":
        df = with_avg_rank(df, columns, splits=splits, suffix="__r")
        return df.withColumns({x: F.coalesce(f"{x}__r", F.lit(0.5)) for x in columns}).drop(*[f"{x}__r" for x in columns])
    if method == "mean":
        df = with_stats(df, {f"_m_{x}": F.avg(x) for x in columns}, splits=splits)
        return df.withColumns({x: F.coalesce(x, f"_m_{x}", F.lit(0.0)) for x in columns}).drop(*[f"_m_{x}" for x in columns])
    if method == "zero":
        return df.withColumns({x: F.coalesce(x, F.lit(0.0)) for x in columns})
    if method == "ffill":
        return df.withColumns({x: F.coalesce(fill_forward(x), F.lit(0.0)) for x in columns})
    raise ValueError(f"unknown fill method {method}")


def _residuals(df, columns, size, group, suffix, min_count, y_of):
    """Residuals of y on size and group means per date, without a regression per section.

    With one continuous regressor, demeaning within (date, group) removes the group
    effects, and the slope is a ratio of sums of within-group covariances. Both come from
    one partial aggregation, so no section is gathered.
    """
    keys = ["date", group]
    aggs = [F.avg("_x").alias("_mx"), F.count(F.lit(1)).alias("_n")]
    for y in columns:
        v = y_of(y)
        x = F.when(v.isNotNull(), F.col("_x"))
        aggs += [F.avg(v).alias(f"_my_{y}"), F.avg(x).alias(f"_mx_{y}"), F.count(v).alias(f"_n_{y}"),
                 (F.covar_pop(x, v) * F.count(v)).alias(f"_xy_{y}"), (F.var_pop(x) * F.count(v)).alias(f"_xx_{y}")]
    cells = df.groupBy(*keys).agg(*aggs)
    per_date = cells.groupBy("date").agg(
        F.sum("_n").alias("_rows"), *[F.sum(f"_n_{y}").alias(f"_valid_{y}") for y in columns],
        *[F.coalesce(safe_div(F.sum(f"_xy_{y}"), F.sum(f"_xx_{y}")), F.lit(0.0)).alias(f"_b_{y}") for y in columns])
    cells = cells.join(per_date, "date").select(
        *keys, "_rows", *[c for y in columns for c in (f"_my_{y}", f"_mx_{y}", f"_b_{y}", f"_valid_{y}")])
    out = df.join(cells, keys, "left")
    made = {}
    for y in columns:
        v = y_of(y)
        res = (v - F.col(f"_my_{y}")) - F.col(f"_b_{y}") * (F.col("_x") - F.col(f"_mx_{y}"))
        made[y + suffix] = min_count(y, v, res)
    return out.withColumns(made)


def neutralize(df, columns, size="lncap", industry="industry", min_count=30):
    """Residuals on log size and industry, as ``<name>_neutral``.

    NULL counts as 0 in both; a missing industry is a group of its own; sections below
    min_count keep their values.
    """
    work = df.withColumns({"_x": F.coalesce(F.col(size), F.lit(0.0)) if size else F.lit(0.0),
                           "_g": F.coalesce(F.col(industry).cast("string"), F.lit("")) if industry else F.lit("")})
    keep = lambda y, v, res: F.when(F.col("_rows") < min_count, v).otherwise(res)
    out = _residuals(work, columns, size, "_g", "_neutral", keep, lambda y: F.coalesce(F.col(y), F.lit(0.0)))
    return out.select(*df.columns, *[f"{y}_neutral" for y in columns])


def neutralize_valid(df, columns, size="lncap", industry="industry"):
    """Variant: fit on known y only, missing size becomes the overall mean, a missing
    industry joins the first one; needs three known values. As ``<name>_neut``."""
    whole = df.agg(F.avg(size).alias("_mean"), F.min(industry).alias("_first"))
    work = df.crossJoin(F.broadcast(whole)).withColumns({   # a one-row table
        "_x": F.coalesce(F.col(size), F.col("_mean")), "_g": F.coalesce(F.col(industry), F.col("_first"))})
    keep = lambda y, v, res: F.when(F.col(f"_valid_{y}") >= 3, res)
    out = _residuals(work, columns, size, "_g", "_neut", keep, F.col)
    return out.select(*df.columns, *[f"{y}_neut" for y in columns])


def date_means(df, columns):
    return df.groupBy("date").agg(*[F.avg(x).alias(x) for x in columns])


def correlation_pairs(df, columns):
    """Pearson correlation of the factors' date means, one row per pair.

    The date means are a few rows per factor; pairs are formed from them, not from the panel.
    """
    means = date_means(df, columns)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
             for i, a in enumerate(columns) for b in columns[i + 1:]]
    return (means.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")
            .groupBy("a", "b").agg(correlation("x", "y").alias("corr")))


def select_uncorrelated(pairs, factors, limit=0.7):
    """The factors kept when the weaker of every pair above the limit has to go: one row each (factor, strength, place).

    factors: factor, strength, place (the least wins a tie). The strongest factor stays and takes
    its correlated ones with it, then the strongest of the rest, and so on. In a round every
    factor that is stronger than all correlated ones left stays at once; rounds go on until
    none is left. Everything is a join of small tables, none passes through the driver.
    """
    high = pairs.where(F.abs("corr") > limit).select("a", "b")
    links = materialize(high.union(high.select("b", "a")))
    left, kept = materialize(factors.select("factor", F.coalesce("strength", F.lit(0.0)).alias("strength"), "place")), None
    while left.limit(1).count():
        other = left.select(F.col("factor").alias("b"), F.struct(F.col("strength"), -F.col("place")).alias("_other"))
        near = links.join(left.select(F.col("factor").alias("a"), F.struct(F.col("strength"), -F.col("place")).alias("_own")), "a").join(other, "b")
        beaten = near.where("_other > _own").select(F.col("a").alias("factor")).distinct()
        stay = materialize(left.join(beaten, "factor", "left_anti"))
        kept = stay if kept is None else kept.unionByName(stay)
        gone = links.join(stay.select(F.col("factor").alias("a")), "a").select(F.col("b").alias("factor")).distinct()
        left = materialize(left.join(stay, "factor", "left_anti").join(gone, "factor", "left_anti"))
    return kept if kept is not None else left


def factor_strengths(columns, stats=None, spark=None):
    """factor, strength, place of the columns: |IC_IR| from ``stats`` (factor, ic_ir), or the shorter name as the stronger one."""
    if stats is None:
        names = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.lit(-float(len(c))).alias("strength"), F.lit(i).alias("place")) for i, c in enumerate(columns)]))
        return spark.range(1).select(names.alias("_f")).select("_f.*")
    listed = stats.where(F.col("factor").isin(*columns)).groupBy("factor").agg(F.max(F.abs("ic_ir")).alias("strength"))
    place = F.element_at(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))]), F.col("factor"))
    return listed.withColumn("place", place)


def fuse(df, columns, stats=None, splits=DEFAULT_SPLITS, out="alpha_score"):
    """Weighted sum of percentage ranks (NULL counts as 0.5).

    Weights are |IC_IR| shares from ``stats`` (columns factor, ic_ir), joined as one row;
    equal without stats or when all are zero.
    """
    ranked = with_avg_rank(df, columns, splits=splits, suffix="__r")
    part = lambda x: F.coalesce(f"{x}__r", F.lit(0.5))
    n = float(len(columns))
    if stats is None:
        score = sum((part(x) / n for x in columns[1:]), part(columns[0]) / n)
    else:
        weight = lambda x: F.coalesce(F.sum(F.when(F.col("factor") == x, F.abs("ic_ir"))), F.lit(0.0))
        one = stats.agg(*[weight(x).alias(f"_w_{x}") for x in columns])
        total = sum((F.col(f"_w_{x}") for x in columns[1:]), F.col(f"_w_{columns[0]}"))
        one = one.select(*[F.coalesce(safe_div(f"_w_{x}", total), F.lit(1 / n)).alias(f"_w_{x}") for x in columns])
        ranked = ranked.crossJoin(F.broadcast(one))   # a one-row table
        score = sum((F.col(f"_w_{x}") * part(x) for x in columns[1:]), F.col(f"_w_{columns[0]}") * part(columns[0]))
    return ranked.withColumn(out, score).select(*df.columns, out)


def top_signal(df, score="alpha_score", cut=0.8, splits=DEFAULT_SPLITS):
    """signal 1 where the score's percentage rank on the date exceeds the cut, else 0."""
    ranked = with_avg_rank(df, [score], splits=splits, suffix="__r")
    return ranked.withColumn("signal", F.when(F.col(f"{score}__r") > cut, 1).otherwise(0)).drop(f"{score}__r")


def latest_group_mean(df, value, group):
    """Mean of a value per group on the newest date, groups in name order."""
    from .cleaning import latest_date
    return latest_date(df).groupBy(group).agg(F.avg(value).alias("mean_value")).orderBy(group)


def latest_exposure(df, columns):
    """Mean of each style factor on the newest date, as rows."""
    from .cleaning import latest_date
    one = latest_date(df).agg(*[F.avg(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("style"), F.col(c).alias("exposure")) for c in columns])).alias("_s")).select("_s.*")


_registry = {}


def register_step(name, fn, needs=(), critical=True):
    """Add a user step: a function DataFrame -> DataFrame with the columns it needs."""
    _registry[name] = (fn, tuple(needs), critical)


def run_steps(df, names):
    """Apply registered steps in order; a step lacking columns fails, or is skipped if not critical."""
    for n in names:
        if n not in _registry:
            raise ValueError(f"unknown step {n}; known: {sorted(_registry)}")
        fn, needs, critical = _registry[n]
        missing = [c for c in needs if c not in df.columns]
        if missing and critical:
            raise ValueError(f"step {n} lacks columns {missing}")
        if not missing:
            df = df.transform(fn)
    return df

"""Cross-sections: statistics, exact ranks and exact quantiles of all codes on one date.

A section may be far larger than one task can hold, so every operation has two exact
forms. With ``splits == 1`` the section is one window partition. With more, rows are cut
by value into ranges sized from approximate quantiles, counted by partial aggregation,
and ranked inside their range; offsets make the result the same as the single window.
Values that occur often become ranges of their own whose rank needs no sort, and are
salted. ``splits_for`` chooses the form from a measured bound.

The per-section results of the second form (statistics, edges, counts) are small tables.
They are written to the shared folder when the plan is built, so that steps applied one
after another do not recompute each other, and Catalyst joins them by their true size.
"""

from math import ceil

from pyspark.sql import functions as F, Window

from ..session import materialize
from .columns import col

ROWS_PER_TASK = 2_000_000
DEFAULT_SPLITS = 32
SALTS = 64
WHOLE = "_all"


def splits_for(raw, code, rows_per_task=ROWS_PER_TASK):
    """How many value ranges a section needs.

    A panel has one row per (code, date), so no section has more rows than there are
    codes. Reads one column with partial aggregation. The 1.2 covers the sketch's error.
    """
    codes = raw.agg(F.approx_count_distinct(col(code), 0.05)).first()[0]
    return max(1, ceil(codes * 1.2 / rows_per_task))


def _salt(df, apply):
    """A repeatable spread for rows whose rank needs no sort."""
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))]
    return F.when(apply, F.pmod(F.xxhash64(*plain), F.lit(SALTS))).otherwise(F.lit(0))


def _small(stats, by):
    """Broadcast the table of one section. Others are joined by the size Spark measures:
    stored tables are read back, so it knows their bytes, and AQE splits large sections."""
    return F.broadcast(stats) if list(by) == [WHOLE] else stats


def _bounded(by):
    return list(by) == [WHOLE]


def whole(df):
    """The table as one section, for pooled ranks and quantiles."""
    return df.withColumn(WHOLE, F.lit(1))


def with_stats(df, aggs, by=("date",), splits=DEFAULT_SPLITS):
    """Attach per-section aggregates (name -> aggregate Column) to every row."""
    by = list(by)
    if splits == 1:
        w = Window.partitionBy(*by)
        return df.withColumns({k: a.over(w) for k, a in aggs.items()})
    stats = materialize(df.groupBy(*by).agg(*[a.alias(k) for k, a in aggs.items()]))
    return df.join(_small(stats, by), by, "left")


def _edges(df, names, by, splits):
    points = [i / splits for i in range(1, splits)]
    return materialize(df.groupBy(*by).agg(*[
        F.array_distinct(F.percentile_approx(col(x), points, 20 * splits)).alias(f"_edge_{x}")
        for x in names]))


def _range_id(x):
    """Even ids lie between edges, odd ids are exactly an edge value."""
    edges = F.coalesce(F.col(f"_edge_{x}"), F.array().cast("array<double>"))
    below = F.size(F.filter(edges, lambda e: e < col(x)))
    return F.when(col(x).isNotNull(),
                  2 * below + F.when(F.array_contains(edges, col(x)), 1).otherwise(0))


def _cut(df, names, by, splits):
    """Rows with a range id per column, and per-range counts with offsets."""
    rows = df.join(_small(_edges(df, names, by, splits), by), by, "left")
    rows = rows.withColumns({f"_r_{x}": _range_id(x) for x in names})
    long = rows.select(*by, F.explode(F.array(*[
        F.struct(F.lit(x).alias("_name"), F.col(f"_r_{x}").alias("_r")) for x in names])).alias("_s"))
    counts = (long.select(*by, "_s._name", "_s._r").where("_r is not null")
              .groupBy(*by, "_name", "_r").agg(F.count("*").alias("_c")))
    order = Window.partitionBy(*by, "_name").orderBy("_r")
    whole = Window.partitionBy(*by, "_name")
    counts = counts.withColumns({
        "_below": F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"),
        "_n": F.sum("_c").over(whole)})
    return rows.drop(*[f"_edge_{x}" for x in names]), materialize(counts)


def with_avg_rank(df, names, by=("date",), splits=DEFAULT_SPLITS, pct=True, suffix="_rank"):
    """Average-tie rank of each column among the section's non-null values.

    ``pct`` divides by the non-null count. NULL where the value is NULL. The values must
    be free of NaN.
    """
    by = list(by)
    if splits == 1:
        out = {}
        for x in names:
            # first and last place of the ties in one order: a window over the ties would sort again
            w = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
            rank = (F.rank().over(w) + F.count(F.lit(1)).over(w)) / F.lit(2.0)
            n = F.count(F.col(x)).over(Window.partitionBy(*by))
            out[x + suffix] = F.when(F.col(x).isNotNull(), rank / n if pct else rank)
        return df.withColumns(out)
    rows, counts = _cut(df, names, by, splits)
    for x in names:
        r = f"_r_{x}"
        offsets = counts.where(F.col("_name") == x).select(
            *by, F.col("_r").alias(r), F.col("_below"), F.col("_n"), F.col("_c"))
        rows = rows.join(F.broadcast(offsets) if _bounded(by) else offsets, by + [r], "left")
        single = F.col(r) % 2 == 1
        rows = rows.withColumn("_salt", _salt(rows, single | F.col(r).isNull()))
        part = by + [r, "_salt"]
        order = Window.partitionBy(*part).orderBy(x)
        inner = (F.rank().over(order) + F.count(F.lit(1)).over(order)) / F.lit(2.0)
        rank = F.col("_below") + F.when(single, (F.col("_c") + 1) / F.lit(2.0)).otherwise(inner)
        rows = rows.withColumn(x + suffix, F.when(F.col(x).isNotNull(),
                                                  rank / F.col("_n") if pct else rank))
        rows = rows.drop("_below", "_n", "_c", "_salt", r)
    return rows


def quantiles(df, x, points, by=("date",), splits=DEFAULT_SPLITS, name="q"):
    """Exact linearly interpolated quantiles of x: one row per section, array column."""
    by = list(by)
    data = df.where(col(x).isNotNull()).select(*by, col(x).cast("double").alias("_x"))
    if splits == 1:
        return data.groupBy(*by).agg(F.percentile("_x", list(points)).alias(name))
    rows, counts = _cut(data, ["_x"], by, splits)
    wanted = F.array(*[F.lit(float(p)) for p in points])
    # 0-based positions of the two order statistics around each point
    low_pos = F.transform(wanted, lambda p: F.floor(p * (F.col("_n") - 1)))
    counts = counts.withColumn("_pos", F.array_distinct(F.concat(
        low_pos, F.transform(low_pos, lambda k: F.least(k + 1, F.col("_n") - 1)))))
    counts = counts.withColumn("_pos", F.filter(
        F.col("_pos"), lambda k: (k >= F.col("_below")) & (k < F.col("_below") + F.col("_c"))))
    held = counts.where(F.size("_pos") > 0).select(*by, F.col("_r").alias("_r__x"), "_below", "_n", "_pos")
    # distinct values with counts, so that repeated values never pile up in one task
    values = (rows.join(F.broadcast(held) if _bounded(by) else held, by + ["_r__x"])
              .groupBy(*by, "_r__x", "_x").agg(F.count("*").alias("_c"), F.first("_below").alias("_below"),
                                               F.first("_n").alias("_n"), F.first("_pos").alias("_pos")))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_r__x").orderBy("_x")
                            .rowsBetween(Window.unboundedPreceding, 0)) + F.col("_below")
    values = values.withColumn("_hi", upto).withColumn("_pos", F.filter(
        F.col("_pos"), lambda k: (k >= F.col("_hi") - F.col("_c")) & (k < F.col("_hi"))))
    picked = values.select(*by, "_n", "_x", F.explode("_pos").alias("_k"))
    stats = picked.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        F.map_from_entries(F.collect_list(F.struct("_k", "_x"))).alias("_at"))
    spot = lambda p: p * (F.col("_n") - 1)
    at = lambda k: F.element_at("_at", k)
    return materialize(stats.select(*by, F.transform(wanted, lambda p: at(F.floor(spot(p))) + (
        at(F.least(F.floor(spot(p)) + 1, F.col("_n") - 1)) - at(F.floor(spot(p))))
        * (spot(p) - F.floor(spot(p)))).alias(name)))


def with_medians(df, names, by=("date",), splits=DEFAULT_SPLITS, suffix="_median"):
    """Attach the exact median of every named column."""
    by = list(by)
    if splits == 1:
        w = Window.partitionBy(*by)
        return df.withColumns({x + suffix: F.percentile(col(x), 0.5).over(w) for x in names})
    for x in names:   # each result is a small stored table, so the passes do not nest
        q = quantiles(df.select(*by, x), x, [0.5], by, splits, "_q")
        df = df.join(_small(q.select(*by, F.col("_q")[0].alias(x + suffix)), by), by, "left")
    return df


def with_quantiles(df, x, points, by=("date",), splits=DEFAULT_SPLITS, name="q"):
    by = list(by)
    if splits == 1:
        return df.withColumn(name, F.percentile(col(x), list(points)).over(Window.partitionBy(*by)))
    return df.join(_small(quantiles(df, x, points, by, splits, name), by), by, "left")


def with_rank(df, x, by=("date",), splits=DEFAULT_SPLITS, name="rank"):
    """Competition rank (1, 2, 2, 4) of a numeric column, ascending."""
    by = list(by)
    if splits == 1:
        return df.withColumn(name, F.when(F.col(x).isNotNull(), F.rank().over(
            Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last()))))
    rows, counts = _cut(df, [x], by, splits)
    r = f"_r_{x}"
    offsets = counts.select(*by, F.col("_r").alias(r), "_below")
    rows = rows.join(F.broadcast(offsets) if _bounded(by) else offsets, by + [r], "left")
    single = F.col(r) % 2 == 1
    rows = rows.withColumn("_salt", _salt(rows, single | F.col(r).isNull()))
    inner = F.rank().over(Window.partitionBy(*by, r, "_salt").orderBy(x))
    return rows.withColumn(name, F.when(F.col(x).isNotNull(), F.col("_below") + F.when(
        single, F.lit(1)).otherwise(inner))).drop("_below", "_salt", r)

"""Point-in-time data: what was published by when, and data quality gates."""

from pyspark.sql import functions as F, Window

from ..functions.columns import parse_date, finite

# Age in days beyond which data is degraded or unusable; core tables.
DEGRADED_DAYS, ABORT_DAYS = 5, 10
CORE_TABLES = ("daily",)
NO_DATA_AGE = 999


def pit_filter(df, asof, column="disclosure_date", strict=True):
    """Rows disclosed on or before asof; rows without a disclosure date are dropped.

    Without the column, strict mode fails and lenient mode keeps everything.
    """
    if column not in df.columns:
        if strict:
            raise ValueError(f"no {column} column: point-in-time filtering is impossible")
        return df
    return df.where(parse_date(column) <= F.lit(asof).cast("date"))


def pit_violations(df, asof, column="disclosure_date"):
    """Rows that were not yet public at asof, with the gap in days."""
    when = parse_date(column)
    limit = F.lit(asof).cast("date")
    return df.where(when > limit).withColumn("days_ahead", F.datediff(when, limit))


def pit_guard(df, asof, caller, column="disclosure_date", strict=True):
    """pit_filter that also reports how many rows went in and came out.

    Returns (filtered rows, Observation); the counts arrive with the first action.
    """
    from pyspark.sql import Observation
    seen = Observation(f"pit_guard_{caller}")
    kept = F.lit(True) if column not in df.columns else F.coalesce(
        parse_date(column) <= F.lit(asof).cast("date"), F.lit(False))
    watched = df.observe(seen, F.count(F.lit(1)).alias("before"), F.count(F.when(kept, 1)).alias("after"))
    return pit_filter(watched, asof, column, strict), seen


def guard_counts(df, asof, caller, column="disclosure_date"):
    """The same counts as a one-row table."""
    kept = parse_date(column) <= F.lit(asof).cast("date")
    return df.agg(F.lit(caller).alias("caller"), F.count(F.lit(1)).alias("before"), F.count(F.when(kept, 1)).alias("after"))


def announce_date(df, column=None, delay_days=None, period="report_date"):
    """When a row became public: a column, else the period plus a delay, else the period."""
    if column and column in df.columns:
        return parse_date(column)
    return F.date_add(parse_date(period), delay_days) if delay_days is not None else parse_date(period)


def asof_join(panel, facts, fields, announce, period="report_date", key="code", date="date"):
    """Attach to every panel row the newest period published by its date.

    Both sides are merged into one ordered history per code and the newest published
    period is carried along it: one shuffle by code, no range join. Late disclosures of
    old periods never replace newer ones. ``announce`` is a Column over facts.
    """
    renamed = dict(fields) if isinstance(fields, dict) else {f: f for f in fields}
    fact = F.struct(parse_date(period).alias("period"), announce.alias("announce"),
                    *[F.col(src).alias(out) for out, src in renamed.items()])
    known = (facts.select(F.col(key), announce.alias("_t"), fact.alias("_f")).where("_t is not null"))
    row = F.struct(*[F.col(c) for c in panel.columns if c != key])
    left = panel.select(F.col(key), F.col(date).alias("_t"), row.alias("_p"))
    merged = known.withColumn("_p", F.lit(None).cast(left.schema["_p"].dataType)).unionByName(
        left.withColumn("_f", F.lit(None).cast(known.schema["_f"].dataType)))
    w = (Window.partitionBy(key).orderBy("_t", F.col("_p").isNotNull())
         .rowsBetween(Window.unboundedPreceding, 0))
    out = merged.withColumn("_best", F.max("_f").over(w)).where("_p is not null")
    return out.select(key, "_p.*", *[F.col("_best")[o].alias(o) for o in renamed],
                      F.col("_best")["period"].alias("report_period"))


def asof_snapshot(facts, fields, asof_dates, announce, period="report_date", key="code"):
    """as-of values of every code at a short list of dates."""
    dates = F.array(*[F.lit(d).cast("date") for d in asof_dates])
    grid = facts.select(key).distinct().select(key, F.explode(dates).alias("date"))
    return asof_join(grid, facts, fields, announce, period, key).withColumnRenamed("date", "asof_date")


def table_facts(tables, dates=None):
    """One row per table: row count and newest date. tables: name -> DataFrame or None."""
    dates = dates or {}
    spark = next(t for t in tables.values() if t is not None).sparkSession
    rows = []
    for name, df in tables.items():
        column = dates.get(name, "date")
        if df is None:
            rows.append(spark.range(1).select(F.lit(name).alias("table"), F.lit(0).cast("long").alias("rows"),
                                              F.lit(None).cast("date").alias("latest")))
            continue
        latest = F.max(parse_date(column)) if column in df.columns else F.lit(None).cast("date")
        rows.append(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), latest.alias("latest")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def quality_gate(tables, asof, warnings=None, core=CORE_TABLES, degraded=DEGRADED_DAYS, abort=ABORT_DAYS, dates=None):
    """normal, degraded or abort, from missing tables, data age and disclosure warnings."""
    facts = table_facts(tables, dates)
    names = F.array(*[F.lit(c) for c in core])
    present = F.collect_set(F.when(F.col("rows") > 0, F.col("table")))
    age = F.datediff(F.lit(asof).cast("date"), F.max(F.when(F.col("table") == "daily", F.col("latest"))))
    age = F.when(age < 0, 0).otherwise(age)
    one = facts.agg(F.array_sort(F.array_except(names, present)).alias("missing_core"),
                    F.array_sort(F.collect_set(F.when((F.col("rows") == 0) & ~F.col("table").isin(*core), F.col("table")))).alias("missing_optional"),
                    F.coalesce(age, F.lit(NO_DATA_AGE)).alias("freshness_days"))
    n = warnings.agg(F.count(F.lit(1)).alias("pit_warnings")) if warnings is not None else None
    one = one.crossJoin(F.broadcast(n)) if n is not None else one.withColumn("pit_warnings", F.lit(0).cast("long"))
    mode = (F.when(F.size("missing_core") > 0, "abort").when(F.col("freshness_days") > abort, "abort")
            .when(F.col("freshness_days") > degraded, "degraded").when(F.col("pit_warnings") > 0, "degraded").otherwise("normal"))
    reason = (F.when(F.size("missing_core") > 0, "core table missing").when(F.col("freshness_days") > abort, "data too old")
              .when(F.col("freshness_days") > degraded, "data ageing").when(F.col("pit_warnings") > 0, "undisclosed rows")
              .otherwise("all checks passed"))
    return one.withColumns({"mode": mode, "reason": reason})


def data_health(df, asof, columns=("open", "high", "low", "close", "volume"), max_age=5):
    """Age of the newest row and the number of missing or non-finite values per column."""
    bad = [F.count(F.when(finite(F.col(c).cast("double")).isNull(), 1)).alias(f"bad_{c}") for c in columns]
    one = df.agg(F.coalesce(F.datediff(F.lit(asof).cast("date"), F.max("date")), F.lit(NO_DATA_AGE)).alias("age_days"), *bad)
    total = sum((F.col(f"bad_{c}") for c in columns[1:]), F.col(f"bad_{columns[0]}"))
    return one.withColumns({"stale": F.col("age_days") > max_age, "finite": total == 0})


# Name parts that give a label away.
LEAK_PARTS = ("fwd_", "forward_", "next_", "lead_", "future_")


def label_leaks(columns, features, label):
    """Feature names that are, or look like, the label. A check of names, not of rows."""
    found = [(f, "label_in_features") for f in features if f == label]
    found += [(f, "looks_forward") for f in features if f != label and any(p in f.lower() for p in LEAK_PARTS)]
    found += [(f, "missing") for f in features if f not in columns]
    return found


def split_leaks(train, test, purge_days, date="date"):
    """Overlap, a gap shorter than the purge, and reversed order of two date sets."""
    a = train.agg(F.min(date).alias("train_start"), F.max(date).alias("train_end"))
    b = test.agg(F.min(date).alias("test_start"), F.max(date).alias("test_end"))
    both = train.select(date).distinct().join(test.select(date).distinct(), date).agg(F.count(F.lit(1)).alias("shared_dates"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(both))
    gap = F.datediff("test_start", "train_end")
    from ..functions.columns import labels
    return one.withColumns({"gap_days": gap, "issues": labels(
        ("overlap", F.col("shared_dates") > 0), ("short_gap", (F.col("test_start") > F.col("train_end")) & (gap < purge_days)),
        ("reversed", F.col("test_end") < F.col("train_start")))})


def coverage_report(factors, delays):
    """Per factor: share of known values and the lag of the first one. delays: name -> days."""
    names = list(delays)
    start = F.min("date")
    aggs = [start.alias("_start")]
    for n in names:
        aggs += [F.avg(F.col(n).isNotNull().cast("double")).alias(f"_cov_{n}"), F.min(F.when(F.col(n).isNotNull(), F.col("date"))).alias(f"_first_{n}")]
    one = factors.agg(*aggs)   # one row
    rows = F.explode(F.array(*[F.struct(
        F.lit(n).alias("factor"), F.lit(delays[n]).alias("declared_delay"), F.col(f"_cov_{n}").alias("coverage"),
        F.datediff(f"_first_{n}", "_start").alias("observed_lag_days")) for n in names]))
    out = one.select(rows.alias("_r")).select("_r.*")
    return out.withColumn("is_consistent", F.col("observed_lag_days").isNull() | (F.col("observed_lag_days") >= F.col("declared_delay")))


def early_codes(factors, name, global_start, lookback_days=60):
    """Codes whose first known value precedes global_start by more than the lookback."""
    first = factors.where(F.col(name).isNotNull()).groupBy("code").agg(F.min("date").alias("first_date"))
    return first.where(F.col("first_date") < F.date_sub(F.lit(global_start).cast("date"), lookback_days))

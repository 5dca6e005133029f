"""Reading, building and writing panels: one row per (code, date)."""

from pyspark.sql import functions as F, types as T

from ..functions.columns import change_pct, exact_sum, finite, parse_date
from ..functions.rolling import lag

REQUIRED = ["code", "date", "open", "high", "low", "close", "volume"]

PANEL = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in
      ("open", "high", "low", "close", "volume", "amount")]])

FACTOR_LONG = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("factor_name", T.StringType()), T.StructField("factor_value", T.DoubleType())])

# Vendor column names and what they become.
VENDOR_NAMES = {"ts_code": "code", "trade_date": "date", "vol": "volume"}


def read_panel(spark, path, columns=None, start=None, end=None):
    """Daily panel from parquet; column choice and date range reach the scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df.select(*columns) if columns else df


def read_side_table(spark, path, schema=None):
    """Financial, capital-flow, top-list or shareholder table."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv_panel(spark, path, schema=PANEL):
    return spark.read.csv(path, header=True, schema=schema)


def read_factor_store(df, start, end, codes=None):
    """Long factor rows in a date range, with typed columns; unreadable values become NULL."""
    out = df.where(F.col("date").cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if codes is not None:
        out = out.where(F.col("code").isin(list(codes)))
    return out.select("code", F.col("date").cast("date").alias("date"), "factor_name",
                      F.col("factor_value").try_cast("double").alias("factor_value"))


def pivot_factors(long, names):
    """Long factor rows to one column per name; the names are given, so no extra scan."""
    return long.groupBy("code", "date").pivot("factor_name", list(names)).agg(F.first("factor_value"))


def unpivot_factors(wide, names):
    return wide.unpivot(["code", "date"], list(names), "factor_name", "factor_value")


def standardize_columns(df):
    """Vendor names to panel names, dates to DATE."""
    for old, new in VENDOR_NAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumn("date", parse_date("date"))


def accept_table(df, limit=9.9):
    """Check a caller's table and derive the columns the panel needs.

    Raises ValueError when a required column is missing.
    """
    if "ts_code" in df.columns and "code" not in df.columns:
        df = df.withColumnRenamed("ts_code", "code")
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    df = df.withColumn("date", parse_date("date"))
    if "change_pct" not in df.columns:
        base = F.col("pre_close") if "pre_close" in df.columns else lag("close")
        df = df.withColumn("change_pct", change_pct("close", base))
    if "is_limit_up" not in df.columns:
        df = df.withColumns({"is_limit_up": F.coalesce(F.col("change_pct") >= limit, F.lit(False)),
                             "is_limit_down": F.coalesce(F.col("change_pct") <= -limit, F.lit(False))})
    return df if "is_st" in df.columns else df.withColumn("is_st", F.lit(False))


def to_bars(ticks, code, date, price, volume, amount, order):
    """Raw rows to bars: first, highest, lowest and last price, summed volume and amount.

    One partial aggregation, so a code holding most rows is reduced before the shuffle.
    ``order`` is a Column (best of fixed width, see columns.packed_order) or a list of
    columns that orders the rows of a bar totally.
    """
    seq = F.struct(*[F.col(c) for c in order]) if isinstance(order, (list, tuple)) else order
    return (ticks.select(code.alias("code"), date.cast("date").alias("date"), finite(price).alias("_p"),
                         volume.alias("_v"), amount.alias("_a"), seq.alias("_s"))
            .groupBy("code", "date").agg(
                F.min_by("_p", "_s").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
                F.max_by("_p", "_s").alias("close"), F.sum("_v").cast("double").alias("volume"),
                exact_sum("_a").alias("amount")))


def write_panel(df, path, mode="overwrite"):
    """Parquet by year, clustered so that each year is written by few tasks."""
    (df.withColumn("year", F.year("date")).repartition("year", F.pmod(F.xxhash64("code"), F.lit(16)))
     .write.mode(mode).partitionBy("year").parquet(path))


BUCKETS = 64


def write_store(df, name, path, buckets=BUCKETS):
    """A panel as table ``name``: partitioned by year, bucketed by code, sorted by date within a code.

    Windows by code over the table need no exchange, and date ranges read only their years.
    ``path`` holds the files; the table can be opened again from there (``open_store``).
    """
    (df.withColumn("year", F.year("date")).repartition(buckets, "code").sortWithinPartitions("year", "code", "date")
     .write.mode("overwrite").partitionBy("year").bucketBy(buckets, "code").sortBy("code", "date").option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def open_store(spark, name, path, buckets=BUCKETS):
    """Register the files of ``write_store`` as table ``name`` in a session that does not know them."""
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name != "year"]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(f"CREATE TABLE {name} ({columns}, year INT) USING parquet PARTITIONED BY (year) CLUSTERED BY (code) SORTED BY (code, date) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def update_store(df, name, buckets=BUCKETS):
    """Replace the years that occur in ``df``; other years stay as they are."""
    table = df.sparkSession.table(name)
    rows = df.withColumn("year", F.year("date")).select(*table.columns).repartition(buckets, "code").sortWithinPartitions("year", "code", "date")
    conf, key = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(key)
    conf.set(key, "dynamic")        # insertInto does not take it as an option
    try:
        rows.write.mode("overwrite").insertInto(name)
    finally:
        conf.set(key, before)


def read_store(spark, name, columns=None, start=None, end=None):
    """Rows of a store in a date range; the range is passed on to its years."""
    df = spark.table(name)
    for bound, keep in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if bound is not None:
            day = F.lit(bound).cast("date")
            df = df.where(keep(F.col("date"), day) & keep(F.col("year"), F.year(day)))
    return df.select(*columns) if columns else df.drop("year")


def write_json(df, path, mode="overwrite"):
    df.write.mode(mode).json(path)


def sorted_output(df, *order):
    """Total order on output only, e.g. (code, date) or (date, code)."""
    return df.orderBy(*order)

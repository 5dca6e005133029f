"""Helpers shared by the operators of this folder."""

from contextlib import contextmanager

import pyspark.sql.functions as F


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(col="text"):
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def free_name(df, *names):
    """Column names that do not occur in ``df``: a clash gets underscores in front."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def without(df, *names):
    """``df`` less the columns an operator is about to add, whatever their case."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def with_row_key(df, name="row_key"):
    """A number per row, stable as long as the files read stay the same."""
    return df.withColumn(name, F.monotonically_increasing_id())


@contextmanager
def batch_rows(spark, rows):
    """Inside, Arrow batches hold at most ``rows`` rows: for tables whose rows are whole blocks. Run the work inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)

"""Session settings used by the bench and the tests; a cluster brings its own."""

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # window factors cost far more per byte than AQE assumes, so keep small partitions apart
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores="*", shuffle_partitions=8, app="panelyard"):
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("PANELYARD_DRIVER_MEMORY", "8g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    shared_folder(spark)
    return spark


def shared_folder(spark):
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without the
    setting is an error, because lost executors could not read a machine-local path.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df):
    """Write a table that later steps read several times to the shared folder.

    Lineage ends there, so a lost executor costs no recomputation, and Catalyst knows the
    size of what it reads back. The files stay until
    ``release`` or until the folder is cleaned.
    """
    path = f"{shared_folder(df.sparkSession)}/panelyard-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.stored_at = path
    for made in _made:
        made.append(stored)
    return stored


_made = []


@contextmanager
def scratch():
    """Tables that ``materialize`` stores inside are deleted at the end, unless taken from the list this gives."""
    made = []
    _made.append(made)
    try:
        yield made
    finally:
        _made[:] = [m for m in _made if m is not made]
        if made:
            release(*made)


def release(*tables):
    """Delete tables made by ``materialize`` that nothing will read again.

    Spark drops shuffle files when the driver has collected what refers to them, so a
    collection is asked for as well.
    """
    gone = {df.stored_at for df in tables}
    for made in _made:
        made[:] = [df for df in made if df.stored_at not in gone]
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    SparkSession.active()._jvm.System.gc()

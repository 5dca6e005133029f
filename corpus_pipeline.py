"""The corpus pipeline: five stages over ``documents``, each stored before the next begins."""

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import Window

from panelyard.llm import decontaminate, mixing, quality, sharding, simhash
from panelyard.session import materialize, scratch

SHARDS = 40


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark, docs, sf_dir):
    """Texts that the importance resampling rejects go."""
    return quality.keep_selected(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One row of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more; SimHash, then a prefix filter for the rest."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Texts that hold a passage of the benchmark go."""
    return decontaminate.drop_leaking(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """All rows, written in the order of the mix, which the next stage numbers."""
    return mixing.mix(docs).orderBy("slot", "offset").select(docs.columns)


def stored_order(docs):
    """``docs`` with ``mix_rank``: the row's place, from 0, in the files of the table, taken by name as they were written."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:       # not read from files
        docs = materialize(docs)
    named = docs.select(*[c for c in docs.columns if c != "mix_rank"], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # one row a file; longer numbers come later
    by_name = Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = named.groupBy("_file").agg(F.count("*").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(by_name), F.lit(0)).alias("_start"))
    return named.join(F.broadcast(starts), "_file").withColumn("mix_rank", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def sharding_stage(spark, docs, sf_dir):
    """All rows with their place in the mix, their shard and the version of the slot map that put them there."""
    placed = sharding.shard_documents(spark, stored_order(docs), SHARDS)
    return placed.select(*docs.columns, *[F.col(c) for c in ("mix_rank", "size", "text_crc32", "virtual_slot", "shard", "map_version") if c not in docs.columns])


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
# Gumbel draws, fingerprints and the balanced slot map have no SQL form; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch() as made:
            docs = materialize(stage(spark, docs, sf_dir))
            made[:] = [t for t in made if t is not docs]
    return docs

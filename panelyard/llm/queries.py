"""One query per operator, over whole tables."""

import pyspark.sql.functions as F

from . import collocations, decontaminate, impact, lines, media, mixing, quality, secrets, sharding, simhash, spelling, tokens, toxicity
from .common import read

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_mixing")
def op1_mixing(spark, sf_dir):
    """All documents in the order of the mix; targets: square roots of the sources' bytes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "mix_class", "block", "phase", "release", "deadline", "slot", "offset")


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_segments", "segments")


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard_positions(spark, docs, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


@query("op9_tokens")
def op9_tokens(spark, sf_dir):
    import public_tokenizers
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    return simhash.fingerprint_components(read(spark, sf_dir, "documents"))


@query("op7_decontaminate")
def op7_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op8_secrets", secrets.SQL)
def op8_secrets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.new_ledger(spark)
    secrets.update(spark, docs, ledger)
    return secrets.report(docs, secrets.findings(spark, ledger)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op5_quality")
def op5_quality(spark, sf_dir):
    table, _ = quality.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return table.select("doc_id", "n_grams", "ratio", "log_weight", "sort_key", "selected")


@query("op10_lines")
def op10_lines(spark, sf_dir):
    return lines.line_report(read(spark, sf_dir, "documents"))


@query("op4_media")
def op4_media(spark, sf_dir):
    images = media.render(read(spark, sf_dir, "embeddings"))
    found = media.copies(images)
    return found.select("image_id", F.floor(F.col("image_id") / 2).alias("vec_id"), (F.col("image_id") % 2 == 1).alias("edited"), "n_corners", "n_links", "component_id")


@query("op11_topk", impact.SQL)
def op11_topk(spark, sf_dir):
    return impact.top_k(read(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


@query("op12_collocations", collocations.SQL)
def op12_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query("op13_spelling", spelling.SQL)
def op13_spelling(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents").select("doc_id", "text"))

"""Secret scans over an incremental blob ledger.

A text version is a blob, named by its SHA-256. The ledger holds which (blob, rule version)
pairs were scanned and what was found in each. A run hashes every row, scans one copy of
each blob the ledger has not seen under the current rules, appends both tables, and joins
the findings back to every row that holds the blob. Only DataFrame functions are used.
"""

import uuid

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..session import shared_folder
from .common import without

RULE_VERSION = "1"
# Kind, pattern, group whose length is tested, least length.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
SCANNED = "blob string, rule_version string"
FINDINGS = "blob string, rule_version string, spans array<struct<start:long,rank:int,kind:string,end:long>>"
ADDED = ("blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def new_ledger(spark, folder=None):
    """An empty ledger: two tables in ``folder`` (default: a new one in the shared folder)."""
    folder = folder or f"{shared_folder(spark)}/blob-ledger-{uuid.uuid4().hex}"
    for name, schema in (("scanned", SCANNED), ("findings", FINDINGS)):
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(f"{folder}/{name}")
    return folder


def blobs(docs):
    """``docs`` with the blob of each text; a null text is the empty blob."""
    return without(docs, *ADDED).withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _matches(kind, pattern, group):
    """Per match of a kind: its kind, the characters before it since the last match, its length and the tested length."""
    rx = F.lit(pattern)
    pieces, whole = F.split("text", pattern, -1), F.regexp_extract_all("text", rx, F.lit(0))
    tested = F.regexp_extract_all("text", rx, F.lit(group)) if group else whole
    rows = F.transform(F.arrays_zip(pieces.alias("gap"), whole.alias("hit"), tested.alias("part")),
                       lambda r: F.struct(F.lit(kind).alias("kind"), F.length(r["gap"]).alias("gap"), F.length(r["hit"]).alias("size"), F.length(r["part"]).alias("part")))
    empty = F.array().cast("array<struct<kind:string,gap:int,size:int,part:int>>")
    return F.when(F.col("text").rlike(pattern), rows).otherwise(empty)


def scan(texts, rules=RULES):
    """Spans of (blob, text) rows as (blob, spans ordered by start and rule); blobs without spans are left out.

    A text cut at the matches of a pattern gives the gaps between them, so each match starts
    after the gaps and matches before it: a running sum per blob and kind.
    """
    hits = texts.filter(F.coalesce(F.greatest(*[F.col("text").rlike(p) for _, p, _, _ in rules], F.lit(False)), F.lit(False)))
    rows = hits.select("blob", F.posexplode(F.concat(*[_matches(k, p, g) for k, p, g, _ in rules]))).select("blob", "pos", "col.*")
    upto = Window.partitionBy("blob", "kind").orderBy("pos")
    least = F.create_map(*[F.lit(x) for k, _, _, n in rules for x in (k, n)])
    rank = F.create_map(*[F.lit(x) for i, (k, _, _, _) in enumerate(rules) for x in (k, i)])
    done = (rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto))
            .filter(F.col("part") >= least[F.col("kind")]).withColumn("start", F.col("end") - F.col("size")))
    span = F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end")
    return done.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def update(spark, docs, folder, version=RULE_VERSION, rules=RULES):
    """Scan the blobs of ``docs`` that the ledger lacks under ``version`` and append the outcome.

    Findings are written before the scanned pairs: a run that dies in between is repeated,
    and readers take one finding per blob, so the repeat changes nothing. Returns the new pairs.
    """
    seen = spark.read.schema(SCANNED).parquet(f"{folder}/scanned").filter(F.col("rule_version") == version)
    unseen = (blobs(docs).select("blob", F.coalesce("text", F.lit("")).alias("text"))
              .join(seen.select("blob"), "blob", "left_anti").dropDuplicates(["blob"]))
    batch = f"{folder}/batch-{uuid.uuid4().hex}"
    rules_of = scan(unseen, rules).select("blob", F.lit(version).alias("rule_version"), "spans")
    rules_of.write.mode("append").parquet(f"{folder}/findings")
    new = blobs(docs).select("blob").distinct().join(seen.select("blob"), "blob", "left_anti").select("blob", F.lit(version).alias("rule_version"))
    new.write.parquet(batch)
    new = spark.read.schema(SCANNED).parquet(batch)
    new.write.mode("append").parquet(f"{folder}/scanned")
    return new


def findings(spark, folder, version=RULE_VERSION):
    """One row per blob with spans."""
    return (spark.read.schema(FINDINGS).parquet(f"{folder}/findings").filter(F.col("rule_version") == version)
            .groupBy("blob").agg(F.first("spans").alias("spans")))


def report(docs, found):
    """``docs`` with the findings of their blobs: counts by kind, digest and list of spans.

    Rows without findings have zero counts, the digest of the empty string and an empty list.
    Every row is kept, repeated rows and rows without doc_id too.
    """
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))
    digest = found.select("blob", text.alias("_spans"), *[count(k) for k, _, _, _ in RULES])
    joined = blobs(docs).drop("text").join(digest, "blob", "left")
    return (joined.withColumns({f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)).cast("long") for k, _, _, _ in RULES})
            .withColumn("spans", F.coalesce("_spans", F.lit(""))).withColumn("base_sha256", F.sha2("spans", 256)).drop("_spans"))


def _sql_kind(kind, pattern, group, least):
    rx = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {[r[0] for r in RULES].index(kind)} AS rank, a, v, unnest(range(1, len(a) + 1)) AS i, p FROM (
 SELECT doc_id, regexp_split_to_array(t, '{rx}') AS p, regexp_extract_all(t, '{rx}', 0) AS a, regexp_extract_all(t, '{rx}', {group}) AS v FROM d)"""


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 m AS ({' UNION ALL '.join(_sql_kind(*r) for r in RULES)}),
 s AS (SELECT doc_id, kind, rank, list_sum(list_transform(p[1:i], lambda x: length(x)))
   + coalesce(list_sum(list_transform(a[1:i-1], lambda x: length(x))), 0) AS start, length(a[i]) AS n, length(v[i]) AS tested FROM m),
 f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
   count(*) FILTER (kind = 'hex') AS n_hex,
   string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM s WHERE tested >= CASE kind WHEN 'assign' THEN 6 WHEN 'access' THEN 20 ELSE 24 END GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id"""

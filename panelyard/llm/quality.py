"""Quality by importance resampling.

Two generative models, of the target (texts labelled good) and of all texts, are bags of
hashed word n-grams: unigrams and bigrams, where a token equal to the one before it becomes a
repeat mark. A text's importance weight is the ratio of its probability under the two, taken
to a fixed number of n-grams so that length does not decide. Adding Gumbel noise to the log
weights and taking the k largest draws k texts without replacement in proportion to their
weights. k is, unless given, the number of texts whose ratio passes the cut that best splits
the labelled texts.
"""

import pyspark.sql.functions as F

from ..session import materialize
from .common import free_name

BUCKETS = 1 << 16       # hashed n-grams of a model
SAMPLE = 30_000         # labelled rows used, by hashed order; all if there are fewer
EVIDENCE = 64           # n-grams a text's weight is taken to
KEEP_COST = 4           # a good text rejected counts as much as so many bad ones kept
MEMO = 300_000
KEY_BITS = 20           # binary places of the sort key


def gram_hasher():
    """Text to the bucket numbers of its unigrams and bigrams."""
    import re
    from zlib import crc32

    import numpy as np
    find, memo = re.compile(r"\w+|[^\w\s]+").findall, {}

    def grams(text):
        if len(memo) > MEMO:
            memo.clear()
        tokens = find(text.lower())
        codes = []
        for t in tokens:
            c = memo.get(t)
            if c is None:
                c = memo[t] = crc32(t.encode())
            codes.append(c)
        one = np.array(codes, np.uint64)
        if len(one) > 1:
            same = one[1:] == one[:-1]
            one[1:][same] = 1
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
        return np.concatenate([(one * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48), two]).astype(np.int64)
    return grams


def sampled_labels(labels, column="quality", sample=SAMPLE):
    """At most ``sample`` labelled ids, by hashed order: small enough to broadcast by construction."""
    return (labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col(column).cast("int").alias("label")))


def gram_counts(docs, few):
    """(bucket, n_all, n_target) over every text; the target ones are the sampled texts labelled 1."""
    def count(batches):
        import numpy as np
        import pyarrow as pa
        grams, every, target = gram_hasher(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                if text.is_valid:
                    n = np.bincount(grams(text.as_py()), minlength=BUCKETS)
                    every += n
                    if label == 1:
                        target += n
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(target[at])], ["bucket", "n_all", "n_target"])
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left").select("text", "label")
    return (rows.mapInArrow(count, "bucket long, n_all long, n_target long")
            .groupBy("bucket").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target")))


def log_ratios(counts):
    """log p_target / p_all per bucket with add-one smoothing; zeros without target texts."""
    import numpy as np
    got = counts.toPandas()
    every, target = np.ones(BUCKETS), np.ones(BUCKETS)
    every[got.bucket.to_numpy()] += got.n_all
    target[got.bucket.to_numpy()] += got.n_target
    if len(got) == 0 or got.n_target.sum() == 0:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(every / every.sum())


def _scores(keyed, key, ratios):
    """(key, doc_id, n_grams, ratio): mean log ratio per n-gram, 0 for texts without any."""
    shared = keyed.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        import pyarrow as pa
        grams, r = gram_hasher(), shared.value
        for b in batches:
            n, mean = [], []
            for text in b.column(2):
                g = grams(text.as_py()) if text.is_valid else ()
                n.append(len(g))
                mean.append(float(r[g].mean()) if len(g) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(mean, pa.float64())],
                                             [key, "doc_id", "n_grams", "ratio"])
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select(key, "doc_id", "text").mapInArrow(run, f"{key} long, doc_id {kind}, n_grams long, ratio double")


def best_cut(ratio, label):
    """The cut on the ratio with the least cost on labelled texts, the lowest such; no labels of both kinds: keep all."""
    import numpy as np
    if len(label) == 0 or label.min() == label.max():
        return float("-inf")
    order = np.argsort(ratio, kind="stable")
    r, y = ratio[order], label[order]
    rejected_good = np.concatenate([[0], np.cumsum(y == 1)])
    kept_bad = (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
    cost = KEEP_COST * rejected_good + kept_bad
    cost[1:-1][r[1:] == r[:-1]] = cost.max() + 1
    i = int(cost.argmin())
    return float("-inf") if i == 0 else float(r[i - 1] + r[i]) / 2 if i < len(r) else float("inf")


def kth_key(rows, k):
    """The k-th largest of the long column sort_key, by counts of ever finer ranges; None for k of 0."""
    if k <= 0:
        return None
    left, inside = k, F.lit(True)
    for shift in (KEY_BITS, KEY_BITS // 2, 0):
        bins = rows.filter(inside).groupBy(F.shiftright("sort_key", shift).alias("bin")).count().collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if r["count"] >= left:
                break
            left -= r["count"]
        else:
            return None
        inside = F.shiftright("sort_key", shift) == r["bin"]
    return r["bin"]


def resample(docs, labels, k=None, seed=7, column="quality"):
    """Score every text and draw k of them; returns (table, name of its row key).

    The table has, per row of ``docs``: the key, doc_id, n_grams, ratio, log_weight, sort_key
    and ``selected``. Rows with equal keys at the border are all drawn. Null and empty texts have the
    ratio 0; without labels of both kinds all are drawn; repeated rows have different noise
    unless k cuts none. The noise is a hash of the row, so a rerun draws the same rows.
    """
    key, = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    few = materialize(sampled_labels(labels, column))
    ratios = log_ratios(gram_counts(docs, few))
    scored = materialize(_scores(keyed, key, ratios))
    known = scored.join(F.broadcast(few), "doc_id").select("ratio", "label").limit(4 * SAMPLE).toPandas()
    cut = best_cut(known["ratio"].to_numpy(float), known["label"].to_numpy(int))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", key, F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    weight = F.col("ratio") * EVIDENCE
    table = scored.withColumn("log_weight", weight).withColumn(
        "sort_key", F.floor((weight - F.log(-F.log(u))) * (1 << KEY_BITS)).cast("long"))
    if k is None:
        k = scored.filter(F.col("ratio") >= cut).count()
    border = kth_key(table, k)
    return table.withColumn("selected", F.lit(False) if border is None else F.col("sort_key") >= border), key


def keep_selected(docs, labels, k=None, seed=7):
    """``docs`` with the drawn rows only."""
    table, key = resample(docs, labels, k, seed)
    return docs.withColumn(key, F.monotonically_increasing_id()).join(table.filter("selected").select(key), key, "left_semi").drop(key)

"""Toxic passages by maximum-scoring segment search.

Training: log-odds of a word between toxic and clean labelled texts, smoothed with Dirichlet
priors in a chain: the prior of a word is the estimate for its longest stem, whose prior is
that of the next shorter stem, down to the overall rate. Estimates live in a table of fixed
size by hash, so the model is bounded whatever the vocabulary.

Scoring: each word scores its log-odds less a drift that makes ordinary text fall. One linear
scan finds all maximal segments of positive score. Their scores follow an extreme-value law
under clean text, whose parameters come from the clean training texts; a document's evidence
is the sum of its segments' normalised scores above what its length explains. A logistic fit
turns it into a probability.
"""

import pyspark.sql.functions as F

from .common import free_name, without

SLOTS = 1 << 20         # entries of the model table
SAMPLE = 30_000         # labelled rows the model is fitted on, by hashed order; fewer than this are all used
PRIOR = 1.0             # Dirichlet pseudo-count of each estimate
DRIFT = 1.2             # subtracted from every word's log-odds
STEMS = (3, 4, 5, 6, 7)  # stem lengths that pass evidence on to unseen words
MEMO = 300_000
ADDED = ("score", "predicted", "n_segments", "segments")


def units(word):
    """Hashes of a word's stems, short to long, then of the word."""
    from zlib import crc32
    b = word.encode()
    return [crc32(b"%d:%b" % (k, word[:k].encode())) % SLOTS for k in STEMS if k < len(word)] + [crc32(b) % SLOTS]


def words_of():
    import re
    find = re.compile(r"[^\W_]+").findall
    return lambda text: find(text.lower())


def training_rows(docs, labels, column, sample=SAMPLE):
    """Texts with a 0/1 label: at most ``sample`` labelled rows, by hashed order. Text is not shuffled:
    the sampled labels are few by construction and are broadcast."""
    few = (labels.filter(F.col(column).isin(0, 1)).filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col(column).cast("int").alias("label")))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def unit_counts(rows):
    """Documents holding each unit: (slot, toxic, clean); slot -1 counts the documents themselves."""
    def count(batches):
        import numpy as np
        import pyarrow as pa
        words, n = words_of(), np.zeros((2, SLOTS), np.int64)
        total = [0, 0]
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                seen = {u for w in set(words(text.as_py() or "")) for u in units(w)}
                n[label][np.fromiter(seen, np.int64, len(seen))] += 1
                total[label] += 1
        at = np.flatnonzero(n[0] + n[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[1][at], total[1])), pa.array(np.append(n[0][at], total[0]))],
                                         ["slot", "toxic", "clean"])
    return (rows.select("text", "label").mapInArrow(count, "slot long, toxic long, clean long")
            .groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def unit_table(counts):
    """(toxic counts, clean counts scaled to what independence would give the toxic ones), as arrays of SLOTS entries."""
    import numpy as np
    got = counts.toPandas()
    own, docs = got[got.slot >= 0], got[got.slot < 0]
    n1, n0 = (float(docs.toxic.sum()), float(docs.clean.sum())) if len(docs) else (0.0, 0.0)
    toxic, clean = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)
    toxic[own.slot.to_numpy()] = own.toxic
    clean[own.slot.to_numpy()] = own.clean * (n1 / n0 if n0 else 0.0)
    return toxic, clean


def word_scorer(toxic, clean):
    """Word to score: the chain of Dirichlet estimates, as log-odds less the drift."""
    from math import log
    t, c = memoryview(toxic), memoryview(clean)

    def score(word):
        ratio = 1.0
        for u in units(word):
            ratio = (t[u] + PRIOR * ratio) / (c[u] + PRIOR)
        return log(ratio) - DRIFT if ratio > 0 else -9.0
    return score


def segments(scores):
    """All maximal scoring segments as (start, end, score), in one pass over the scores.

    Each is the best that contains it and cannot be lengthened or cut to gain; a stack of
    open segments with the totals at their ends makes the scan linear.
    """
    stack, total = [], 0.0          # (start, end, total before, total after)
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = i, before
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k -= 1
            if k < 0 or stack[k][3] >= total:
                stack.append((start, i + 1, low, total))
                break
            start, low = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, high - low) for a, b, low, high in stack]


def fit_extreme(scores, lengths):
    """(lam, k) of E = k n exp(-lam s) from the best segments of clean texts, by moments of the Gumbel law."""
    import numpy as np
    scores, lengths = np.asarray(scores, float), np.asarray(lengths, float)
    some = lengths > 0
    if some.sum() < 5 or scores[some].std() < 1e-6:
        return 1.0, 0.05
    # 90th percentile and median pin the tail: s = (ln(k n) - ln(-ln p)) / lam
    x = scores[some]
    lam = 1.0
    for _ in range(20):
        rest = x - np.log(lengths[some]) / lam
        spread = np.quantile(rest, 0.95) - np.quantile(rest, 0.5)
        lam = 0.5 * lam + 0.5 * min(5.0, max(0.3, (np.log(-np.log(0.5)) - np.log(-np.log(0.95))) / max(spread, 1e-3)))
    mid = np.quantile(x - np.log(lengths[some]) / lam, 0.5)
    return float(lam), float(np.exp(lam * mid + np.log(-np.log(0.5))))


def evidence(found, n, lam, k):
    """(best, sum) of the segments' normalised scores lam s - ln(k n); the sum takes the significant ones, each less
    the log of its rank, as chance alone gives further segments."""
    from math import log
    base = log(k * n) if n else 0.0
    rank = sorted((lam * s - base for _, _, s in found), reverse=True)
    return (max(rank[0], -5.0), sum(max(0.0, x + log(i + 1)) for i, x in enumerate(rank))) if rank else (-5.0, 0.0)


def logistic(x, y, steps=60, ridge=1e-3):
    """Weights (bias first) of a logistic fit by Newton steps."""
    import numpy as np
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def scan(model):
    """Function of a text: its words' segments, and the number of words."""
    words, memo, fresh = words_of(), {}, word_scorer(*model["table"])

    def one(text):
        found = words(text)
        if len(memo) > MEMO:
            memo.clear()
        values = []
        for w in found:
            s = memo.get(w)
            if s is None:
                s = memo[w] = fresh(w)
            values.append(s)
        return segments(values), len(found)
    return one


def fit(docs, labels, column="toxic", sample=SAMPLE):
    """Fit on the labelled rows. Without both labels the model scores every text 0.

    Words are scored for calibration as if the text itself had not been counted, so that a
    text's own words do not vouch for it.
    """
    import numpy as np
    spark = docs.sparkSession
    rows = training_rows(docs, labels, column, sample)
    table = unit_table(unit_counts(rows))
    shared = spark.sparkContext.broadcast(table)

    def own_scores(batches, give):
        import pyarrow as pa
        toxic, clean = shared.value
        t, c, words = memoryview(toxic), memoryview(clean), words_of()
        from math import log
        step = shared_step.value
        for b in batches:
            out = []
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                less1, less0, values, memo = (1.0, 0.0, [], {}) if label else (0.0, step, [], {})
                for w in words(text.as_py() or ""):
                    s = memo.get(w)
                    if s is None:
                        ratio = 1.0
                        for u in units(w):
                            ratio = (t[u] - less1 + PRIOR * ratio) / (c[u] - less0 + PRIOR)
                        s = memo[w] = log(max(ratio, 1e-4)) - DRIFT
                    values.append(s)
                out.append((label, len(values), *give(segments(values), len(values))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                                              pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.float64())],
                                             ["label", "n", "best", "total"])
    shared_step = spark.sparkContext.broadcast(float(_clean_step(table)))

    def passed(give):
        """label, n and the two numbers that ``give`` makes of all segments of each text."""
        return rows.select("text", "label").mapInArrow(lambda batches: own_scores(batches, give), "label int, n long, best double, total double").toPandas()
    got = passed(lambda found, n: (max((s for _, _, s in found), default=0.0), 0.0))
    y = got["label"].to_numpy()
    if len(got) == 0 or y.min() == y.max():
        return {"table": table, "lam": 1.0, "k": 0.05, "weights": None}
    clean = y == 0
    lam, k = fit_extreme(got["best"].to_numpy()[clean], got["n"].to_numpy()[clean])
    got = passed(lambda found, n: evidence(found, n, lam, k))
    return {"table": table, "lam": lam, "k": k, "weights": logistic(got[["best", "total"]].to_numpy(), got["label"].to_numpy()).tolist()}


def _clean_step(table):
    """What one clean text adds to the scaled clean counts: their least positive value."""
    clean = table[1]
    some = clean[clean > 0]
    return some.min() if len(some) else 0.0


def score(docs, model):
    """``docs`` with score, predicted, and the significant passages.

    ``score``: probability of the label, 0 without evidence or model. ``n_segments`` counts the
    passages expected less than once in 20 texts of this length; ``segments`` lists them as
    (first word, word after the last, score). A null text is scored as empty. Columns of the
    same names are replaced; rows are kept as they are, repeated or not.
    """
    docs = without(docs, *ADDED)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        from math import exp, log

        import pyarrow as pa
        m = shared.value
        one, w, lam, k = scan(m), m["weights"], m["lam"], m["k"]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32())]))
        for b in batches:
            p, passages = [], []
            for text in b.column(at):
                found, n = one(text.as_py() or "")
                if w is None:
                    p.append(0.0)
                else:
                    x = evidence(found, n, lam, k)
                    p.append(1 / (1 + exp(-max(-30.0, min(30.0, w[0] + w[1] * x[0] + w[2] * x[1])))))
                base = log(k * n) if n else 0.0
                passages.append([s for s in found if lam * s[2] - base > 3.0])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(names))], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()),
                 pa.array([len(x) for x in passages], pa.int32()),
                 pa.array([[{"start": s, "end": e, "score": v} for s, e, v in x] for x in passages], kind)],
                [*names, "score", "predicted", "n_segments", "segments"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int, n_segments int, segments array<struct<start:int,end:int,score:float>>")

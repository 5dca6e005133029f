"""Mixing sources to target weights by proportionate-fair scheduling.

The rows of a source are put in a hashed order and cut into blocks of equal bytes. Block i
of a source with weight w is released at slot floor(i / w) and due by ceil((i + 1) / w);
the released block with the earliest deadline runs next. After any number of slots each
source is less than one block away from its share.

Weights are rounded to whole quanta, so the schedule repeats after ``QUANTUM`` slots (or four
for each source, if that is more): it is worked out once per set of live sources and then
applied to any number of blocks as plain arithmetic. When a source runs out, a new phase
starts with the weights of the rest, so every row is kept and placed. Every source is
scheduled on its own; only the schedule passes the driver.
"""

from heapq import heapify, heappop, heappush

import pyspark.sql.functions as F
from pyspark.sql import Window

from .common import text_bytes, without

QUANTUM = 1024          # slots after which a schedule repeats; weights are multiples of 1/1024
SPARE = 4               # slots of a period for each live source, at least
BLOCK_BYTES = 64 * 1024
BUCKET_ROWS = 4096      # rows of a source that one task orders
SPANS = 4096            # ranges of blocks, about, by which the phases are looked up
REST = "(other sources)"
ADDED = ("mix_class", "block", "phase", "release", "deadline", "slot", "offset")


def quanta(weights, quantum=QUANTUM):
    """Whole shares that sum to ``quantum``, at least 1 each (largest remainders get the rest)."""
    total = sum(weights.values())
    exact = {s: w / total * quantum for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (-(exact[s] - int(exact[s])), s))
    for i in range(max(0, quantum - sum(out.values()))):
        out[order[i % len(order)]] += 1
    over, rank = sum(out.values()) - quantum, {s: i for i, s in enumerate(sorted(weights))}
    heap = [(exact[s] - out[s], -out[s], -rank[s], s) for s in out if out[s] > 1] if over > 0 else []
    heapify(heap)
    for _ in range(over):
        s = heappop(heap)[-1]
        out[s] -= 1
        if out[s] > 1:
            heappush(heap, (exact[s] - out[s], -out[s], -rank[s], s))
    return out


def pattern(shares, blocks=None):
    """{source: slots of its blocks} over one period: earliest deadline first among the released.

    With ``blocks``, it ends with the slot that uses up a source's last one.
    """
    period, done = sum(shares.values()), dict.fromkeys(shares, 0)
    out = {s: [] for s in shares}
    due = lambda s: (-(-(done[s] + 1) * period // shares[s]), -shares[s], s)
    ready, later = [due(s) for s in shares], []
    heapify(ready)
    for t in range(period):
        while later and later[0][0] <= t:
            heappush(ready, due(heappop(later)[1]))
        s = heappop(ready)[-1]
        out[s].append(t)
        done[s] += 1
        if blocks is not None and done[s] == blocks[s]:
            break
        if done[s] < shares[s]:
            heappush(later, (-(-done[s] * period // shares[s]), s))
    return out


def phases(blocks, weights, quantum=QUANTUM):
    """Rows (source, phase, first block, end block, first slot, share, period, slots of the pattern).

    A phase ends with the slot that uses up a source's last block. Sources without a block in a phase have no row.
    """
    left, first, start, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    phase = 0
    while left:
        shares = quanta({s: weights[s] for s in left}, max(quantum, SPARE * len(left)))
        period, at = sum(shares.values()), pattern(shares, left)
        length = sum(map(len, at.values()))
        if length == period:
            length = min((n - 1) // shares[s] * period + at[s][(n - 1) % shares[s]] + 1 for s, n in left.items())
        for s in list(left):
            used = length // period * shares[s] + sum(t < length % period for t in at[s])
            if used:
                out.append((s, phase, first[s], first[s] + used, start, shares[s], period, at[s]))
            first[s] += used
            left[s] -= used
            if left[s] == 0:
                del left[s]
        start, phase = start + length, phase + 1
    return out


def _table(spark, rows, fields):
    """Rows of the driver as a table: one for each source, or for each source and phase in which it has blocks."""
    import json
    names = [f.split()[0] for f in fields.split(", ")]
    schema = "array<struct<" + ", ".join(fields.split(", ")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), schema)))


def source_bytes(docs):
    """Bytes and rows of every source."""
    per = (docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("s"))
           .agg(F.sum(text_bytes() + 16).alias("bytes"), F.count("*").alias("rows")))
    return {r["s"]: (r["bytes"], r["rows"]) for r in per.collect()}


def tempered(totals, power=0.5):
    """Target weights: each source's share of the bytes, flattened by ``power``."""
    return {s: max(b, 1) ** power for s, (b, _) in totals.items()}


def mix(docs, weights=None, block_bytes=BLOCK_BYTES, quantum=QUANTUM):
    """Place every row of ``docs`` in the interleaved order.

    Adds the class it is weighted by, its block, the phase, the block's release slot, deadline
    and slot, and its byte offset inside the block: ordering by (slot, offset) gives the mix.
    ``weights`` maps sources to positive weights; sources not named share the weight given
    for REST (default: the least one), and a name that is no source is an error. Without
    ``weights`` every source has its own. A null source is the source ''. Rows longer than a
    block start in one block and leave the following ones empty. Repeated rows lie beside
    each other. An empty table gives an empty result. Columns of the same names are replaced.
    """
    spark, totals = docs.sparkSession, source_bytes(docs)
    weights = dict(weights or tempered(totals))
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if totals and (unknown := weights.keys() - totals.keys() - {REST}):
        raise ValueError(f"no such sources: {sorted(unknown)}")
    named = {s for s in totals if s in weights and s != REST}
    known = F.coalesce(F.col("source"), F.lit(""))
    klass = known if len(named) == len(totals) else F.when(known.isin(sorted(named)), known).otherwise(F.lit(REST)) if named else F.lit(REST)
    merged = {}
    for s, (b, n) in totals.items():
        c = s if s in named else REST
        merged[c] = tuple(map(sum, zip(merged.get(c, (0, 0)), (b, n))))
    weights.setdefault(REST, min(weights.values(), default=1))
    blocks = {c: -(-b // block_bytes) for c, (b, _) in merged.items()}
    shift = max(6, (sum(blocks.values()) // SPANS).bit_length())
    span = F.explode(F.sequence(F.shiftright("first_block", shift), F.shiftright(F.col("end_block") - 1, shift))).alias("_span")
    table = _table(spark, phases(blocks, weights, quantum), "mix_class string, phase int, first_block long, end_block long, first_slot long, share int, "
                   "period int, at array<int>").select("*", span)

    # a row's place among the bytes of its source: hashed order, cut into buckets that one task sorts
    buckets = _table(spark, [(c, -(-n // BUCKET_ROWS)) for c, (_, n) in merged.items()], "mix_class string, _buckets long")
    rows = (without(docs, *ADDED).withColumn("mix_class", klass).join(F.broadcast(buckets), "mix_class").withColumn("_hash", F.xxhash64("doc_id", "text"))
            .withColumn("_size", text_bytes() + 16)
            .withColumn("_bucket", F.shiftright(F.shiftrightunsigned("_hash", 33) * F.col("_buckets"), 31)).drop("_buckets"))
    sums = rows.groupBy("mix_class", "_bucket").agg(F.sum("_size").alias("_bytes"))
    before = sums.withColumn("_before", F.sum("_bytes").over(Window.partitionBy("mix_class").orderBy("_bucket")) - F.col("_bytes"))
    inside = Window.partitionBy("mix_class", "_bucket").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (rows.join(before.drop("_bytes"), ["mix_class", "_bucket"])
              .withColumn("_at", F.col("_before") + F.sum("_size").over(inside) - F.col("_size"))
              .withColumn("block", F.floor(F.col("_at") / block_bytes)).withColumn("offset", F.col("_at") % block_bytes)
              .withColumn("_span", F.shiftright("block", shift)))
    i = F.col("block") - F.col("first_block")
    return (placed.join(F.broadcast(table), ["mix_class", "_span"]).filter("block >= first_block AND block < end_block")
            .withColumn("release", F.col("first_slot") + F.floor(i * F.col("period") / F.col("share")))
            .withColumn("deadline", F.col("first_slot") + F.ceil((i + 1) * F.col("period") / F.col("share")))
            .withColumn("slot", F.col("first_slot") + F.floor(i / F.col("share")) * F.col("period")
                        + F.element_at("at", (i % F.col("share") + 1).cast("int")))
            .drop("_hash", "_size", "_bucket", "_before", "_at", "_span", "first_block", "end_block", "first_slot", "share", "period", "at"))

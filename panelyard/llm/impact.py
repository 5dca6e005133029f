"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors become integers and are packed into blocks. In a block, each dimension's postings are
ordered by value and cut into levels of ``STEP`` values. For a query the segments (dimension,
level) are processed by descending quantised impact, until the sums so far prove that only
few vectors can still be among the best; those are scored exactly. An impact is the product
of the query's and the vector's component less the least such product of the dimension, so
no impact is negative: the sum so far is a lower bound, and a dimension not yet seen adds at
most the present impact. The best exact scores of earlier blocks are carried on, so later
blocks stop sooner.

Queries are a stated set and meet all blocks: parts of about ``QUERIES`` queries are paired with
groups of vector blocks, a task holds one part and one vector block at a time, and a query
leaves a group with k rows.
"""

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..session import materialize, release
from .common import batch_rows

BLOCK = 8192            # vectors of a block on average
GROUP = 2               # vector blocks that a part of the queries meets one after the other
QUERIES = 512           # queries of a part on average
STEP = 8                # values of one level
ROUNDS = (0.2, 0.1, 0.0)    # shares of the impact range at which the bound is tried
FEW = 512               # so many possible members are scored exactly without another round
LIMIT = 1 << 24         # components beyond are cut to it, so that a score fits a long
UNITS = (("int32", 24), ("int64", 46))      # a sum and, in its upper bits, the dimensions seen
INDEX = "block long, ids array<long>, asks array<boolean>, dims int, vectors binary, postings binary"


def integer_vectors(vector):
    """floor(256 x) of every component, as integers; null where the vector is null or holds a null or non-finite value."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # cut before the cast, as a long cannot hold every double
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(LIMIT / 256)), F.lit(-LIMIT / 256)) * 256).cast("int")
    return F.when(sound, F.transform(vector, whole))


def build_index(rows, blocks):
    """The index of the rows (id, v, asks), stored: per block the ids, the vectors and every dimension's postings by value."""
    def build(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for block, ids, asks, vectors in zip(*b.columns):
                lists = vectors.as_py()
                dims = max(map(len, lists))
                x = np.zeros((len(lists), dims), np.int32)
                for i, v in enumerate(lists):
                    x[i, :len(v)] = v
                order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([ids.as_py()], pa.list_(pa.int64())), pa.array([asks.as_py()], pa.list_(pa.bool_())),
                                                  pa.array([dims], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())],
                                                 ["block", "ids", "asks", "dims", "vectors", "postings"])
    packed = (rows.withColumn("block", F.pmod(F.floor(F.rand(7) * (1 << 40)), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("id", "asks", "v")).alias("r"))
              .select("block", F.col("r.id").alias("ids"), F.col("r.asks").alias("asks"), F.col("r.v").alias("v")))
    with batch_rows(rows.sparkSession, 1):
        return materialize(packed.mapInArrow(build, INDEX))


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, np, ids, dims, vectors, postings):
        self.np, self.ids = np, ids
        self.x = np.frombuffer(vectors, np.int32).reshape(len(ids), dims)
        self.order = np.frombuffer(postings, np.int32).reshape(dims, len(ids))
        self.values = np.take_along_axis(self.x.T, self.order, axis=1).astype(np.int64)
        self.x = self.x.astype(np.int64)
        self.levels = []        # per dimension: starts of its levels, then the end; the least and the greatest value of each
        for v in self.values:
            level = v // STEP
            head = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))
            self.levels.append((np.append(head, len(v)), level[head] * STEP, level[head] * STEP + STEP - 1))

    def possible(self, q, k, floor):
        """Places of the vectors that can be among the ``k`` best of query ``q``, and the postings read.

        ``floor`` is a score that is reached k times elsewhere, or None. What ties with it stays.
        """
        np, size = self.np, len(self.x)
        dims = []               # dimension, query component, least product, range of the products, impact of each level
        for d in np.flatnonzero(q[:len(self.values)]):
            c, v, (_, low, high) = int(q[d]), self.values[d], self.levels[d]
            a, b = sorted((c * int(v[0]), c * int(v[-1])))
            dims.append((d, c, a, b - a, (c * high if c > 0 else c * low) - a))
        kind, bits = UNITS[sum(x[3] for x in dims) >= 1 << 24 or len(dims) > 127]
        if size <= max(FEW, k) or not dims or sum(x[3] for x in dims) >= 1 << bits:
            return np.arange(size), 0
        base, top = sum(x[2] for x in dims), max(x[3] for x in dims)
        bounds = np.array([int(top * r) for r in ROUNDS])
        # levels due at each bound: those of a greater impact
        due = [len(x[4]) - np.searchsorted(np.sort(x[4]), bounds, "right") for x in dims]
        seen, done, read = np.zeros(size, kind), [0] * len(dims), 0     # impact so far; above ``bits``, the dimensions seen
        for turn, bound in enumerate(bounds.tolist()):
            rest, large = 0, 0
            for i, (d, c, least, spread, _) in enumerate(dims):
                if spread <= bound:
                    rest += spread
                    continue
                large += 1
                now = int(due[i][turn])
                if now > done[i]:
                    starts = self.levels[d][0]
                    a, b = (starts[-1 - now], starts[-1 - done[i]]) if c > 0 else (starts[done[i]], starts[now])
                    step = self.values[d, a:b].astype(kind)
                    step *= c
                    step += (1 << bits) - least
                    seen[self.order[d, a:b]] += step
                    read, done[i] = read + int(b - a), now
            sure = (seen & ((1 << bits) - 1)).astype(np.int64) + base
            reach = sure + bound * (large - (seen >> bits)) + rest
            limit = int(np.partition(sure, size - k)[size - k])
            left = np.flatnonzero(reach >= (limit if floor is None else max(limit, floor)))
            if len(left) <= max(FEW, k):
                break
        return left, read


def search(index, k, blocks, queries):
    """(query_id, query_block, query_at, vec_id, score): the best of each query in each group of blocks, at least k where there are as many."""
    def ask(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for block, ids, asks, dims, vectors in zip(*b.columns):
                at = np.flatnonzero(np.array(asks.as_py(), bool))
                if len(at):
                    ids, x = ids.as_py(), np.frombuffer(vectors.as_py(), np.int32).reshape(-1, dims.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([[ids[i] for i in at]], pa.list_(pa.int64())),
                                                      pa.array([x[at].tobytes()], pa.binary())], ["query_block", "ats", "query_ids", "queries"])

    def answer(batches):
        import numpy as np
        import pyarrow as pa
        now, asked, best = None, [], []

        def out():
            flat = [(i, home, at, v, s) for (i, home, at, _), rows in zip(asked, best) for s, _, v in rows]
            cols = list(zip(*flat)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                              ["query_id", "query_block", "query_at", "vec_id", "score"])
        for b in batches:
            for row in zip(*b.columns):
                pair = (row[0].as_py(), row[1].as_py())
                if now != pair:
                    if now is not None:
                        yield out()
                    now, asked = pair, []
                    for part in row[2].as_py():
                        x = np.frombuffer(part["queries"], np.int32).reshape(len(part["ats"]), -1).astype(np.int64)
                        asked += [(i, part["query_block"], at, x[n]) for n, (i, at) in enumerate(zip(part["query_ids"], part["ats"]))]
                    best = [[] for _ in asked]
                here = row[3].as_py()
                block = Block(np, row[4].as_py(), row[5].as_py(), row[6].as_py(), row[7].as_py())
                for n, (_, home, at, q) in enumerate(asked):
                    rows, own = best[n], home == here
                    # one more in the home block, as the query's own row is no answer
                    left, _ = block.possible(q, k + own, rows[-1][0] if len(rows) == k and not own else None)
                    shared = min(len(q), block.x.shape[1])
                    scores = block.x[left, :shared] @ q[:shared]
                    ranked = [(s, block.ids[j] is None, block.ids[j]) for s, j in zip(scores.tolist(), left.tolist()) if not own or j != at]
                    best[n] = sorted(rows + ranked, key=lambda r: (-r[0], r[1], r[2] or 0))[:k]
        if now is not None:
            yield out()
    groups, parts = -(-blocks // GROUP), max(1, -(-queries // QUERIES))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = (index.select("block", "ids", "asks", "dims", "vectors").mapInArrow(ask, "query_block long, ats array<int>, query_ids array<long>, queries binary")
             .groupBy((F.col("query_block") % parts).cast("int").alias("part")).agg(F.collect_list(F.struct("query_block", "ats", "query_ids", "queries")).alias("asked"))
             .withColumn("g", number(groups)))
    held = index.select((F.col("block") % groups).cast("int").alias("g"), "block", "ids", "dims", "vectors", "postings").withColumn("part", number(parts))
    met = asked.join(held.hint("merge"), ["g", "part"]).select("g", "part", "asked", "block", "ids", "dims", "vectors", "postings")
    return met.mapInArrow(answer, "query_id long, query_block long, query_at int, vec_id long, score long")


def top_k(table, k, asks, key="vec_id", vector="embedding"):
    """The ``k`` rows with the highest inner products for each query: query_id, rank, vec_id, score.

    Components count as floor(256 x). Queries are the rows for which the column ``asks`` holds;
    every row but the query's own is a candidate, so a repeated row finds its twin and is
    answered twice. Ties go to the smaller id, null ids last. Vectors that are null or hold a
    null or non-finite component take no part; a shorter vector counts as filled up with zeros;
    components beyond 65536 count as 65536. With fewer than k candidates all are returned; an
    empty table gives no rows. Only ``key``, ``vector`` and what ``asks`` names are read.
    """
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), integer_vectors(vector).alias("v")).filter("v IS NOT NULL")
    n, queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(1, -(-n // BLOCK))
    index = build_index(rows, blocks)
    with batch_rows(spark, 4):
        found = materialize(search(index, k, blocks, queries))
    release(index)
    order = Window.partitionBy("query_block", "query_at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (
  SELECT vec_id, rowid AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM (SELECT *, row_number() OVER () AS rowid FROM embeddings)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""

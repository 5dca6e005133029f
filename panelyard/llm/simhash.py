"""Near-duplicates by SimHash and segment popcounts.

A fingerprint is cut into two-bit segments, and each segment is replaced by the number of its
set bits. The Manhattan distance of two such vectors never exceeds the Hamming distance of
the fingerprints, so a grid over the vectors finds every close pair: whenever the vectors
differ by at most 4, at least 4 of 8 groups of segments agree exactly, so the pair shares one
of the 70 cells made of 4 groups. Pairs in a cell are checked for Manhattan distance, then
for Hamming distance.

Cells of many near copies are never expanded into pairs. Every member is compared with its
cell's least and greatest fingerprint; the components of these links are contracted; what is
left are pairs of different components, of which one side is outside the cell's largest
component. No link between components is lost.
"""

from itertools import combinations

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..session import materialize, release, scratch
from .common import free_name, without
from .components import components

RADIUS = 4
GROUPS = 8              # of four two-bit segments each
SEED = 42
SKETCH = 8              # 64-bit words of a shingle set's parities
SAMPLE = 20_000         # texts whose shingles are counted to tell common ones
COMMON = 1 << 16        # shingles known as common
ODD = 0x5555555555555555


def shingle_hasher(words):
    """Bytes of a text to the XXH64 values of its word shingles, repeats included.

    A-Z is lowered; words end at space, tab, newline, vertical tab, form feed and carriage
    return. Fewer words than a shingle make one shingle, none makes none.
    """
    import numpy as np
    from xxhash import xxh64_intdigest
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def hashes(text):
        found = text.translate(lower).split()
        n, joined = len(found), b" ".join(found)
        if n <= words:
            return [xxh64_intdigest(joined, SEED)] if n else []
        size = np.fromiter(map(len, found), np.int64, n)
        end = np.cumsum(size + 1) - 1
        start = (end - size)[:n - words + 1].tolist()
        return [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(start, end[words - 1:].tolist())]
    return hashes


def majority(values, counts):
    """Fingerprints (uint64) of consecutive runs of hashes; ``counts`` has the length of each run, none 0.

    Bits are counted eight at a time in the bytes of 64-bit sums over at most 255 hashes.
    """
    import numpy as np
    counts = np.asarray(counts, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    parts = -(-counts // 255)
    owner_first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    cuts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(owner_first, parts))
    out = np.zeros(len(counts), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((values >> np.uint64(shift)) & np.uint64(0x0101010101010101), cuts)
        bits = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner_first, axis=0)
        more = (2 * bits > counts[:, None]).astype(np.uint64)
        for byte in range(8):
            out |= more[:, byte] << np.uint64(8 * byte + shift)
    return out


def fingerprint_column(docs, words, parts=1, block=2_000_000):
    """``docs`` (without the text) and fp0, fp1, ...: 64-bit fingerprints, zero for texts without words.

    Further parts mix the shingle hashes anew. Work is cut at ``block`` shingles; a longer text is one block.
    """
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        hashes = shingle_hasher(words)

        def settle(values, counts):
            counts = np.array(counts, np.int64)
            out, some = np.zeros((parts, len(counts)), np.uint64), counts > 0
            if some.any():
                v = np.concatenate(values)
                for p in range(parts):
                    if p:
                        v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * p)
                        v ^= v >> np.uint64(29)
                    out[p, some] = majority(v, counts[some])
            return out
        for b in batches:
            done, values, counts, pending = [], [], [], 0
            for text in b.column(len(keep)):
                h = hashes(text.as_py().encode()) if text.is_valid else []
                values.append(np.array(h, np.uint64))
                counts.append(len(h))
                pending += len(h)
                if pending > block:
                    done.append(settle(values, counts))
                    values, counts, pending = [], [], 0
            if counts:
                done.append(settle(values, counts))
            fp = np.concatenate(done, axis=1) if done else np.zeros((parts, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *[pa.array(fp[p].view(np.int64)) for p in range(parts)]],
                                             [*keep, *[f"fp{p}" for p in range(parts)]])
    rows = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, ", ".join(filter(None, [fields, *[f"fp{p} long" for p in range(parts)]])))


def popcounts(fp):
    """Segment popcounts in unary code, two bits a segment: Manhattan distance is the bit count of an xor."""
    low, high = fp.bitwiseAND(F.lit(ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def hamming(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def grid_cells(fingerprints, radius=RADIUS, groups=GROUPS):
    """(cell, fp): the cells of each fingerprint, one for each choice of groups that two close vectors must share."""
    width = 64 // groups
    masks = [_signed(sum((((1 << width) - 1) << (width * g)) for g in some)) for some in combinations(range(groups), groups - radius)]
    vector = popcounts(F.col("fp"))
    cells = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.xxhash64(m, F.col("_v").bitwiseAND(m)))
    return fingerprints.withColumn("_v", vector).select(F.explode(cells).alias("cell"), "fp")


def close_links(fingerprints, radius=RADIUS, groups=GROUPS):
    """Links (a, b) whose components are those of all pairs within ``radius`` bits; ``fingerprints`` are distinct."""
    near = lambda a, b: (F.bit_count(popcounts(F.col(a)).bitwiseXOR(popcounts(F.col(b)))) <= radius) & (hamming(a, b) <= radius)
    whole = Window.partitionBy("cell")
    live = materialize(grid_cells(fingerprints, radius, groups).withColumn("low", F.min("fp").over(whole))
                       .withColumn("high", F.max("fp").over(whole)).filter("low <> high"))
    ends = F.array_compact(F.array(*[F.when((F.col("fp") != F.col(e)) & near("fp", e), F.col(e)) for e in ("low", "high")]))
    star = materialize(live.select(F.col("fp").alias("a"), F.explode(ends).alias("b")).distinct())
    roots = components(star)
    member = (live.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("cell", "fp", F.coalesce("root", "fp").alias("root")))
    sizes = member.groupBy("cell", "root").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1")
             .select("cell", F.col("m.root").alias("main")))
    left = member.join(mixed, "cell").filter("root <> main").select("cell", F.col("fp").alias("a"), F.col("root").alias("root_a"))
    right = member.select("cell", F.col("fp").alias("b"), F.col("root").alias("root_b"))
    rest = left.join(right, "cell").filter("root_a <> root_b").filter(near("a", "b")).select("a", "b").distinct()
    return star.unionByName(rest)


def link_fingerprints(rows, radius=RADIUS, groups=GROUPS):
    """``rows`` (doc_id, fp, ...) with component_id: the least doc_id reachable over links, null if all are null."""
    rows = without(rows, "component_id")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    own = materialize(own)
    roots = components(close_links(own.select("fp"), radius, groups)).withColumnRenamed("node", "fp")
    labelled = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(labelled.join(least, "root").select("fp", "component_id"), "fp")


def fingerprint_components(docs, words=4, radius=RADIUS, groups=GROUPS):
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs`` (doc_id, text).

    Null and blank texts have fingerprint zero and link like any other. Repeated rows come
    back repeated. An empty table gives an empty result. Other columns are left out.
    """
    rows = materialize(fingerprint_column(docs.select("doc_id", "text"), words).withColumnRenamed("fp0", "fp"))
    return link_fingerprints(rows, radius, groups).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(pairs, words, similarity):
    """Pairs (a, b) whose texts have a Jaccard similarity of word shingles of at least ``similarity``."""
    def run(batches):
        import pyarrow as pa
        hashes = shingle_hasher(words)
        for b in batches:
            keep, last, shingles = [], None, None
            for i, (a, x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3))):
                if a != last:
                    last, shingles = a, set(hashes((x.as_py() or "").encode()))
                other = set(hashes((y.as_py() or "").encode()))
                both = len(shingles & other)
                if both >= similarity * (len(shingles) + len(other) - both) or shingles == other:
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def common_shingles(docs, words, sample=SAMPLE, most=COMMON):
    """The ``most`` most frequent shingles of about ``sample`` texts and their counts, sorted by shingle.

    They only decide which shingles of a text come last, so the sample changes the work, not the result.
    """
    import numpy as np
    every = max(1, docs.count() // sample)

    def run(batches):
        import pyarrow as pa
        hashes = shingle_hasher(words)
        for b in batches:
            for text in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(set(hashes(text.as_py().encode()))), np.uint64).view(np.int64))], ["shingle"])
    some = docs.filter((F.pmod(F.xxhash64("row_key"), F.lit(every)) == 0) & F.col("text").isNotNull())
    counts = some.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "shingle").limit(most).collect()
    shingle = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], np.array([r["n"] for r in top], np.int64)[order]


def shingle_sets(docs, words, similarity, common):
    """``docs`` (without the text) with what stands for the set of a text's shingles.

    h0, h1: hash of the set; size; fp: its SimHash; s0, s1, ...: parity of the number of shingles
    in each of 64 * SKETCH classes, so that two sets differ in at least as many shingles as their
    parities in bits; wide: the same for sets of more shingles than that, in as many classes
    as shingles (a power of two), null for others; prefix: the first shingles, rare ones first. Two
    sets with the wanted similarity share a shingle of their prefixes.
    """
    keep = [c for c in docs.columns if c != "text"]
    names = ["h0", "h1", "size", "fp", *[f"s{i}" for i in range(SKETCH)], "wide", "prefix"]
    shift = 64 - (64 * SKETCH).bit_length() + 1

    def run(batches):
        from math import ceil

        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest
        hashes = shingle_hasher(words)
        known, often = common
        for b in batches:
            ids, size, fp, sketch, wide, prefix = [], [], [], [np.zeros((0, SKETCH), np.int64)], [], [np.zeros(0, np.uint64)]
            for text in b.column(len(keep)):
                s = np.unique(np.array(hashes(text.as_py().encode()) if text.is_valid else [], np.uint64))
                n = len(s)
                ids.append(xxh3_128_digest(s.tobytes()))
                size.append(n)
                fp.append(majority(s, [n])[0] if n else np.uint64(0))
                classes = 1 << (n - 1).bit_length()
                wide.append(np.packbits((np.bincount((s & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1).astype(np.uint8)).tobytes()
                            if n > 64 * SKETCH else None)
                sketch.append(np.packbits((np.bincount((s >> np.uint64(shift)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)[None])
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
                prefix.append(s[:n - ceil(similarity * n - 1e-9) + 1])
            ids = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            sketch = np.concatenate(sketch)
            ends = np.cumsum([0, *map(len, prefix[1:])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(size, pa.int32()),
                                              pa.array(np.array(fp, np.uint64).view(np.int64)), *[pa.array(sketch[:, i]) for i in range(SKETCH)], pa.array(wide, pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix).view(np.int64)))], [*keep, *names])
    rows = docs.select(*keep, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "h0 long, h1 long, size int, fp long", *[f"s{i} long" for i in range(SKETCH)], "wide binary, prefix array<long>"]))


def _may_be_similar(pairs, similarity):
    """Pairs (a, b) whose wide parities (null: not known) leave the wanted similarity possible; the finer one is folded."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            keep = []
            for i, (x, y, total) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))):
                if x is not None and y is not None:
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    while len(x) != len(y):
                        x, y = (x, y) if len(x) > len(y) else (y, x)
                        x = x[:len(x) // 2] ^ x[len(x) // 2:]
                    if np.bitwise_count(x ^ y).sum(dtype=np.int64) > total * ((1 - similarity) / (1 + similarity)) + 1e-6:
                        continue
                keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return pairs.select("a", "b", "wide_a", "wide_b", "total").mapInArrow(run, "a long, b long")


def near_duplicates(docs, words=5, similarity=0.8):
    """Row keys (monotonically_increasing_id of ``docs``) of one row of each group of near-duplicate texts.

    A node stands for the rows with one set of shingles. SimHash comes first: nodes of one
    fingerprint meet their least, fingerprints within RADIUS bits (``close_links``, by segment
    popcounts) meet by their least nodes. What it cannot reach follows exactly: nodes that
    share a shingle of their prefixes lie in one cell, and every pair with the wanted similarity
    does. Each node meets the member of its cells that shares most with others, then that of
    each cell; the components of all links are contracted, and all pairs of different components
    that are left in a cell are compared, where the places of the shared shingle leave enough
    shingles behind and it is their first one. Parities of the sets rule pairs out, the Jaccard
    similarity of the texts' shingles decides every pair: none is missed. The kept row of a
    group is the one with the least doc_id (a row without doc_id only if there is no other).
    Texts without words form one group.
    """
    keyed = docs.select("doc_id", "text").withColumn("row_key", F.monotonically_increasing_id())
    signed = materialize(shingle_sets(keyed, words, similarity, common_shingles(keyed, words)))
    first = signed.groupBy("h0", "h1").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("first"))
    node = materialize(signed.join(first.select("first", F.col("first.row_key").alias("row_key")), "row_key").drop("doc_id", "h0", "h1")
                       .withColumnRenamed("row_key", "node"))
    release(signed)
    parity = [f"s{i}" for i in range(SKETCH)]
    sketch = node.select("node", "size", F.struct(*parity).alias("s"))
    wide = node.filter("wide IS NOT NULL").select("node", "wide")

    def most(a, b):
        """Sets of the wanted similarity differ in at most (1 - s) / (1 + s) of their summed sizes."""
        return (F.col(f"size_{a}") + F.col(f"size_{b}")) * ((1 - similarity) / (1 + similarity)) + 1e-6

    def possible(a, b):
        apart = sum(F.bit_count(F.col(f"s_{a}.{x}").bitwiseXOR(F.col(f"s_{b}.{x}"))) for x in parity)
        return (F.abs(F.col(f"size_{a}") - F.col(f"size_{b}")) <= most(a, b)) & (apart <= most(a, b))

    def side(rows, name):
        return rows.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("s").alias(f"s_{name}"))

    def sketched(pairs):
        """Of different pairs (a, b, others), what both sketches leave."""
        near = pairs.join(side(sketch, "a"), "a").join(side(sketch, "b"), "b").filter(possible("a", "b"))
        return widely(near.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("total")))

    def widely(near):
        for x in ("a", "b"):
            near = near.join(wide.select(F.col("node").alias(x), F.col("wide").alias(f"wide_{x}")), x, "left")
        return _may_be_similar(near, similarity)

    def verified(some):
        """Pairs whose texts decide for them; the texts travel once for each side of a pair."""
        some = materialize(some.select("a", "b"))
        involved = some.select(F.explode(F.array("a", "b")).alias("row_key")).distinct()
        texts = materialize(keyed.select("row_key", "text").join(involved, "row_key", "left_semi"))
        found = materialize(_similar(some.join(texts.select(F.col("row_key").alias("b"), F.col("text").alias("text_b")), "b")
                                     .join(texts.select(F.col("row_key").alias("a"), F.col("text").alias("text_a")), "a"), words, similarity))
        release(some, texts)
        return found

    def rooted(rows, roots, *names):
        for x in names:
            rows = (rows.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
                    .withColumn(f"root_{x}", F.coalesce(f"root_{x}", x)))
        return rows

    def joined(links):
        """Components of the links so far; the tables of the rounds go."""
        with scratch() as made:
            roots = components(links)
            kept = materialize(roots)
            made[:] = [t for t in made if t is not kept]
        return kept

    # within RADIUS bits of each other
    own = materialize(node.groupBy("fp").agg(F.min("node").alias("b")))
    with scratch() as made:
        close = close_links(own.select("fp"))
        for x, y in (("a", "x"), ("b", "y")):
            close = close.join(own.select(F.col("fp").alias(x), F.col("b").alias(y)), x).drop(x)
        equal = node.select(F.col("node").alias("a"), "fp").join(own, "fp").filter("a <> b").select("a", "b")
        links = materialize(sketched(equal.unionByName(close.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())))
        made[:] = [t for t in made if t is not links]
    links = verified(links)
    roots = joined(links)

    # members of one cell
    live = materialize(node.select("node", "size", F.posexplode("prefix").alias("j", "cell"))
                       .withColumn("n", F.count("*").over(Window.partitionBy("cell"))).filter("n > 1"))
    shared = live.groupBy("node").agg(F.sum("n").alias("score"))
    hub = live.join(shared, "node").groupBy("cell").agg(F.max(F.struct("score", "node")).alias("hub"))
    met = live.join(hub, "cell").filter("node <> hub.node").groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.max("hub.score").alias("score"))
    met = materialize(rooted(met, roots, "a", "b").filter("root_a <> root_b").select("a", "b", "score"))
    pairs = materialize(sketched(met).join(met, ["a", "b"]))
    best = pairs.groupBy("a").agg(F.max(F.struct("score", "b")).alias("m")).select("a", "m.b")
    links = materialize(links.unionByName(verified(best)))
    again = rooted(pairs.join(best, ["a", "b"], "left_anti"), joined(links), "a", "b").filter("root_a <> root_b")
    links = materialize(links.unionByName(verified(again)))
    roots = joined(links)

    # what is left: pairs of different components in a cell, one side outside the cell's largest component
    member = rooted(live.select("cell", "node", "j"), roots, "node").withColumnRenamed("root_node", "root")
    sizes = member.groupBy("cell", "root").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("cell", F.col("m.root").alias("main")))
    member = materialize(member.join(mixed, "cell").withColumn("before", F.lag("cell").over(Window.partitionBy("node").orderBy("j"))).join(sketch, "node"))
    part = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("root", "size", "s", "j", "before")]
    left = member.filter("root <> main").select("cell", F.col("node").alias("a"), *part("a"))
    right = member.select("cell", F.col("node").alias("b"), *part("b"))
    total = F.col("size_a") + F.col("size_b")
    behind = F.least(F.col("size_a") - F.col("j_a"), F.col("size_b") - F.col("j_b")) >= total * (similarity / (1 + similarity)) - 1e-6
    # an equal mixed cell before this one shows that this is not the first they share
    rest = (left.join(right, "cell").filter((F.col("root_a") != F.col("root_b")) & behind & ~F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False)))
            .filter(possible("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), total.alias("total")).distinct())
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(widely(rest).join(known, ["a", "b"], "left_anti"))
    release(live, member, met)
    roots = joined(links.unionByName(verified(rest)))
    labelled = rooted(node.select("node", "first"), roots, "node")
    return labelled.groupBy("root_node").agg(F.min("first").alias("best")).select("best.row_key")


def drop_near_duplicates(docs, words=5, similarity=0.8):
    """``docs`` with one row of each near-duplicate group."""
    key, = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    with scratch() as made:
        kept = materialize(near_duplicates(docs, words, similarity))
        made[:] = [t for t in made if t is not kept]
    kept = kept.withColumnRenamed("row_key", key)
    return keyed.join(kept, key, "left_semi").drop(key)

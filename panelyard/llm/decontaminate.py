"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item is cut into windows that overlap by half. If a text region is within k edits
of a window of m bytes, the two share at least m + 1 - q (k + 1) q-grams whose diagonals
(text place less window place) lie in a band of k + 1, hence in one of the overlapping bands
of twice that width. Three steps: a hashed table of all windows' q-grams marks the text
places that can match at all, and stretches with too few marks are dropped; shared q-grams
of the rest are counted per window and diagonal band; bands that reach the bound are aligned
inside the band, exactly.

The benchmark is the query side. Its index is cut into blocks of at most ``BLOCK_BYTES`` of
text, each of which passes over all documents, so tasks hold a bounded index.
"""

from functools import reduce

import pyspark.sql.functions as F

Q = 8
WINDOW = 96             # bytes of a window; shorter items are one window
LEAST = 40              # shorter items say nothing and match nothing
EDITS = 0.06            # edits allowed in a window, as a share of its bytes
TABLE_BITS = 22
BLOCK_BYTES = 2_000_000


def normal(text):
    """Bytes compared: UTF-8 with A-Z lowered and control white space as space; places stay the same."""
    return text.translate(bytes.maketrans(bytes(range(65, 91)) + b"\t\n\v\f\r", bytes(range(97, 123)) + b"     "))


def windows(item):
    """(start, end) of an item's windows: half overlapping, the last one flush with the end."""
    n = len(item)
    if n < LEAST:
        return []
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, WINDOW // 2)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def grams(data):
    """The q-gram at each place of a byte array, as one 64-bit number."""
    import numpy as np
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    view = np.lib.stride_tricks.as_strided(data, (len(data) - Q + 1, Q), (1, 1))
    return np.ascontiguousarray(view).view(np.uint64).ravel()


def spread(g):
    import numpy as np
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def build_index(items):
    """Index of (item_id, normalised bytes): windows, and the sorted q-grams with their windows and places."""
    import numpy as np
    spans, gram, owner, place = [], [], [], []
    for item_id, data in items:
        g = grams(np.frombuffer(data, np.uint8))
        for s, e in windows(data):
            n = e - s - Q + 1
            gram.append(g[s:s + n])
            owner.append(np.full(n, len(spans), np.int64))
            place.append(np.arange(n))
            spans.append((item_id, s, e, data[s:e]))
    table = np.zeros(1 << TABLE_BITS, bool)
    if not spans:
        return {"spans": [], "table": table, "gram": np.zeros(0, np.uint64), "owner": np.zeros(0, np.int64), "place": np.zeros(0, np.int64)}
    gram, owner, place = map(np.concatenate, (gram, owner, place))
    order = np.argsort(gram, kind="stable")
    sizes = sorted({e - s for _, s, e, _ in spans})
    classes = [[m for m in sizes if low <= m < low + 16] for low in range(LEAST, WINDOW + 1, 16)]
    stretches = [(min(budget(m)[1] for m in c), max(m + budget(m)[0] for m in c)) for c in classes if c]
    table[spread(gram)] = True
    return {"spans": spans, "table": table, "gram": gram[order], "owner": owner[order], "place": place[order], "stretches": stretches}


def budget(m):
    """(edits, shared q-grams needed) for a window of m bytes."""
    k = int(m * EDITS)
    while k and m + 1 - Q * (k + 1) < 1:
        k -= 1
    return k, m + 1 - Q * (k + 1)


def aligned(pattern, text, at, k):
    """Least edit distance of ``pattern`` and a region of ``text`` near ``at`` if at most k, with the region; else None.

    Dynamic programming over the diagonals at - 2k - 1 to at + 2k + 1; the region may start and end anywhere in the band.
    """
    import numpy as np
    n, width = len(pattern), 4 * k + 3
    base = at - 2 * k - 1
    if base >= 0 and text.startswith(pattern, at):
        return 0, at, at + n
    if k == 0:
        p = text.find(pattern, max(0, base), base + width + n)
        return (0, p, p + n) if p >= 0 else None
    big, row, first = n + 1, np.zeros(width, np.int64), np.arange(width) + base
    data = np.frombuffer(text, np.uint8)
    row[(first < 0) | (first > len(text))] = big
    steps = np.arange(width)
    for i in range(n):
        col = first + i
        valid = (col >= 0) & (col < len(data))
        same = np.zeros(width, bool)
        same[valid] = data[col[valid]] == pattern[i]
        replaced = np.where(valid, row + ~same, big)
        deleted = np.append(row[1:] + 1, big)
        new = np.minimum(replaced, deleted)
        new = np.minimum.accumulate(new - steps) + steps
        outside = (col + 1 < 0) | (col + 1 > len(data))
        new[outside] = big
        row = new
        if row.min() > k:
            return None
    best = int(row.argmin())
    end = min(len(text), int(first[best]) + n)
    return int(row[best]), max(0, end - n), end


def marked(data, ends, index):
    """Numbers of the concatenated texts that hold a stretch with enough q-grams known to the index.

    Windows of like size share a test: the least bound among them within the longest reach.
    """
    import numpy as np
    if len(data) < Q:
        return []
    total = np.concatenate([[0], np.cumsum(index["table"][spread(grams(data))], dtype=np.int32)])
    high = np.zeros(len(total), bool)
    for need, reach in index["stretches"]:
        high[:-reach] |= total[reach:] - total[:-reach] >= need
        high[-reach:] |= total[-1] - total[-reach:] >= need
    return np.unique(np.searchsorted(ends, np.flatnonzero(high), side="right")).tolist()


def matches(text, index):
    """Windows found in one normalised text: (span number, distance, start, end), each once, the best band first."""
    import numpy as np
    g = grams(np.frombuffer(text, np.uint8))
    at = np.flatnonzero(index["table"][spread(g)])
    left = np.searchsorted(index["gram"], g[at], side="left")
    count = np.searchsorted(index["gram"], g[at], side="right") - left
    at, left, count = at[count > 0], left[count > 0], count[count > 0]
    if not len(at):
        return []
    rows = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    text_at = np.repeat(at, count)
    owner, diagonal = index["owner"][rows], text_at - index["place"][rows] + WINDOW
    limits = [budget(e - s) for _, s, e, _ in index["spans"]]
    k = np.array([x[0] for x in limits])[owner]
    need = np.array([x[1] for x in limits])
    out, done = [], set()
    for half in (0, 1):     # bands of width 2 (k + 1), shifted by half: one holds all of a band of k + 1
        band = (diagonal + half * (k + 1)) // (2 * (k + 1))
        key = owner * (len(text) + 4 * WINDOW) + band
        found, first, n = np.unique(key, return_index=True, return_counts=True)
        for f, c in zip(first[n >= need[owner[first]]], n[n >= need[owner[first]]]):
            own = int(owner[f])
            mine = diagonal[key == key[f]] - WINDOW
            out.append((own, int(np.median(mine)), int(c)))
    got = []
    for own, place, _ in sorted(out, key=lambda x: (x[0], -x[2])):
        if own not in done:
            hit = aligned(index["spans"][own][3], text, place, limits[own][0])
            if hit:
                done.add(own)
                got.append((own, *hit))
    return got


def find_leaks(docs, benchmark):
    """(doc_id, item_id, n_windows, distance, start, end): the benchmark items whose windows occur in each text.

    A row per (row of ``docs``, item): how many of the item's windows occur, the least
    distance among them and the bytes of the text they cover. Null, empty and clean texts
    give no row; null or short items match nothing; repeated rows repeat their findings.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    found = []
    for block in range(max(1, blocks)):
        mine = benchmark.filter(F.col("text").isNotNull() & (part == block)).select("item_id", "text")
        index = build_index([(r["item_id"], normal(r["text"].encode())) for r in mine.orderBy("item_id", "text").collect()])
        found.append(_scan(docs, spark.sparkContext.broadcast(index)))
    return reduce(lambda a, b: a.unionByName(b), found)


def _scan(docs, shared):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        index = shared.value
        for b in batches:
            out = []
            if index["spans"]:
                ids, column = b.column(0), b.column(1)
                i = 0
                while i < len(column):
                    texts, total = [], 0
                    while i + len(texts) < len(column) and (not texts or total < 4_000_000):
                        t = column[i + len(texts)]
                        texts.append(normal(t.as_buffer().to_pybytes()) if t.is_valid else b"")
                        total += len(texts[-1]) + 1
                    data = np.frombuffer(b"\0".join(texts), np.uint8)
                    for n in marked(data, np.cumsum([len(t) + 1 for t in texts]), index):
                        by_item = {}
                        for own, d, s, e in matches(texts[n], index) if n < len(texts) else ():
                            by_item.setdefault(index["spans"][own][0], []).append((d, s, e))
                        out += [(ids[i + n].as_py(), item, len(x), min(d for d, _, _ in x), min(s for _, s, _ in x), max(e for _, _, e in x))
                                for item, x in by_item.items()]
                    i += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate(
                (ids_kind(b), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))],
                ["doc_id", "item_id", "n_windows", "distance", "start", "end"])

    def ids_kind(b):
        return b.schema.field(0).type
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, n_windows int, distance int, start int, end int")


def drop_leaking(docs, benchmark):
    """``docs`` without the rows that hold a benchmark window."""
    key = "_leak_key"
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    from ..session import materialize
    bad = materialize(find_leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(bad, key, "left_anti").drop(key)

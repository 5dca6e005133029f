"""Spelling variant grouping with blocked Gram matrices.

Words are vectors of letter counts. A word with one letter more is at a squared distance of
1, one with another letter in one place at 2, so a Gram matrix of two blocks of words (one
numpy product) leaves few pairs to compare letter by letter. Blocks hold the words of one
length with the same counts in ``CLASSES`` classes of letters; one edit moves a word to its
own block, to one that has a letter less in one class and one more in another, or to one of
the next length with a letter more in one class, so only such blocks are multiplied. Blocks
above ``TILE`` words are dealt to tiles, and tiles meet pair by pair, so a task never holds
more than two tiles at a time.
"""

import pyspark.sql.functions as F

from ..session import materialize, release
from .common import batch_rows

CLASSES = 6             # classes of letters, by code point
TILE = 512              # words of a tile on average
LEAST_LENGTH = 6        # code points
LEAST_COUNT = 5         # occurrences
RATIO = 5               # a form is at least so many times as frequent
NOISE = 199             # one run in so many loses a letter
PAIRS = 200             # pairs of tiles handed to a task at a time
GATHER = 200_000        # distinct words a task adds up before it hands them on
LONG = 1 << 22          # code points from which a text is read run by run
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def count_words(docs, least_length=LEAST_LENGTH, noise=NOISE):
    """(word, n) over all texts, with the stated noise: in one (doc_id, run) of ``noise``, by crc32, a letter is deleted."""
    def count(batches):
        import re
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa
        run, found = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length), Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found]), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                if not text.is_valid:
                    continue
                # one byte per code point; what is no letter here becomes "?", and lower() knows only A-Z
                data = text.as_py().encode("latin-1", "replace").lower()
                runs = Counter(run.findall(data) if len(data) < LONG else (m.group() for m in run.finditer(data)))
                start = crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                for w, n in runs.items():
                    h = crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % noise == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                        if len(w) < least_length:
                            continue
                    found[w] += n
                if len(found) > GATHER:
                    yield out()
        yield out()
    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tiles(words):
    """(block, tile, words, counts): words of one length and equal class counts, dealt to tiles of about ``TILE``."""
    sizes = [F.length("word") - F.length(F.translate("word", LETTERS[k::CLASSES], "")) for k in range(CLASSES)]
    keyed = words.withColumn("block", F.array(*sizes))
    parts = keyed.groupBy("block").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    return (keyed.join(parts, "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("parts")))
            .groupBy("block", "tile").agg(F.collect_list(F.struct("word", "n")).alias("w"))
            .select("block", "tile", F.col("w.word").alias("words"), F.col("w.n").alias("counts")))


def meetings(stored):
    """Every unordered pair of tiles that can hold near words, once: (words, counts) and (words2, counts2)."""
    moves = [[0] * CLASSES]
    for i in range(CLASSES):
        moves.append([int(k == i) for k in range(CLASSES)])                                # a letter more
        moves += [[int(k == j) - int(k == i) for k in range(CLASSES)] for j in range(i + 1, CLASSES)]    # another letter
    moved = F.array(*[F.array(*[F.col("block")[k] + m[k] for k in range(CLASSES)]) for m in moves])
    other = stored.select(F.col("block").alias("goal"), F.col("tile").alias("tile2"), F.col("words").alias("words2"), F.col("counts").alias("counts2"))
    return (stored.withColumn("goal", F.explode(moved)).join(other, "goal").filter((F.col("block") != F.col("goal")) | (F.col("tile") <= F.col("tile2")))
            .select("words", "counts", "words2", "counts2", ((F.col("block") == F.col("goal")) & (F.col("tile") == F.col("tile2"))).alias("same")))


def near_words(words):
    """(word, near, near_n), both ways, for all words that differ by exactly one inserted, deleted or replaced letter."""
    def compare(batches):
        import numpy as np
        import pyarrow as pa
        code = np.full(256, 0, np.int64)
        for i, ch in enumerate(LETTERS.encode("latin-1")):
            code[ch] = i

        def letters(strings):
            """A tile's words, all of one length, as a matrix of bytes, and their letter counts."""
            raw = np.frombuffer("".join(strings).encode("latin-1"), np.uint8).reshape(len(strings), -1)
            cell = code[raw] + len(LETTERS) * np.arange(len(strings))[:, None]
            counts = np.bincount(cell.ravel(), minlength=len(strings) * len(LETTERS)).reshape(len(strings), -1)
            return raw, counts.astype(np.float32 if raw.shape[1] < 2000 else np.float64)

        def one_edit(a, b):
            """Whether rows of ``a`` become those of ``b``, as long or one letter longer, by one edit."""
            m = a.shape[1]
            if b.shape[1] == m:
                return (a != b).sum(1) == 1
            head = np.logical_and.accumulate(a == b[:, :m], axis=1).sum(1)
            tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
            return head + tail >= m
        for b in batches:
            found = ([], [], [])
            for one, n1, two, n2, same in zip(*(c.to_pylist() for c in b.columns)):
                raw1, x = letters(one)
                raw2, y = (raw1, x) if same else letters(two)
                gap = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
                i, j = np.nonzero(gap == (2 if raw1.shape[1] == raw2.shape[1] else 1))
                if same:
                    i, j = i[i < j], j[i < j]
                for lo in range(0, len(i), 1 << 16):
                    p, q = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
                    fit = one_edit(raw1[p], raw2[q])
                    for s, t in zip(p[fit].tolist(), q[fit].tolist()):
                        found[0].extend((one[s], two[t]))
                        found[1].extend((two[t], one[s]))
                        found[2].extend((n2[t], n1[s]))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], ["word", "near", "near_n"])
    stored = materialize(tiles(words))
    with batch_rows(words.sparkSession, PAIRS):
        return materialize(meetings(stored).mapInArrow(compare, "word string, near string, near_n long")), stored


def roots(links):
    """(word, root) for the links (word, form): forms are followed to the last. A form is more frequent than its word, so no links close a circle."""
    known = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = materialize(known.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        done = longer.filter("moved").limit(1).count() == 0
        release(known)
        known = longer.select("word", "root")
        known.stored_at = longer.stored_at
        if done:
            return known


def variants(docs, ratio=RATIO, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, noise=NOISE):
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters (``LETTERS``, A-Z lowered) of at least ``least_length`` code
    points and ``least_count`` occurrences over all texts. A word's form is its most frequent near
    word (on ties the first in code-point order) if that is at least ``ratio`` times as frequent,
    its root the end of the chain of forms.

    Null texts hold no words, a null doc_id counts as an empty one in the noise, repeated rows
    count each. An empty table gives no rows. Only doc_id and text are read, so other columns
    may have any name.
    """
    words = materialize(count_words(docs, least_length, noise).filter(F.col("n") >= least_count))
    pairs, stored = near_words(words)
    best = (pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
            .select("word", "n_near", F.col("top.near").alias("near"), (-F.col("top.less")).alias("near_n")))
    fit = F.col("near_n") >= ratio * F.col("n")
    table = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fit, F.col("near")).alias("form"), F.when(fit, F.col("near_n")).alias("form_n")))
    release(words, pairs, stored)
    ends = roots(table.filter("form IS NOT NULL"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH table8 AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) t(i))),
runs AS (
  SELECT doc_id, r, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (
  SELECT doc_id, r, n, xor(list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, (unicode(ch) - 64)::BIGINT] END)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM runs, table8),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, g.word, g.n FROM words w JOIN gaps g ON g.rest = w.word
  UNION SELECT g.word, w.word, w.n FROM words w JOIN gaps g ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n,
    CASE WHEN b.near_n >= 5 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.near_n) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  WITH RECURSIVE step AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT s.word, f.form FROM step s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
  SELECT word, root FROM step)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.root AND e.form IS NULL
"""

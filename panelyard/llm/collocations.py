"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words. A prefix
polynomial over the bytes of a block of texts gives every word its fingerprint, a second one
over the words gives every n-gram its own, so an n-gram costs a few numpy operations and no
string is built. Tasks add up equal fingerprints before the shuffle; what travels is the
fingerprint, 32 bits of a second one from other polynomials, a count and a pointer to one text
that holds the n-gram. Lengths are counted one after the other: an n-gram is counted only
where both its parts one word shorter are frequent, which a bitmap of fixed size tells
(false hits only cost work). Where the second fingerprints of a group disagree, different
n-grams have met; those are counted again by their text. Only frequent phrases get their
text, from the texts they point to.

Equal texts of a language are counted once, with their number as weight.
"""

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..session import materialize, release

LEAST = 10              # occurrences of a frequent phrase
WORDS = 3               # words of the longest candidate
TOP = 2000              # phrases reported per language
FILTER_BITS = 27        # bits of the bitmap of frequent fingerprints, as a power of two
SEGMENT = 17            # bits of a piece of it, as a power of two
CHUNK = 1 << 20         # bytes hashed at a time
GATHER = 1 << 20        # entries a task adds up before it hands them on
SALTS = 64              # first-round groups of a language's ranking


class Hasher:
    """Words and n-gram fingerprints of blocks of texts; ``bits`` narrows the first fingerprint (tests)."""

    def __init__(self, bits=64):
        import numpy as np
        self.np, self.bits = np, bits
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        kind = np.zeros(256, np.uint8)              # 0 word, 1 space, 2 end of a piece
        kind[[32, 9]] = 1
        kind[[*b".,;:!?\n\x0b\x0c\r"]] = 2
        self.kind = kind
        # two independent polynomials: odd bases and a random value per byte
        self.base = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
        self.table = [self.mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(s)) * b) for s, b in zip((0, 1 << 20), self.base)]
        self.power = [[np.ones(1, np.uint64)] * 2 for _ in range(2)]

    def mix(self, x):
        np = self.np
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def powers(self, which, size):
        """Powers of a base and of its inverse modulo 2^64, at least ``size`` of each."""
        np = self.np
        if len(self.power[which][0]) < size:
            b = int(self.base[which])
            for i, v in enumerate((b, pow(b, -1, 1 << 64))):
                steps = np.full(size + size // 4, v, np.uint64)
                steps[0] = 1
                self.power[which][i] = np.multiply.accumulate(steps)
        return self.power[which]

    def prefix(self, symbols, which):
        """Prefix polynomial: entry i sums symbol_j * base^j over j < i."""
        np = self.np
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.powers(which, len(symbols) + 1)[0][:len(symbols)], out=out[1:])
        return out

    def words(self, raw, offsets):
        """Words of the texts ``raw[offsets[i]:offsets[i + 1]]``: bytes, start, end, text, contiguity with the next, symbols."""
        np = self.np
        data = self.lower[raw]
        kind = self.kind[data]
        word = kind == 0
        head = np.zeros(len(data) + 1, bool)
        head[offsets[:-1]] = True
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        start = np.flatnonzero(word & (~before | head[:-1]))
        end = np.flatnonzero(word & (~after | head[1:])) + 1
        text = np.searchsorted(offsets, start, "right") - 1
        piece = np.cumsum(kind == 2)[start]
        follows = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        symbols = []
        for which in (0, 1):
            p, inverse = self.prefix(self.table[which][data], which), self.powers(which, len(data) + 1)[1]
            symbols.append(self.mix((p[end] - p[start]) * inverse[start]))
        return data, start, end, text, follows, symbols

    def grams(self, follows, symbols, n, lang):
        """Places of the n-grams within pieces, their fingerprints and second fingerprints. Every word holds one empty n-gram."""
        np = self.np
        from xxhash import xxh64_intdigest
        size = len(symbols[0])
        at = np.arange(max(size - n + 1, 0)) if n else np.arange(size)
        for step in range(n - 1):
            at = at[follows[at + step]]
        out = []
        for which in (0, 1):
            q, inverse = self.prefix(symbols[which], which), self.powers(which, size + 1)[1]
            salt = np.uint64(xxh64_intdigest(f"{n} {lang}", which))
            out.append(self.mix((q[at + n] - q[at]) * inverse[at] + salt))
        if self.bits < 64:
            out[0] = out[0] & np.uint64((1 << self.bits) - 1)
        return at, out[0], (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def frequent(self, bitmap, fp):
        """Whether the bitmap of ``bitmap_of`` holds both bits of each fingerprint."""
        np = self.np
        hit = np.ones(len(fp), bool)
        for b in (fp >> np.uint64(64 - FILTER_BITS), fp & np.uint64((1 << FILTER_BITS) - 1)):
            hit &= (bitmap[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit

    def chosen(self, follows, symbols, n, lang, bitmap):
        """``grams`` whose parts one word shorter are both frequent."""
        at, fp, check = self.grams(follows, symbols, n, lang)
        if bitmap is not None and len(at):
            places, shorter, _ = self.grams(follows, symbols, n - 1, lang)
            fine = self.np.zeros(len(symbols[0]) + 1, bool)
            fine[places] = self.frequent(bitmap, shorter)
            keep = fine[at] & fine[at + 1]
            at, fp, check = at[keep], fp[keep], check[keep]
        return at, fp, check


def blocks(batch, columns):
    """Blocks of one language: (lang, bytes, offsets, {column: one value per text}) of about ``CHUNK`` bytes.

    ``batch`` holds text, lang and ``columns``. A longer text is cut where a piece ends, and
    stands in several blocks.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    ends = np.zeros(256, bool)
    ends[[*b".,;:!?\n\x0b\x0c\r"]] = True
    table = pa.Table.from_batches([batch])
    for lang in pc.unique(table["lang"]).to_pylist():
        part = table.filter(pc.equal(table["lang"], lang)).combine_chunks()
        text = part["text"].chunk(0)
        place = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(text.buffers()[2], np.uint8)
        values = {c: part[c].to_numpy() for c in columns}
        i = 0
        while i < len(text):
            j = max(int(np.searchsorted(place, place[i] + CHUNK, "right")) - 1, i + 1)
            taken = {c: v[i:j] for c, v in values.items()}
            lo, hi = int(place[i]), int(place[j])
            if j == i + 1:
                while hi - lo > CHUNK:
                    cut = np.flatnonzero(ends[raw[lo:lo + CHUNK]])
                    if not len(cut):
                        cut = np.flatnonzero(ends[raw[lo:hi]])[:1]
                    stop = lo + int(cut[-1]) + 1 if len(cut) else hi
                    yield lang, raw[lo:stop], np.array([0, stop - lo]), taken
                    lo = stop
                if hi > lo:
                    yield lang, raw[lo:hi], np.array([0, hi - lo]), taken
            else:
                yield lang, raw[lo:hi], place[i:j + 1] - lo, taken
            i = j


def add_up(np, fp, check, n, text_no):
    """One entry per (fp, check): counts added up, the largest text number kept."""
    order = np.argsort(fp, kind="stable")
    fp, check, n, text_no = fp[order], check[order], n[order], text_no[order]
    head = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.zeros(0, int)
    if len(fp) and (np.minimum.reduceat(check, head) != np.maximum.reduceat(check, head)).any():
        order = np.lexsort((check, fp))
        fp, check, n, text_no = fp[order], check[order], n[order], text_no[order]
        head = np.flatnonzero(np.concatenate(([True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1]))))
    if not len(fp):
        return fp, check, n, text_no
    return fp[head], check[head], np.add.reduceat(n, head), np.maximum.reduceat(text_no, head)


def distinct_texts(docs):
    """(lang, text, copies, text_no): every different text of a language once; empty and null texts hold no words."""
    return (docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter(F.length("text") > 0)
            .groupBy("lang", "text").agg(F.count("*").alias("copies")).withColumn("text_no", F.monotonically_increasing_id()))


def count_grams(texts, levels, bitmap, bits):
    """(fp, f, lo, hi, text_no) of all counted n-grams of the given lengths; lo <> hi where different n-grams met."""
    def count(batches):
        import numpy as np
        import pyarrow as pa
        hasher, parts, held = Hasher(bits), [], 0
        known = None if bitmap is None else bitmap.value

        def out(entries):
            return pa.RecordBatch.from_arrays([pa.array(entries[0].view(np.int64)), pa.array(entries[1]),
                                               pa.array(entries[2]), pa.array(entries[3])], ["fp", "check", "n", "text_no"])
        for batch in batches:
            for lang, raw, offsets, values in blocks(batch, ("copies", "text_no")):
                _, _, _, text, follows, symbols = hasher.words(raw, offsets)
                for n in levels:
                    at, fp, check = hasher.chosen(follows, symbols, n, lang, known)
                    parts.append(add_up(np, fp, check, values["copies"][text[at]], values["text_no"][text[at]]))
                    held += len(parts[-1][0])
                if held > 2 * GATHER:
                    parts = [add_up(np, *map(np.concatenate, zip(*parts)))]
                    held = len(parts[0][0])
                    if held > GATHER:
                        yield out(parts[0])
                        parts, held = [], 0
        if parts:
            yield out(add_up(np, *map(np.concatenate, zip(*parts))))
    rows = texts.select("text", "lang", "copies", "text_no").mapInArrow(count, "fp long, check int, n long, text_no long")
    return rows.groupBy("fp").agg(F.sum("n").alias("f"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.max("text_no").alias("text_no"))


def bitmap_of(spark, fingerprints):
    """A broadcast bitmap of 2^FILTER_BITS bits with two bits per fingerprint; its size never depends on the data.

    Tasks set the bits of whole segments, so the driver joins 2^FILTER_BITS / 2^SEGMENT pieces of bytes.
    """
    import numpy as np

    def segments(batches):
        import numpy as np
        import pyarrow as pa
        found = {}
        for b in batches:
            bits = b.column(0).to_numpy()
            for s in np.unique(bits >> SEGMENT).tolist():
                mine = bits[bits >> SEGMENT == s] & ((1 << SEGMENT) - 1)
                piece = found.setdefault(s, np.zeros(1 << (SEGMENT - 3), np.uint8))
                np.bitwise_or.at(piece, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["segment", "bits"])
    two = fingerprints.select(F.explode(F.array(F.shiftrightunsigned("fp", 64 - FILTER_BITS), F.col("fp").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))).alias("b"))
    bitmap = np.zeros((1 << (FILTER_BITS - SEGMENT), 1 << (SEGMENT - 3)), np.uint8)
    for r in two.repartition(F.shiftright("b", SEGMENT)).mapInArrow(segments, "segment long, bits binary").toLocalIterator():
        bitmap[r["segment"]] |= np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(bitmap.ravel())


def phrases_at(texts, wanted, bits, longest):
    """(lang, phrase, f) of the fingerprints ``wanted`` (fp, check, f, text_no), read from the text each points to."""
    per_text = wanted.groupBy("text_no").agg(F.collect_list("fp").alias("fps"), F.collect_list("check").alias("checks"), F.collect_list("f").alias("fs"))

    def read(batches):
        import numpy as np
        import pyarrow as pa
        hasher = Hasher(bits)
        for batch in batches:
            row = pa.array(np.arange(batch.num_rows))
            fps, checks, fs = (batch.column(k) for k in (2, 3, 4))
            sizes = np.diff(fps.offsets.to_numpy())
            both = lambda fp, check: hasher.mix(fp ^ (check.view(np.uint32).astype(np.uint64) << np.uint64(32)))
            want = both(fps.flatten().to_numpy().view(np.uint64), checks.flatten().to_numpy())
            owner, counts = np.repeat(np.arange(len(sizes)), sizes), fs.flatten().to_numpy()
            order = np.argsort(want)
            want, owner, counts = want[order], owner[order], counts[order]
            found = ([], [], [])
            seen = np.zeros(len(want), bool)
            for lang, raw, offsets, values in blocks(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), row], ["text", "lang", "row"]), ("row",)):
                data, start, end, text, follows, symbols = hasher.words(raw, offsets)
                for n in range(longest + 1):
                    at, fp, check = hasher.grams(follows, symbols, n, lang)
                    name = both(fp, check)
                    spot = np.minimum(np.searchsorted(want, name), len(want) - 1)
                    hit = np.flatnonzero((want[spot] == name) & (owner[spot] == values["row"][text[at]]))
                    spots, first = np.unique(spot[hit], return_index=True)
                    for s, i in zip(spots, at[hit[first]]):
                        if not seen[s]:
                            seen[s] = True
                            found[0].append(lang)
                            found[1].append(b" ".join(data[start[i + k]:end[i + k]].tobytes() for k in range(n)).decode())
                            found[2].append(int(counts[s]))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], ["lang", "phrase", "f"])
    return texts.join(per_text, "text_no").select("text", "lang", "fps", "checks", "fs").mapInArrow(read, "lang string, phrase string, f long")


def recount(spark, texts, met, levels, bitmap, bits):
    """(lang, phrase, f) of the n-grams whose fingerprints (``met``) stand for several: counted by their text."""
    wanted = bitmap_of(spark, met)

    def count(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        hasher, found = Hasher(bits), Counter()
        known = None if bitmap is None else bitmap.value

        def out():
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()),
                                               pa.array([k[2] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())],
                                              ["fp", "lang", "phrase", "n"])
        for batch in batches:
            for lang, raw, offsets, values in blocks(batch, ("copies",)):
                data, start, end, text, follows, symbols = hasher.words(raw, offsets)
                for n in levels:
                    at, fp, _ = hasher.chosen(follows, symbols, n, lang, known)
                    hit = hasher.frequent(wanted.value, fp)
                    for i, f in zip(at[hit], fp[hit].view(np.int64)):
                        phrase = b" ".join(data[start[i + k]:end[i + k]].tobytes() for k in range(n)).decode()
                        found[int(f), lang, phrase] += int(values["copies"][text[i]])
                if len(found) > GATHER // 8:
                    yield out()
                    found.clear()
        yield out()
    rows = texts.select("text", "lang", "copies").mapInArrow(count, "fp long, lang string, phrase string, n long")
    return rows.join(met.select("fp"), "fp", "left_semi").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def frequent_phrases(docs, longest=WORDS, least=LEAST, bits=64):
    """(lang, phrase, f) of every phrase of up to ``longest`` words with at least ``least`` occurrences, stored.

    The empty phrase counts a language's words (for languages with at least ``least``). ``docs``
    holds text and lang.
    """
    spark = docs.sparkSession
    texts = materialize(distinct_texts(docs))
    bitmap, parts, counted = None, [], []
    for n in range(1, longest + 1):
        levels = (0, 1) if n == 1 else (n,)
        counts = materialize(count_grams(texts, levels, bitmap, bits).filter(F.col("f") >= least))
        release()
        met = counts.filter("lo <> hi")
        if met.limit(1).count():
            parts.append(recount(spark, texts, met, levels, bitmap, bits).filter(F.col("f") >= least))
        counted.append(counts)
        if n < longest:
            bitmap = bitmap_of(spark, counts)
    sound = counted[0]
    for c in counted[1:]:
        sound = sound.union(c)
    found = phrases_at(texts, sound.filter("lo = hi").select("fp", F.col("lo").alias("check"), "f", "text_no"), bits, longest)
    for p in parts:
        found = found.union(p)
    found = materialize(found)
    release(texts, *counted)
    return found


def collocations(docs, longest=WORDS, least=LEAST, share=50, top=TOP):
    """The ``top`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words with a >= ``least`` occurrences is cut in two after each of
    its words; l and r count the parts, the score is floor(10^6 a a / (l r)), and the cut with
    the least score counts, on ties the first. A phrase goes when a longer frequent one that
    holds it has at least ``share`` percent of its occurrences. Order: score and a descending,
    phrase in byte order. n counts the words of the language.

    Null texts count as empty, a null lang as ``und``; repeated rows count each. An empty table
    gives no rows. Only text and lang are read, so other columns may have any name.
    """
    c = F.col
    freq = frequent_phrases(docs, longest, least)
    word = F.split("phrase", " ")
    several = freq.filter("instr(phrase, ' ') > 0").withColumn("w", word)
    cuts = several.select("lang", "phrase", c("f").alias("a"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("right")))).alias("_", "cut"))
    part = lambda name, count: freq.select("lang", c("phrase").alias(name), c("f").alias(count))
    scored = (cuts.select("lang", "phrase", "a", "cut.*").join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
              .withColumn("score", F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    size = F.size("w")
    inside = (several.filter(size > 2).select("lang", "f", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = (best.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * c("longer") < share * c("a"), F.lit(True))).drop("longer"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within hashed parts of a language, then the few left, so that no task sorts a whole language
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    near = kept.withColumn("place", F.row_number().over(parts)).filter(c("place") <= top).drop("place")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(c("rank") <= top)
    total = freq.filter("phrase = ''").select("lang", c("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH words AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)),
freq AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (1000000 * c.a * c.a) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN freq l ON l.lang = c.lang AND l.m = k AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN freq r ON r.lang = c.lang AND r.m = c.m - k AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM cand c WHERE c.m = 3 AND c.lang = b.lang AND 100 * c.a >= 50 * b.a AND len(string_split(b.phrase, ' ')) = 2
    AND (c.w[1] || ' ' || c.w[2] = b.phrase OR c.w[2] || ' ' || c.w[3] = b.phrase))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

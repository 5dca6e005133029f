"""Exact top-k search, collocations and spelling variants against plain Python."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import collocations as CO, impact as IM, spelling as SP

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# exact top-k search

def plain_top(rows, k, asks):
    sound = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in sound]
    out = []
    for n, (i, q) in enumerate(whole):
        if i is not None and asks(i):
            scored = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for m, (j, v) in enumerate(whole) if m != n]
            out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(sorted(scored, key=lambda t: t[:3])[:k], 1)]
    return sorted(out, key=repr)


def got_top(spark, rows, k, asks, schema="vec_id long, embedding array<float>"):
    found = IM.top_k(spark.createDataFrame(rows, schema), k, asks).collect()
    return sorted([tuple(r) for r in found], key=repr)


def test_top_k_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(IM, "BLOCK", 300)
    monkeypatch.setattr(IM, "FEW", 8)
    monkeypatch.setattr(IM, "QUERIES", 20)
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.15, (1500, 12)).astype(np.float32)
    base[700:730] = base[3]                                         # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    assert got_top(spark, rows, 5, F.col("vec_id") % 50 == 0) == plain_top(rows, 5, lambda i: i % 50 == 0)


def test_the_bound_proves_members_out():
    rng = np.random.default_rng(4)
    x = np.floor(rng.laplace(0, 30, (2000, 6))).astype(np.int32)
    order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
    block = IM.Block(np, list(range(2000)), 6, x.tobytes(), order.tobytes())
    for q in (x[5], x[77] * 3, np.array([500, 0, 0, 0, 0, 0])):
        left, read = block.possible(q.astype(np.int64), 5, None)
        scores = x.astype(np.int64) @ q
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(left.tolist())
    assert read < 2000                                              # one heavy dimension: most of its postings are not read


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [2.0]), (8, None), (9, [nan, 1.0]), (10, [inf, 1.0]), (50, []), (100, [0.1, -0.1])]
    got = got_top(spark, rows, 3, F.col("vec_id") % 50 == 0)
    assert got == plain_top(rows, 3, lambda i: i % 50 == 0)
    assert IM.top_k(spark.createDataFrame([(1, [None, 1.0])], "vec_id long, embedding array<float>"), 5, F.lit(True)).count() == 0
    assert IM.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), 5, F.lit(True)).count() == 0
    wide = spark.createDataFrame([(1, [1.0], "a", 2), (2, [2.0], "b", 3)], "vec_id long, embedding array<double>, block string, id int")
    assert [tuple(r) for r in IM.top_k(wide, 5, F.col("vec_id") == 1).collect()] == [(1, 1, 2, 256 * 512)]
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1e300, 0.0])], "vec_id long, embedding array<double>")
    assert IM.top_k(huge, 1, F.lit(True)).first()["score"] == (1 << 24) ** 2


# collocations

def plain_collocations(rows, least=10, top=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    f[lang][tuple(w[i:i + n])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, k = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((s, a, " ".join(p), count[p[:k]], count[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, l, r, total[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(8)
    words = ["Alpha", "beta", "gämma", "x", "-", "delta\x1ce", "New York", "in the end", "日本", " "]
    sep = [" ", "  ", "\t", ", ", ".", "\n", "!\r\n", " "]
    text = lambda n: "".join(words[min(int(rng.exponential(2.5)), 9)] + sep[int(rng.integers(0, 8))] for _ in range(n))
    rows = [(text(int(rng.integers(0, 60))), ["en", "de", None, "und"][int(rng.integers(0, 4))]) for _ in range(120)]
    return rows + [(None, "en"), ("", "fr"), ("...", "fr"), (" \t", None)] + rows[:7] * 3


@pytest.mark.parametrize("chunk, bits", [(1 << 20, 64), (50, 64), (1 << 20, 7)])
def test_collocations_equal_plain_counts(spark, monkeypatch, chunk, bits):
    """Also with blocks shorter than a text, and with fingerprints so short that n-grams meet all the time."""
    monkeypatch.setattr(CO, "CHUNK", chunk)
    if bits < 64:
        whole = CO.frequent_phrases
        monkeypatch.setattr(CO, "frequent_phrases", lambda docs, longest, least: whole(docs, longest, least, bits))
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, i, "z") for i, (t, lang) in enumerate(rows)], "text string, lang string, text_no int, phrase string").repartition(3)
    assert sorted(tuple(r) for r in CO.collocations(docs).collect()) == plain_collocations(rows)


def test_collocations_without_rows(spark):
    assert CO.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    got = spark.sql("SELECT (cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s FROM VALUES (3000000019L, 3000000023L, 3000000037L) t(a, l, r)").first()[0]
    assert got == 10**6 * 3000000019**2 // (3000000023 * 3000000037)


# spelling variants

def plain_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    form, out = {}, []
    around = {w: [v for v in words if v != w and near(w, v)] for w in words}
    for w, c in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * c else None
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, len(around[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spelling_rows():
    rng = np.random.default_rng(6)
    alphabet = "aabcdeéß÷×ÿ"
    base = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(6, 9)))) for _ in range(30)]
    def edit(w):
        k, kind, c = int(rng.integers(0, len(w))), int(rng.integers(0, 3)), alphabet[int(rng.integers(0, len(alphabet)))]
        return w[:k] + (c if kind == 0 else c + w[k] if kind == 1 else "") + w[k + 1:]
    words = base * 60 + [edit(w) for w in base for _ in range(2)] * 6
    words += [edit(edit(w)) for w in base] * 5 + ["Straße" + "x" * 40] * 5 + ["straße" + "x" * 41] * 30
    rng.shuffle(words)
    rows = [(int(i) if i % 9 else None, ", ".join(words[k:k + 25]).upper() if i % 5 == 0 else "! ".join(words[k:k + 25])) for i, k in enumerate(range(0, len(words), 25))]
    return rows + [(1, None), (2, ""), (3, "日本 abcdef"), rows[1], rows[1]]


@pytest.mark.parametrize("tile", [512, 3])
def test_variants_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(SP, "TILE", tile)
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, word string, block int").repartition(4)
    got = sorted([tuple(r) for r in SP.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()], key=repr)
    want = plain_variants(rows)
    assert got == want and sum(r[1] is not None for r in want) > 5


def test_chains_of_forms_end_at_the_root(spark):
    words = [("abcdefg", 5), ("abcdefgh", 25), ("abcdefghi", 125), ("abcdefghij", 625), ("zzzzzz", 9)]
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in SP.variants(docs, noise=1 << 40).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij") and got["abcdefghij"] == (None, "abcdefghij") and got["zzzzzz"] == (None, "zzzzzz")


def test_variants_without_rows(spark):
    assert SP.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0

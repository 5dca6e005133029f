"""Operators against plain Python on the smallest tables and on made cases."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pyspark.sql.functions as F
import pytest

import __spark_entry__ as entry
from panelyard.llm import components, decontaminate, lines, media, mixing, quality, queries, secrets, sharding, simhash, tokens, toxicity

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMOKE}/documents.parquet' ORDER BY 1").fetchall())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMOKE}/documents.parquet")


def union_find(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_names():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


# 1 mixing
def test_pattern_is_fair():
    for shares in ({"a": 512, "b": 300, "c": 212}, {"a": 1, "b": 1}, {"x": 1000, "y": 20, "z": 4}, {str(i): 64 for i in range(16)}):
        period, at = sum(shares.values()), mixing.pattern(shares)
        owner = {t: s for s, slots in at.items() for t in slots}
        assert sorted(owner) == list(range(period))
        done = Counter()
        for t in range(period):
            done[owner[t]] += 1
            assert all(abs(done[s] - (t + 1) * q / period) < 1 for s, q in shares.items())


def test_mix_equals_simulation(spark, docs):
    out = queries.op1_mixing(spark, SMOKE).collect()
    assert len(out) == docs.count()
    blocks = {(r["mix_class"], r["block"]): r for r in out}
    assert len({r["slot"] for r in blocks.values()}) == len(blocks)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in blocks.values())
    # bytes fill the blocks of a class in order without holes
    size = {i: len((t or "").encode()) + 16 for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SMOKE}/documents.parquet'").fetchall()}
    for c in {r["mix_class"] for r in out}:
        at = 0
        for r in sorted((r for r in out if r["mix_class"] == c), key=lambda r: (r["block"], r["offset"])):
            assert r["block"] * mixing.BLOCK_BYTES + r["offset"] == at
            at += size[r["doc_id"]]


def test_phases_place_every_block():
    rng = random.Random(1)
    for _ in range(20):
        blocks = {f"s{i}": rng.randrange(0, 300) for i in range(rng.randrange(1, 7))}
        weights = {s: rng.random() + 0.01 for s in blocks}
        got = Counter()
        slots = set()
        for s, _, first, end, start, share, period, at in mixing.phases(blocks, weights, 64):
            got[s] += end - first
            for i in range(end - first):
                slots.add(start + i // share * period + at[i % share])
        assert all(got[s] == n for s, n in blocks.items()) and slots == set(range(sum(blocks.values())))


def test_given_weights_and_rest(docs):
    out = mixing.mix(docs, {"src0": 3.0, mixing.REST: 1.0}, 4096)
    assert {r["mix_class"] for r in out.select("mix_class").distinct().collect()} == {"src0", mixing.REST}
    first = [r["mix_class"] for r in out.filter("phase = 0").select("mix_class", "slot").distinct().orderBy("slot").collect()]
    assert all(abs(first[:k].count("src0") - 0.75 * k) < 1 for k in range(1, len(first)))
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 0.0})


# 2 toxicity
def test_segments_are_the_maximal_ones():
    def slow(s):
        """Best segment, then the same left and right of it."""
        if not s:
            return []
        total = np.concatenate([[0], np.cumsum(s)])
        best, a, b = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))[0], None, None
        if best <= 0:
            return []
        i, j = min(((i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if total[j] - total[i] == best), key=lambda p: (p[1] - p[0], p[0]))
        return slow(s[:i]) + [best] + slow(s[j:])
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice([-3.25, -1.5, -0.5, 0.75, 2.125]) + rng.randrange(1000) / 2 ** 20 for _ in range(rng.randrange(0, 14))]
        assert sorted(x for _, _, x in toxicity.segments(s)) == pytest.approx(sorted(slow(s)))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf).collect()}
    label = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["score"], y) for i, y in label.items() if got[i]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.8
    assert np.mean([n >= 0.5 for n in neg]) < 0.06


# 3 sharding
def test_shards_are_level_and_map_is_versioned(spark, docs):
    folder = sharding.map_folder(spark)
    out = sharding.shard_documents(spark, docs, 10, folder).collect()
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 10 + 64
    assert all(r["size"] == len(r["text"].encode()) + 16 and r["text_crc32"] == crc32(r["text"].encode()) for r in out)
    first, second = (dict(map(tuple, sharding.load_map(spark, folder, v).select("virtual_slot", "shard").collect())) for v in (0, 1))
    assert len(first) == len(second) == sharding.SLOTS and all(first[s] == s % 10 for s in first)


def test_rebalance_and_grow():
    rng = random.Random(2)
    weight = [rng.randrange(1, 1000) for _ in range(2000)]
    owner = [rng.randrange(8) if rng.random() < 0.7 else 0 for _ in weight]
    edits = sharding.rebalance(owner, weight, 8)
    new = [edits.get(i, s) for i, s in enumerate(owner)]
    load = [sum(w for w, s in zip(weight, new) if s == k) for k in range(8)]
    assert max(load) - min(load) < 20 and len(edits) < 1200
    more = sharding.grow(new, weight, 8)
    assert set(more.values()) == {8}
    load = [sum(w for i, w in enumerate(weight) if more.get(i, new[i]) == k) for k in range(9)]
    assert max(load) - min(load) < 1200


# 4 media
def test_copies_are_found(spark):
    vectors = spark.read.parquet(f"{SMOKE}/embeddings.parquet").filter("vec_id < 120")
    out = media.copies(media.render(vectors).repartition(4)).collect()
    edited = [r for r in out if r["image_id"] % 2]
    assert np.mean([r["component_id"] == r["image_id"] - 1 for r in edited]) >= 0.9
    assert all(r["component_id"] == r["image_id"] for r in out if r["image_id"] % 2 == 0)
    assert all(r["n_links"] >= 1 for r in edited if r["component_id"] == r["image_id"] - 1)


# 5 quality
def test_quality_separates(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, sf).collect()}
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    good, bad = [got[i]["selected"] for i, y in label.items() if y], [got[i]["selected"] for i, y in label.items() if not y]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_draw_of_k_and_kth_key(spark, docs):
    rows = spark.createDataFrame([(x,) for x in [5, 5, -7, 1 << 33, 12, -(1 << 25)]], "sort_key long")
    for k, want in enumerate([1 << 33, 12, 5, 5, -7, -(1 << 25)], 1):
        assert quality.kth_key(rows, k) == want
    assert quality.kth_key(rows, 0) is None and quality.kth_key(rows, 7) is None
    labels = spark.read.parquet(f"{SMOKE}/labels.parquet")
    table, _ = quality.resample(docs, labels, k=50)
    keys = sorted((r["sort_key"] for r in table.collect()), reverse=True)
    assert sorted((r["sort_key"] for r in table.filter("selected").collect()), reverse=True) == keys[:50]


# 6 simhash
def slow_fingerprint(text, k=4):
    import xxhash
    w = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, SMOKE).collect()}
    fp = {i: slow_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    root = union_find(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (fp[a] ^ fp[b]).bit_count() <= 4])
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in ids}


def test_dense_groups_lose_no_link(spark):
    rng = random.Random(4)
    base, values = [rng.getrandbits(64) for _ in range(6)], set()
    for b in base:      # chains and stars of close fingerprints, beside strangers
        x = b
        for _ in range(60):
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {rng.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    signed = [simhash._signed(v) for v in values]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fp long").repartition(4)
    want = union_find(range(len(values)), [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 4])
    assert {r["doc_id"]: r["component_id"] for r in simhash.link_fingerprints(rows).collect()} == want


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(5)
    pairs = [(simhash._signed(rng.getrandbits(64)), simhash._signed(rng.getrandbits(64))) for _ in range(200)]
    out = spark.createDataFrame(pairs, "a long, b long").select(
        F.bit_count(simhash.popcounts(F.col("a")).bitwiseXOR(simhash.popcounts(F.col("b")))).alias("l1"), simhash.hamming("a", "b").alias("h"), "a", "b").collect()
    pc = lambda v: [((v >> 2 * i) & 1) + ((v >> (2 * i + 1)) & 1) for i in range(32)]
    for r in out:
        assert r["l1"] == sum(abs(x - y) for x, y in zip(pc(r["a"] % 2 ** 64), pc(r["b"] % 2 ** 64))) <= r["h"]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(10, 60)] + [(3, 3)] + [(200, 90), (90, 159)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    nodes = sorted({x for e in links for x in e})
    assert got == union_find(nodes, links)


# 7 decontamination
def test_leaks_verbatim_and_edited(spark, texts):
    bench = dict(duckdb.sql(f"SELECT item_id, text FROM '{SMOKE}/benchmark.parquet'").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, SMOKE).collect()}
    assert {(d, i) for d, t in texts.items() for i, b in bench.items() if b and len(b) >= decontaminate.LEAST and b in t} <= got
    rng, rows = random.Random(6), []
    for n, (i, b) in enumerate(sorted(bench.items())):
        if len(b) >= 60:
            c = list(b)
            for _ in range(len(c) // 50):
                p = rng.randrange(len(c))
                c[p:p + 1] = rng.choice([[], [c[p], "x"], ["q"]])
            rows.append((n, "Entirely other words stand before it, " * 3 + "".join(c) + " and after it, as ever" * 4, i))
    made = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(made, spark.read.parquet(f"{SMOKE}/benchmark.parquet")).collect()}
    assert len({(n, i) for n, _, i in rows} - found) == 0
    clean = spark.createDataFrame([(1, "Entirely other words stand here, as ever. " * 50)], "doc_id long, text string")
    assert decontaminate.find_leaks(clean, spark.read.parquet(f"{SMOKE}/benchmark.parquet")).count() == 0


def test_alignment_equals_edit_distance():
    def slow(p, t):     # least edit distance of p to any part of t
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)
    rng = random.Random(7)
    for _ in range(60):
        p = bytes(rng.choice(b"abcd") for _ in range(50))
        c = bytearray(p)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(c))
            c[i:i + 1] = rng.choice([b"", bytes([c[i]]) + b"x", b"y"])
        text = b"zzzzzzzzz" + bytes(c) + b"zzzz"
        d, k = slow(p, text), 3
        hit = decontaminate.aligned(p, text, 9, k)
        assert (hit[0] if hit else None) == (d if d <= k else None)


# 8 secrets
def slow_spans(t):
    rules = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
             ("access", r"AKIA[A-Z0-9]+", 0, 0, 20), ("hex", r"[0-9a-f]+", 0, 0, 24)]
    out = [(m.start(), n, k, m.end()) for n, (k, rx, flags, g, least) in enumerate(rules) for m in re.finditer(rx, t, flags) if len(m.group(g)) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


CASES = ["token:token:abcdefgh", "API_KEY = 'abc.def=123' apikey:short", "x" * 50 + "AKIA" + "A1" * 10 + " AKIAAKIA12", "deadbeef" * 4 + "g" + "0" * 23 + " " + "0" * 24,
         "é😀 password=\"hunter2hunter2\" é SECRET: " + "f" * 30, "", None, "passwd=" + "a" * 100_000, "token=AKIA" + "B" * 20, "secret  :   'aaaaaa' token=bbbbb"]


def test_spans_equal_python(spark, texts):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(1000 + i, t) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ledger = secrets.new_ledger(spark)
    secrets.update(spark, docs, ledger)
    got = {r["doc_id"]: r for r in secrets.report(docs, secrets.findings(spark, ledger)).collect()}
    for i, t in rows:
        want = slow_spans(t or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        r = got[i]
        assert r["spans"] == text and r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]


def test_ledger_scans_only_what_is_new(spark):
    one = spark.createDataFrame([(1, "password=abcdefg"), (2, "clean"), (3, "password=abcdefg")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "password=abcdefg"), (5, "other token=zzzzzzz")], "doc_id long, text string")
    ledger = secrets.new_ledger(spark)
    assert secrets.update(spark, one, ledger).count() == 2
    assert secrets.update(spark, two, ledger).count() == 1
    assert secrets.update(spark, two, ledger).count() == 0
    assert secrets.update(spark, one.union(two), ledger, version="2").count() == 3
    found = secrets.report(one.union(two), secrets.findings(spark, ledger)).filter("n_assign > 0").collect()
    assert {r["doc_id"] for r in found} == {1, 3, 4, 5}


# 9 tokens
def test_counts_equal_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ", "a\x1cb\x1fc", "x y z", "é ́ ÅÅ", "it's they'LL 'S 12345 ½ ²", "<|x|> <|", "漢字かな😀👍🏽", "\x00\x07", "-- ... !!!"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(1000 + i, t) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}
    for hot in (50, tokens.HOT):
        got = {r["doc_id"]: r for r in tokens.count_tokens(docs, path, hot=hot).collect()}
        assert {i: r["n_tokens"] for i, r in got.items()} == want
        assert all(got[i]["n_bytes"] == len(t.encode()) and got[i]["over_limit"] == (want[i] > 2048) for i, t in rows)


# 10 lines
def slow_removed(rows):
    gone, seen = set(), []
    for d, i, line in rows:
        s = frozenset(x for x in re.split("[ \t\r\f\v]", line.lower()) if x)
        if not s:
            continue
        if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
            gone.add((d, i))
        seen.append(s)
    return gone


def test_removed_lines_equal_brute_force(spark, texts, tmp_path):
    rng, made = random.Random(8), {}
    for k in range(12):     # a group of near copies of one line, a hot line, short lines
        base = [f"w{k}x{j}" for j in range(rng.randrange(1, 30))]
        for n in range(12):
            line = list(base)
            for _ in range(rng.randrange(0, 4)):
                line[rng.randrange(len(line))] = f"v{rng.randrange(40)}"
            made[10_000 + 20 * k + n] = "the same hot line\n" + " ".join(line) + "\n\n a\n"
    every = dict(sorted({**dict(list(texts.items())[:80]), **made}.items()))
    spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = slow_removed([(d, i, line) for d, t in every.items() for i, line in enumerate(t.split("\n"))])
    got = {(r["doc_id"], int(i)) for r in lines.line_report(docs).collect() for i in r["removed"].split(",") if i}
    assert got == want
    left = {r["doc_id"]: r["text"] for r in lines.drop_later_lines(docs).collect()}
    assert left == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want) for d, t in every.items()}


# SQL twins and pipeline
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    rel = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in rel.description]
    got = queries.QUERIES[name](spark, SMOKE)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(rel.fetchall())


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SMOKE).collect()
    table = duckdb.sql(f"SELECT doc_id, text FROM '{SMOKE}/documents.parquet' ORDER BY 1").fetchall()
    selected = {r["doc_id"] for r in queries.op5_quality(spark, SMOKE).filter("selected").collect()}
    rows = [(i, t) for i, t in table if i in selected]
    grams = {}
    for i, t in rows:
        w = t.encode().lower().split() if t.isascii() else t.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        grams[i] = {b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i, _ in rows]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if grams[a] == grams[b] or len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    root = union_find(ids, links)
    kept = {i for i in ids if root[i] == i}
    leaks = {r["doc_id"] for r in queries.op7_decontaminate(spark, SMOKE).collect()}
    assert {r["doc_id"] for r in out} == kept - leaks
    assert {r["shard"] for r in out} <= set(range(corpus_pipeline.SHARDS)) and len(out) == len(kept - leaks)
    columns = spark.read.parquet(f"{SMOKE}/documents.parquet").columns
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMOKE).columns == columns

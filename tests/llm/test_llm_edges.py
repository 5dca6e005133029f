"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import decontaminate, lines, media, mixing, quality, secrets, sharding, simhash, tokens, toxicity

COLS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("row_key", "score", "size", "shard", "slot", "block", "phase", "predicted", "n_tokens", "blob", "spans", "component_id", "fp0")
ROWS = [(1, "The quick brown fox jumps over the lazy dog.\nA second line of text here.", "en", "a", 70), (2, None, "en", "a", None), (3, "", None, None, 0),
        (None, "no id but words", "en", "b", 15), (None, None, None, None, None), (5, "repeated row of words", "en", "a", 21), (5, "repeated row of words", "en", "a", 21),
        (6, "repeated row of words", "en", "b", 21), (7, "word and more words. " * 20_000, "en", "a", 420_000), (8, " \n\t\n ", "en", "c", 5), (9, "é ü ñ 漢字 😀", "fr", "c", 9)]
LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, 0), (8, 0, 1), (None, 1, 1), (7, None, None), (1, 1, 0)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Stored tables: operators that read twice need a repeatable input."""
    base = tmp_path_factory.mktemp("edges")

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(base / name))
        return spark.read.parquet(str(base / name))
    import pyspark.sql.functions as F
    docs, empty = put("docs", ROWS, COLS), put("empty", [], COLS)
    clash = docs.withColumns({c: F.lit("x") for c in CLASH})
    labels = put("labels", LABELS, "doc_id long, quality int, toxic int")
    return {"docs": docs, "empty": empty, "clash": clash, "labels": labels, "no_labels": labels.limit(0),
            "benchmark": put("bench", [(1, "repeated row"), (2, None), (3, "the quick brown fox jumps over the lazy dog. a second")], "item_id long, text string")}


@pytest.mark.parametrize("kind", ["docs", "empty", "clash"])
def test_rows_are_kept(spark, store, kind):
    docs = store[kind]
    n = docs.count()
    model = toxicity.fit(docs, store["labels"])
    assert toxicity.score(docs, model).count() == n
    assert mixing.mix(docs).count() == n
    assert sharding.shard_documents(spark, docs, 4).count() == n
    placed = sharding.shard_positions(spark, docs, 4).collect()
    for shard in {r["shard"] for r in placed}:
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in placed)))
    table, _ = quality.resample(docs, store["labels"])
    assert table.count() == n
    assert simhash.fingerprint_components(docs).count() == n
    ledger = secrets.new_ledger(spark)
    secrets.update(spark, docs, ledger)
    assert secrets.report(docs, secrets.findings(spark, ledger)).count() == n
    report = lines.line_report(docs)
    assert report.count() == n
    assert lines.drop_later_lines(docs).count() == n


@pytest.mark.parametrize("kind", ["docs", "empty", "clash"])
def test_token_rows_are_kept(store, kind):
    import public_tokenizers
    out = tokens.count_tokens(store[kind], public_tokenizers.path("word_bpe_49k.json"))
    assert out.count() == store[kind].count()
    assert all(r["n_tokens"] == 0 and r["n_bytes"] == 0 for r in out.filter("text IS NULL OR text = ''").collect())


@pytest.mark.parametrize("kind", ["docs", "clash"])
def test_near_duplicates_and_leaks(store, kind):
    docs = store[kind]
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()]
    # doc 5 stands for the equal rows 5, 5 and 6; doc 2 for all texts without words
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, None, 5, 7, 9]))
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
    found = decontaminate.find_leaks(docs, store["benchmark"]).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 3)}
    assert decontaminate.drop_leaking(docs, store["benchmark"]).count() == docs.count() - 1
    assert decontaminate.drop_leaking(docs, store["benchmark"].limit(0)).count() == docs.count()


def test_no_labels_scores_nothing(store):
    model = toxicity.fit(store["docs"], store["no_labels"])
    assert {r["score"] for r in toxicity.score(store["docs"], model).collect()} == {0.0}
    table, _ = quality.resample(store["docs"], store["no_labels"])
    assert all(r["selected"] for r in table.collect())


def test_components_of_blank_texts(store):
    out = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.fingerprint_components(store["docs"]).collect()}
    zero = {x for x in out if x[1] == "0" * 16}
    assert {x[0] for x in zero} == {2, 3, 8, None} and {x[2] for x in zero} == {2}


def test_media_edges(spark, store):
    rows = [(1, 4, 4, bytearray(16)), (2, 4, 4, bytearray(16)), (3, None, None, None), (4, 9, 9, bytearray(5)), (5, 40, 40, bytearray(1600)), (5, 40, 40, bytearray(1600))]
    images = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary").repartition(2)
    out = sorted((r["image_id"], r["component_id"]) for r in media.copies(images).collect())
    assert out == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (5, 5)]
    assert media.copies(images.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, None), (None, [1.0]), (2, [])], "vec_id long, embedding array<float>")
    assert {r["image_id"] for r in media.render(vectors).collect()} == {4}


def test_copies_do_not_depend_on_ids(spark):
    """Copies far from their originals in any order of ids, and thirty edited copies of one picture."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter("vec_id < 200").select("vec_id", "embedding")
    same = vectors.filter("vec_id = 3").select("embedding").crossJoin(spark.range(1001, 1121, 4).withColumnRenamed("id", "vec_id")).select("vec_id", "embedding")
    drawn = media.render(vectors.union(same)).withColumn("true", F.when(F.col("vec_id") > 1000, 3).otherwise(F.col("vec_id")))
    shuffled = drawn.withColumn("image_id", F.xxhash64("image_id"))
    true = {r["image_id"]: (r["true"], r["edited"]) for r in shuffled.select("image_id", "true", "edited").collect()}
    parts, out = {}, media.copies(shuffled.repartition(3)).collect()
    for r in out:
        parts.setdefault(r["component_id"], []).append(r["image_id"])
    assert len(out) == len(true) and all(len({true[i][0] for i in ids}) == 1 and min(ids) == c for c, ids in parts.items())
    root = {true[i][0]: c for c, ids in parts.items() for i in ids if not true[i][1]}
    assert np.mean([r["component_id"] == root[true[r["image_id"]][0]] for r in out if true[r["image_id"]][1]]) >= 0.95
    assert all(r["n_links"] >= 1 for r in out if len(parts[r["component_id"]]) > 1 and true[r["image_id"]][1])


def _sparse(seed, size=204):
    """A picture whose corners lie farther apart than those of a key."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    waves = zip(rng.uniform(0, 6.3, 4), rng.uniform(90, 170, 4), rng.uniform(0, 6.3, 4))
    image = 110 + sum(22 * np.sin(2 * np.pi * (x * np.cos(t) + y * np.sin(t)) / p + q) for t, p, q in waves)
    for i in range(5):
        for j in range(5):
            a, b = 20 + 40 * i + rng.integers(-3, 4), 20 + 40 * j + rng.integers(-3, 4)
            image[a - 1:a + 2, b - 1:b + 2] += 80
    return np.clip(np.rint(image), 0, 255)


def test_copies_with_lone_corners_are_found(spark):
    """The components are those of all pairs compared."""
    drawn, pairs = {}, media._pairs()
    for k in range(30):
        rng = np.random.default_rng(1000 + k)
        copy = np.rot90(_sparse(k)[rng.integers(0, 40):, rng.integers(0, 40):], k) * rng.uniform(0.8, 1.05) + rng.uniform(-10, 10)
        drawn[2 * k], drawn[2 * k + 1] = _sparse(k), np.clip(np.rint(copy + rng.normal(0, 2, copy.shape)), 0, 255)
    known = {i: media.describe(image, pairs)[:2] for i, image in drawn.items()}
    half = {i: np.rint(media.halved(image)) for i, image in drawn.items()}
    want = {i: i for i in drawn}
    for a in sorted(drawn):
        for b in range(a):
            t = media.agreement(*known[a], *known[b])
            if t is not None and media.correlation(half[a], half[b], *t) >= media.OVERLAP:
                low, high = sorted((want[a], want[b]))
                want = {i: low if c == high else c for i, c in want.items()}
    rows = [(i, a.shape[1], a.shape[0], bytearray(a.astype(np.uint8).tobytes())) for i, a in drawn.items()]
    images = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")
    assert {r["image_id"]: r["component_id"] for r in media.copies(images).collect()} == want
    assert sum(want[2 * k] == want[2 * k + 1] for k in range(30)) > 15


def _brute_kept(rows, words=5, similarity=0.8):
    """doc_ids kept by comparing all pairs."""
    hashes = simhash.shingle_hasher(words)
    sets, root = [set(hashes(t.encode())) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    return sorted(min(rows[j][0] for j in range(len(rows)) if top(j) == g) for g in {top(i) for i in range(len(rows))})


def test_near_duplicates_of_a_star_equal_brute_force(spark, tmp_path):
    """Variants like one original but not like each other, chains and strangers with a common part: no pair is missed."""
    import random
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10 ** 9)}" for _ in range(n)]
    base, footer, rows = fresh(200), fresh(60), []
    for i in range(250):
        text = list(base)
        for at in r.sample(range(0, 200, 10), 4):
            text[at] = f"v{r.randrange(10 ** 9)}"
        rows.append((i + 1000, " ".join(text)))
    rows.append((5000, " ".join(base)))
    chain = fresh(150)
    for i in range(20):
        chain = chain[5:] + fresh(5)
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000 + i, " ".join(fresh(r.randrange(40, 90)) + footer)) for i in range(60)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted(x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect()) == _brute_kept(rows)


def test_simhash_gives_the_first_links(spark, monkeypatch):
    """Close fingerprints are linked by segment popcounts before the prefix filter; what that misses follows (F12)."""
    rows = [(i, " ".join(f"t{i // 2}x{j}" for j in range(400)) + (" end" if i % 2 else "")) for i in range(40)]
    rows += [(100 + i, " ".join(f"u{j}" if j % 40 else f"u{j}y{i}" for j in range(200))) for i in range(2)]
    seen, close = [], simhash.close_links
    monkeypatch.setattr(simhash, "close_links", lambda *a: seen.append(close(*a).count()) or close(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect()) == _brute_kept(rows)
    assert seen and seen[0] >= 15


def test_long_texts_that_share_little_are_not_read(spark, monkeypatch):
    """Wide parities rule out long texts of which a third is shared; tables of the step are deleted (F12)."""
    import os
    rows = [(i, " ".join([f"s{j}" for j in range(1000)] + [f"t{i}x{j}" for j in range(2000)])) for i in range(30)]
    seen, similar = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *a: seen.append(pairs.count()) or similar(pairs, *a))
    folder = lambda: {f for f in os.listdir(spark.conf.get("spark.checkpoint.dir")) if f.startswith("panelyard-")}
    before, docs = folder(), spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.count() == 30 and sum(seen) == 0
    assert len(folder() - before) == 1


def test_filler_runs_do_not_merge_texts(spark):
    """A shingle that makes up most of a text decides every bit of a fingerprint, but not the set of shingles."""
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(60)) + " ." * 200) for i in range(6)] + [(9, " ".join(f"t0x{j}" for j in range(60)) + " ." * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect()) == [0, 1, 2, 3, 4, 5]


def test_every_source_is_scheduled(spark):
    rows = [(i, f"s{i % 150:03d}" if i < 3000 else "big", "x" * 180) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs, block_bytes=512).collect()
    assert len(out) == 9000 and all(r["mix_class"] == r["source"] for r in out)
    blocks = {(r["mix_class"], r["block"]): r for r in out}
    assert len({r["slot"] for r in blocks.values()}) == len(blocks)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in blocks.values())
    # weights 1 to 12: over the first slots each source is less than one block away from its share
    weights = {"big": 12.0, "s007": 3.0, mixing.REST: 1.0}
    first = {r["slot"]: r["mix_class"] for r in mixing.mix(docs, weights, 512).filter("phase = 0").collect()}
    for s, share in (("big", 12 / 16), ("s007", 3 / 16)):
        assert all(abs(sum(c == s for t, c in first.items() if t < k) - share * k) <= 1 + 1e-3 * k for k in range(1, 40))
    with pytest.raises(ValueError):
        mixing.mix(docs, {"nowhere": 1.0})
    tiny = mixing.quanta({"a": 1e6, **{f"t{i}": 1.0 for i in range(40)}})
    assert sum(tiny.values()) == mixing.QUANTUM and min(tiny.values()) == 1


def test_calibration_sees_all_segments(spark, monkeypatch):
    """The evidence of a training text grows beyond its 64 best segments."""
    import random
    r = random.Random(5)
    plain = lambda n: " ".join(f"plain{r.randrange(60)}" for _ in range(n))
    long = lambda k: " ".join(f"vile{r.randrange(8)} {plain(4)}" for _ in range(k))
    texts = [(i, long(5), 1) for i in range(40)] + [(100 + i, plain(40), 0) for i in range(80)] + [(300, long(60), 1), (301, long(240), 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    seen, fitted = [], toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: seen.append(x) or fitted(x, y))
    toxicity.fit(docs, labels)
    totals = sorted(seen[0][:, 1])
    assert totals[-1] > 2 * totals[-2] > 0


def test_the_order_of_the_mix_reaches_the_shards(spark, tmp_path):
    import corpus_pipeline
    smoke = "/root/testdata/sf0.001"
    spark.read.parquet(f"{smoke}/documents.parquet").repartition(7).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    corpus_pipeline.mixing_stage(spark, docs, smoke).write.parquet(str(tmp_path / "m"))
    out = corpus_pipeline.sharding_stage(spark, spark.read.parquet(str(tmp_path / "m")), smoke).orderBy("mix_rank").collect()
    want = mixing.mix(docs).orderBy("slot", "offset", "doc_id").collect()
    assert [r["mix_rank"] for r in out] == list(range(docs.count()))
    assert [r["doc_id"] for r in out] == [r["doc_id"] for r in want]
    loose = corpus_pipeline.sharding_stage(spark, docs.limit(9), smoke)
    assert sorted(r["mix_rank"] for r in loose.collect()) == list(range(9))

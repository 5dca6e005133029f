"""Token counts without token ids.

Texts fall into pre-tokens that the tokenizer treats alone, so a text's count is the sum
over its distinct pre-tokens of frequency times pieces. Pieces are counted once per distinct
pre-token of the corpus. The joined frequencies stay small: the ``HOT`` most frequent
pre-tokens (a fixed bound) travel to the tasks as a dictionary, all others are joined by a
shuffle, so every pre-token counts and none needs to fit anywhere as a whole.

For tokenizers whose pre-tokens never cross white space and whose normalizer works on each
of them alone (word_bpe_49k.json). Special strings inside a text count one token each.
"""

import unicodedata

import pyspark.sql.functions as F

from ..session import materialize
from .common import without

HOT = 1 << 17           # most frequent pre-tokens, held by every task
MEMO = 60_000           # chunks a task remembers before it starts over
FLUSH = 100_000         # distinct pre-tokens a task gathers before it hands them on
ROWS = 400              # documents whose parts a task holds before it hands them on
ADDED = ("n_bytes", "n_tokens", "over_limit", "row_key")
# The pre-token pattern and special strings of the vocabulary file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def chunk_splitter():
    """Text to white-space separated chunks; \\x1c to \\x1f are no white space here, unlike in str.split."""
    import re
    odd, space = re.compile("[\x1c-\x1f]"), re.compile("[^\\S\x1c-\x1f]+")
    return lambda text: [c for c in space.split(text) if c] if odd.search(text) else text.split()


def pre_tokenizer(pattern=PRE_TOKEN, special=SPECIAL):
    """Chunk to pre-tokens; a special string is a pre-token of its own."""
    import re

    import regex
    find, cut = regex.compile(pattern).findall, re.compile("(" + "|".join(map(re.escape, special)) + ")")

    def plain(s):
        # capital sigma has a context rule in str.lower that the tokenizer lacks
        return find(unicodedata.normalize("NFC", s).replace("Σ", "σ").lower())

    def pre_tokens(chunk):
        if "<|" not in chunk:
            return plain(chunk)
        return [t for i, part in enumerate(cut.split(chunk)) for t in ([part] if i % 2 else plain(part))]
    return pre_tokens


def frequencies(docs):
    """Distinct pre-tokens of all texts with their total frequency."""
    def count(batches):
        from collections import Counter

        import pyarrow as pa
        chunks_of, pre_tokens = chunk_splitter(), pre_tokenizer()
        chunks, found = Counter(), Counter()

        def settle():
            for c, n in chunks.items():
                for t in pre_tokens(c):
                    found[t] += n
            chunks.clear()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["pre_token", "n"])
            found.clear()
            return batch
        for b in batches:
            for text in b.column(0):
                if text.is_valid:
                    chunks.update(chunks_of(text.as_py()))
                    if len(chunks) > MEMO:
                        settle()
                        if len(found) > FLUSH:
                            yield out()
        settle()
        yield out()
    return docs.select("text").mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))


def piece_counts(pre_tokens, path):
    """Adds ``pieces``: the tokenizer runs once per distinct pre-token."""
    def pieces(batches):
        import os

        import pyarrow as pa
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the cores are Spark's, and threads cost memory
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        for b in batches:
            names = b.column(0).to_pylist()
            got = []
            for i in range(0, len(names), 500):
                got += [len(e.ids) for e in tok.encode_batch(names[i:i + 500], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.int64())], ["pre_token", "n", "pieces"])
    return pre_tokens.select("pre_token", "n").mapInArrow(pieces, "pre_token string, n long, pieces long")


def count_tokens(docs, path, limit=2048, hot=HOT):
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each. Columns
    of the same names are replaced. ``path`` names the vocabulary file on every executor.
    """
    spark = docs.sparkSession
    docs = without(docs, *ADDED)
    counts = materialize(piece_counts(frequencies(docs), path))
    top = {r["pre_token"]: r["pieces"] for r in counts.orderBy(F.desc("n"), "pre_token").limit(hot).collect()}
    shared = spark.sparkContext.broadcast(top)
    keep = [c for c in docs.columns if c != "text"]

    def split(batches):
        """Per document a row with the tokens of its hot pre-tokens, then one row for each other pre-token."""
        from collections import Counter

        import pyarrow as pa
        pieces, chunks_of, pre_tokens, memo = shared.value, chunk_splitter(), pre_tokenizer(), {}

        def known(chunk):
            total, rest = 0, []
            for t in pre_tokens(chunk):
                n = pieces.get(t)
                if n is None:
                    rest.append(t)
                else:
                    total += n
            memo[chunk] = got = (total, rest or ())
            return got

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())],
                                              ["row_key", "pre_token", "n"])
        for b in batches:
            rows = ([], [], [])
            for i, (key, scalar) in enumerate(zip(b.column(0), b.column(1)), 1):
                total, cold = 0, Counter()
                for chunk, n in Counter(chunks_of(scalar.as_py() or "")).items():
                    got = memo.get(chunk) or known(chunk)
                    total += got[0] * n
                    for t in got[1]:
                        cold[t] += n
                rows[0].extend([key.as_py()] * (len(cold) + 1))
                rows[1].append(None)
                rows[1].extend(cold)
                rows[2].append(total)
                rows[2].extend(cold.values())
                if len(memo) > MEMO:
                    memo.clear()
                if i % ROWS == 0:
                    yield batch(rows)
                    rows = ([], [], [])
            yield batch(rows)
    # the row key follows the input's partitions, so the two passes below must see one stored copy of the parts
    keyed = docs.withColumn("row_key", F.monotonically_increasing_id())
    parts = materialize(keyed.select("row_key", "text").mapInArrow(split, "row_key long, pre_token string, n long"))
    cold = (parts.filter("pre_token IS NOT NULL").join(counts.select("pre_token", "pieces"), "pre_token")
            .groupBy("row_key").agg(F.sum(F.col("n") * F.col("pieces")).alias("n")))
    tokens = (parts.filter("pre_token IS NULL").select("row_key", "n").unionByName(cold)
              .groupBy("row_key").agg(F.sum("n").alias("n_tokens")))
    rows = keyed.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return (rows.join(tokens, "row_key").drop("row_key").withColumn("over_limit", F.col("n_tokens") > limit)
            .select(*keep, *[c for c in ("text",) if c in docs.columns], "n_bytes", "n_tokens", "over_limit"))

import hashlib
import random

from pyspark.sql import types as T

from ledgerspark.llm import suffix_dedup
from tests.llm.helpers import DOCS, folder, prose, table


def plain(data, length=100):
    seen, out = set(), {}
    for i, t in sorted(data, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_query_against_all_strings(spark, tmp_path):
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abc é") for _ in range(rnd.randint(60, 260))) for _ in range(12)]
    data = []
    for i in range(80):
        t = ""
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(pool)
            t += p[rnd.randint(0, 40) : len(p) - rnd.randint(0, 40)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 5)))
        data.append((i, [t, None, "a" * rnd.randint(0, 400), rnd.choice(pool) * 3][rnd.choice([0] * 8 + [1, 2, 3])]))
    data.append((None, pool[0] + pool[1]))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in data], DOCS).repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.query(spark, folder(spark, tmp_path, docs)).collect()}
    assert got == plain(data)


def test_text_longer_than_a_part(spark, tmp_path):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh") for _ in range(1_300_000))
    data = [(1, long), (2, "start " + long[1_000_000:1_100_000] + " end"), (3, long[:50] + long[:99])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in data], DOCS)
    got = {r["doc_id"]: tuple(r)[1:4] for r in suffix_dedup.query(spark, folder(spark, tmp_path, docs)).collect()}
    assert got == {1: (1_300_000, 0, 0), 2: (100_010, 100_000, 1), 3: (149, 0, 0)}


def test_repeated_rows_are_one_document(spark):
    t = prose(1, 80)
    kind = T.StructType([T.StructField("gone", T.LongType())])
    docs = spark.createDataFrame([(5, t), (5, t), (6, t), (None, t)], "doc_id long, text string")
    got = suffix_dedup.deduplicated(docs, lambda raw, kept, runs: {"gone": len(raw) - len(kept)}, kind).collect()
    n = len(t.encode())
    assert sorted((str(r["doc_id"]), r["gone"]) for r in got) == [("5", 0), ("5", 0), ("6", n), ("None", n)]


def test_stage_keeps_columns_and_characters(spark):
    docs = table(spark, extra=("row", "doc", "tag", "spans"))
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert suffix_dedup.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_merged_spans():
    import numpy as np

    s, e = suffix_dedup.merged(np.array([5, 0, 20, 3]), np.array([9, 4, 30, 5]))
    assert s.tolist() == [0, 20] and e.tolist() == [9, 30]


def test_texts_without_id_are_told_apart_by_whole_digests(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(400)]
    shared = " ".join(words[:14])
    made = [(k, (shared + " " if k % 2 else "") + " ".join(f"{w}{k}" for w in words[20:44])) for k in range(24_000)]
    low, found = {}, None
    for r in spark.createDataFrame(made, "k long, t string").select("k", "t", F.xxhash64("t").alias("h")).collect():
        other = low.setdefault(r["h"] & 0xFFFFFF, r)
        if (other["k"] - r["k"]) % 2:
            found = [other["t"], r["t"]]
            break
    assert found  # two texts that agree in the low 24 bits of their digests
    kind = T.StructType([T.StructField("gone", T.LongType())])
    docs = spark.createDataFrame([(1, shared), *((None, t) for t in found)], "doc_id long, text string")
    got = suffix_dedup.deduplicated(docs.withColumn("has", F.col("text").startswith(shared)), lambda raw, kept, runs: {"gone": len(raw) - len(kept)}, kind)
    assert sorted((r["doc_id"] or 0, r["has"], r["gone"]) for r in got.collect()) == [(0, False, 0), (0, True, len(shared)), (1, True, 0)]


def test_multikey_order():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, levels in ((0, 2), (1, 2), (33, 2), (4000, 3), (60_000, 1 << 40), (60_000, 20)):
        words = rng.integers(0, levels, (n, 4)).astype(np.uint64)
        words[: n // 3] = 7  # a third of all rows is equal
        order = suffix_dedup.multikey_order(words)
        assert sorted(order.tolist()) == list(range(n)) and (words[order] == words[np.lexsort(words.T[::-1])]).all()
    texts = [b"banana split", b"banana", b"bananas", b"", b"an apple a day keeps"]
    words = np.stack([np.concatenate(c) for c in zip(*(suffix_dedup.lead_words(t, np.array([0])) for t in texts))], 1)
    assert [texts[k] for k in suffix_dedup.multikey_order(words)] == sorted(texts)


def test_a_lead_that_spans_buckets(spark, tmp_path, monkeypatch):
    """One line in every text, between texts that differ and partly agree: its suffixes are more than a bucket."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    line = " ".join(word() for _ in range(9))
    ends = [" ".join(word() for _ in range(8)) for _ in range(6)]
    data = [(i, f"{word()} {rnd.choice(ends)} {line} {rnd.choice(ends)[: rnd.randint(20, 60)]} {word()}") for i in range(300)]
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 40)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in data], DOCS).repartition(5)
    assert suffix_dedup.splitters(docs, 4, 100, 16)[1]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.query(spark, folder(spark, tmp_path, docs)).collect()}
    assert got == plain(data)


def test_empty_table(spark, tmp_path):
    assert suffix_dedup.query(spark, folder(spark, tmp_path, table(spark, []))).count() == 0

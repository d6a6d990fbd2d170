"""The pipeline against plain versions of its stages, and every stage on awkward tables."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from ledgerspark.llm import quality
from tests.llm.helpers import DOCS, folder, prose, table
from tests.llm.test_simhash import shingles


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    good = [(k, prose(k, 40 + k), "en", f"s{k % 3}", 1) for k in range(40)]
    copies = [(50 + k, prose(k, 40 + k), "en", "s1", 1) for k in range(5)]
    shared = [(60 + k, prose(70 + k, 30) + " " + prose(200, 60), "en", "s2", 1) for k in range(6)]
    bad = [(100 + k, "!!! ### " * (20 + k) + "BUY " * k, "en", "s0", 1) for k in range(40)]
    docs = table(spark, [*good, *copies, *shared, *bad])
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in [*good, *bad]], "doc_id long, quality int, toxic int")
    return folder(spark, tmp_path_factory.mktemp("corpus"), docs, labels=labels)


def test_stages_against_plain_versions(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        made[name] = docs.collect()
        if name != "batches":
            assert docs.columns == columns
        if name == "quality":
            kept = {r["doc_id"] for r in quality.query(spark, corpus).collect() if r["predicted"] == 1}
            assert {r["doc_id"] for r in made[name]} == kept and not kept & set(range(100, 140)) and len(kept) > 40
        if name == "near_duplicates":
            kept = sorted(r["doc_id"] for r in made[name])
            sets = {i: shingles(t) for i, t in before.items()}
            like = lambda a, b: len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5  # noqa: B023, E731
            assert all(like(a, b) < 0.8 for a in kept for b in kept if a < b)
            assert all(any(like(a, b) >= 0.8 for b in kept if b < a) for a in set(before) - set(kept))
        if name == "repeats":
            seen = set()
            want = {}
            for i in sorted(before):
                raw = before[i].encode()
                gone = bytearray(len(raw))
                for p in range(len(raw) - 99):
                    s = raw[p : p + 100]
                    if s in seen:
                        gone[p : p + 100] = b"\1" * 100
                    seen.add(s)
                want[i] = bytes(b for b, g in zip(raw, gone) if not g).decode()
            assert {r["doc_id"]: r["text"] for r in made[name]} == want
        if name == "mixture":
            times = Counter(r["doc_id"] for r in made[name])
            assert set(times) <= set(before) and max(times.values()) <= 2
    words = sum(len(r["text"].split()) for r in made["mixture"])
    assert sum(r["length"] for r in made["batches"]) == words


def test_run_is_its_stages(spark, corpus):
    one = corpus_pipeline.run(spark, corpus)
    again = corpus_pipeline.run(spark, corpus)
    digest = lambda df: hashlib.sha256(str(sorted(tuple(map(str, r)) for r in df.collect())).encode()).hexdigest()
    assert digest(one) == digest(again)


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, None), (None, None, None)], "doc_id long, quality int, toxic int")
    d = folder(spark, tmp_path, table(spark), labels=labels)
    for docs in (table(spark, extra=("score", "row", "mix_pass", "kept_id", "stats", "size")), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            assert (out.count() == 0) == docs.isEmpty() or name == "quality"
            if name != "batches":
                assert out.columns == docs.columns

"""Language identification by bit-sliced Bloom filters over character n-grams.

Every letter of a lower-cased text, with its two neighbours (anything but a letter counts as a space), is one n-gram.
Learning counts n-grams per language over all labelled rows, keeps for each language those whose rate there
is at least ``SHARE`` of their best rate in any language, and sets them in a Bloom filter per language. The
filters are bit-sliced: one slot array of language bit masks, so ANDing the ``HASHES`` slots of an n-gram returns
all languages that contain it at once. A text's n-grams are looked up, per-language popcounts become shares,
each is corrected for that language's false-positive rate, and the largest decides.

The slot array has at most 2^``SLOTS_LOG2`` slots and ``MODEL_WORDS`` words in all, whatever the corpus and however many languages; only it
and the list of languages go through the driver. A filter is filled to ``FILL`` n-grams a slot at most: of a language with more, the
most frequent ones are kept, and of those at the edge a share by digest. Counts and filter bits are gathered by shuffles
after partial sums in each task.

Defined cases: null text, or text without a letter: ``und`` and score 0. Nothing learned: ``und``, 0. No known
n-gram: the language with most learned n-grams, score 0. Ties: the first language in code point order. Null
``lang`` rows are not learned from; repeated rows count as often as they occur. A null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices, table

SLOTS_LOG2, MODEL_WORDS = 20, 1 << 23
FILL = 1 / 8  # with three hashes three slots in ten are set, and three foreign n-grams in a hundred are taken for known
SHARE = 0.3
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
HASHES = len(_MULTIPLIERS)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts as 64-bit codes, and the text that each belongs to."""
    codes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    letter = _letters()
    for i, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[points]
        points = np.where(is_letter, points, np.uint32(32)).astype(np.uint64)
        at = np.flatnonzero(is_letter)
        if len(at):
            codes.append(points[at - 1] << np.uint64(42) | points[at] << np.uint64(21) | points[at + 1])
            owners.append(np.full(len(at), i))
    return np.concatenate(codes), np.concatenate(owners)


def slots(codes: np.ndarray, log2: int) -> list[np.ndarray]:
    mixed = codes ^ (codes >> np.uint64(23))
    return [((mixed * m) ^ (mixed >> np.uint64(7)) * m >> np.uint64(17)) * _MULTIPLIERS[0] >> np.uint64(64 - log2) for m in _MULTIPLIERS]


def ngram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, gram, n`` over all rows, summed in each task before the shuffle."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for b in slices(batches):
            texts: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                found = np.unique(ngrams(own)[0], return_counts=True)
                held.setdefault(lang, []).append(found)
                size += len(found[0])
            if size > 1 << 20:
                held = {lang: [merge(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > 1 << 19:  # more n-grams than a task should hold: hand them on
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The learned slot array, its languages and their false-positive rates."""

    def __init__(self, langs: list[str], masks: np.ndarray, sizes: list[int]):
        self.langs, self.masks, self.sizes = langs, masks, sizes
        fill = [np.count_nonzero(masks[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) / len(masks) for i in range(len(langs))]
        self.false_rate = np.array(fill) ** HASHES
        self.usual = int(np.argmax(sizes)) if langs else 0

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes, owners = ngrams(texts)
        n = np.bincount(owners, minlength=len(texts))
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        shares = np.zeros((len(texts), len(self.langs)))
        at = slots(codes, len(self.masks).bit_length() - 1)
        for w in range(self.masks.shape[1]):
            column = self.masks[:, w]
            hit = column[at[0]]
            for s in at[1:]:
                hit &= column[s]
            for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                own = owners[(hit >> np.uint64(i & 63) & np.uint64(1)).astype(bool)]
                shares[:, i] = np.bincount(own, minlength=len(texts))
        shares = shares / np.maximum(n, 1)[:, None]
        shares = np.clip((shares - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        total = shares.sum(1)
        best = np.where(total > 0, shares.argmax(1), self.usual)
        scores = np.where(total > 0, shares.max(1) / np.where(total > 0, total, 1), 0.0)
        return [self.langs[k] if m else "und" for k, m in zip(best.tolist(), n.tolist())], np.where(n > 0, scores, 0.0).tolist()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Count, select and set the n-grams of every language of ``docs``."""
    spark = docs.sparkSession
    counts = cut(ngram_counts(docs, text_col, lang_col))
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # a row a language, as the model has
    langs = sorted(totals)
    width = max(1, -(-len(langs) // 64))
    log2 = max(10, min(SLOTS_LOG2, (MODEL_WORDS // width).bit_length() - 1))
    known = spark.createDataFrame([(lang, i, 1.0 / totals[lang]) for i, lang in enumerate(langs)], "lang string, place int, weight double")
    rated = counts.join(known, "lang").select("gram", F.struct("place", "n", (F.col("n") * F.col("weight")).alias("rate")).alias("own"))
    typical = (
        rated.groupBy("gram")
        .agg(F.collect_list("own").alias("own"), F.max("own.rate").alias("best"))  # at most one entry a language
        .select("gram", F.explode(F.expr(f"filter(own, x -> x.rate >= best * {SHARE})")).alias("x"))
        .select("gram", "x.place", "x.n")
    )
    typical = cut(typical)
    kept = typical.join(_edges(typical, int(FILL * (1 << log2))), "place", "left")
    digest = F.pmod(F.xxhash64("gram"), F.lit(1 << 20)) / (1 << 20)
    kept = kept.where(F.col("edge").isNull() | (F.col("n") > F.col("edge")) | (F.col("n") == F.col("edge")) & (digest < F.col("share"))).select("gram", "place")

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, place = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy().astype(np.int64)
            masks = np.uint64(1) << (place & 63).astype(np.uint64)
            for s in slots(codes, log2):
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64) * width + (place >> 6)), pa.array(masks.view(np.int64))], names=["slot", "mask"])

    set_ = kept.mapInArrow(set_bits, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most the slot array
    sizes = {r["place"]: r["n"] for r in kept.groupBy("place").agg(F.count("*").alias("n")).collect()}
    masks = np.zeros((1 << log2) * width, np.uint64)
    masks[set_.column("slot").to_numpy()] = set_.column("mask").to_numpy().view(np.uint64)
    return Filters(langs, masks.reshape(-1, width), [sizes.get(i, 0) for i in range(len(langs))])


def _edges(typical: DataFrame, most: int) -> DataFrame:
    """For languages with more than ``most`` n-grams: the count at which they are cut (``edge``), and which share of the n-grams of just that count stays."""
    counts = typical.groupBy("place", "n").agg(F.count("*").alias("grams"))  # as many rows as different counts
    down = W.partitionBy("place").orderBy(F.desc("n"))
    upto = counts.withColumn("upto", F.sum("grams").over(down)).where(F.col("upto") > most)
    edge = upto.groupBy("place").agg(F.max(F.struct("n", "upto", "grams")).alias("x"))
    return edge.select("place", F.col("x.n").alias("edge"), ((most - (F.col("x.upto") - F.col("x.grams"))) / F.col("x.grams")).alias("share"))


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score``."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters)
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            pred, score = shipped.value.score(b.column(len(others)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*others, "lang_pred", "score"])

    from pyspark.sql import types as T

    kind = T.StructType([*(f for f in rows.schema.fields if f.name != text_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the rows that are not held out, predict every whole text."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held)
    filters = learn(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), filters)

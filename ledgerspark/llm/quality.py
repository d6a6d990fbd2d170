"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a vector of transformed statistics (shares of letters, digits, symbols and the like, lengths on
a log scale, repetition and compressibility). The fewer words a text has, the more its vector is drawn to the average
of the labelled ones, so that the chance values of a short text do not reject it. Learning gathers counts, sums and products per class over all
labelled rows in one aggregation, shrinks each class covariance towards the pooled one and its diagonal, and keeps the
Cholesky factor of its inverse. A score is the logistic of the difference of Mahalanobis log-densities plus
the log prior ratio.

Only ``2 * (1 + d + d * d)`` numbers reach the driver and two cached factors go out, whatever the corpus.

Defined cases: null text counts as empty; an empty text has a score like any other. No labelled rows: 0.5 for
every text. Rows of one class only: that class's share. Null labels are not learned from; repeated rows count as often
as they occur; a null doc_id is not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, table

POOLED, RIDGE = 0.2, 0.05
#: Words at which a text's statistics count half against the average text's: short texts say little.
HALF_WORDS = 10
_PUNCT = b".,;:'\"-?!()"


def _kinds() -> np.ndarray:
    """Per byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 punctuation, 6 symbol, 7 not ASCII."""
    kind = np.full(256, 6, np.uint8)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[9, 11, 12, 13, 32]] = 3
    kind[10] = 4
    kind[list(_PUNCT)] = 5
    kind[128:] = 7
    return kind


_KIND = _kinds()
NAMES = ["words", "word_length", "word_spread", "upper", "digits", "symbols", "punctuation", "lines", "distinct", "repeated_lines", "entropy", "compressed", "long_words", "bare_words", "first_share"]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``NAMES``."""
    raw = (text or "").encode()
    size = max(len(raw), 1)
    b = np.frombuffer(raw, np.uint8)
    kinds = _KIND[b]
    n = np.bincount(kinds, minlength=8) / size
    blank = np.flatnonzero((kinds == 3) | (kinds == 4))
    gaps = np.diff(np.concatenate(([-1], blank, [len(b)]))) - 1
    gaps = gaps[gaps > 0]
    words = (text or "").split()
    count = max(len(words), 1)
    lines = (text or "").split("\n")
    share = np.bincount(b, minlength=256) / size
    share = share[share > 0]
    letters = n[0] + n[1] + n[7]
    distinct = set(words)
    ends = sum(map(str.isalpha, distinct)) / max(len(distinct), 1)
    return [
        np.log1p(len(words)),
        np.log1p(gaps.mean() if len(gaps) else 0.0),
        np.log1p(gaps.std() if len(gaps) else 0.0),
        np.sqrt(n[1] / letters) if letters else 0.0,
        np.sqrt(n[2]),
        np.sqrt(n[6]),
        np.sqrt(n[5]),
        np.sqrt(n[4]),
        np.log1p(len(distinct)) / np.log1p(count),
        1 - sum(map(len, set(lines))) / max(sum(map(len, lines)), 1),
        -float((share * np.log2(share)).sum()),
        np.log(max(len(zlib.compress(raw, 1)), 1) / size),
        np.sqrt((gaps > 20).mean()) if len(gaps) else 0.0,
        ends,
        np.sqrt(share.max()) if len(share) else 0.0,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the vector ``stats``."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = [statistics(t) for t in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], names=[*others, "stats"])

    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema.fields if f.name != text_col), T.StructField("stats", T.ArrayType(T.DoubleType()))]))


def drawn(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    words = np.expm1(x[:, :1])
    return centre + (x - centre) * (words / (words + HALF_WORDS))


@dataclass
class Model:
    """Class means, Cholesky factors of the inverse covariances, and the log prior ratio; or a constant score."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offset: float
    constant: float | None = None
    centre: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        x = drawn(x, self.centre)
        away = [(((x - m) @ f) ** 2).sum(1) for m, f in zip(self.means, self.factors)]
        return 1 / (1 + np.exp(-np.clip(self.offset + 0.5 * (away[0] - away[1]), -60, 60)))


def learn(labelled: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """Fit to ``stats, label`` rows (label 0 or 1) from moments summed over all of them."""
    d = len(NAMES)
    rows = labelled.select("stats", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    centre = np.array([0.0 if v is None else v for v in rows.select(*(F.avg(F.col("stats")[k]) for k in range(d))).first()])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            x = drawn(np.array(b.column(0).to_pylist()), centre)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        k = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums.ravel())], names=["k", "v"])

    sums = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums.ravel()[r["k"]] = r["v"]
    n = sums[:, 0]
    if not n.all():
        return Model(None, None, 0.0, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums[:, 1 : 1 + d] / n[:, None]
    own = sums[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    both = (own * n[:, None, None]).sum(0) / n.sum()
    scale = np.diag(np.maximum(np.diag(both), 1e-6))
    spread = (1 - pooled) * own + pooled * both
    spread = (1 - ridge) * spread + ridge * scale
    factors = np.array([np.linalg.cholesky(np.linalg.inv(s)) for s in spread])
    logdet = [np.linalg.slogdet(s)[1] for s in spread]
    return Model(means, factors, float(np.log(n[1] / n[0]) + 0.5 * (logdet[0] - logdet[1])), None, centre)


def apply(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` rows without their vector, with ``score``."""
    others = [c for c in stats.columns if c != "stats"]
    shipped = stats.sparkSession.sparkContext.broadcast(model)
    rows = stats.select(*others, "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array(b.column(len(others)).to_pylist()).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shipped.value.score(x))], names=[*others, "score"])

    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema.fields if f.name != "stats"), T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, learned from the rows not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    stats = cut(with_statistics(docs.select("doc_id", held.alias("held_out"), "text")))
    known = labels.select("doc_id", F.col("quality").alias("label")).where("label is not null")
    model = learn(stats.where(~F.col("held_out")).join(known, "doc_id"))
    return apply(stats, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The whole rows of ``docs`` whose score is at least ``least``; the texts pass by twice and are never shuffled."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    stats = cut(with_statistics(docs.select("doc_id", held.alias("held_out"), F.col(text_col).alias("text"))))
    known = labels.select("doc_id", F.col("quality").alias("label")).where("label is not null")
    shipped = docs.sparkSession.sparkContext.broadcast(learn(stats.where(~F.col("held_out")).join(known, "doc_id")))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(b.num_rows, len(NAMES))
            yield b.filter(pa.array(shipped.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

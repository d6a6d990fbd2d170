"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

Words are counted by Spark. Each word's deletions then become integers: with the polynomial hashes of all its prefixes and suffixes,
that of the word without its letter ``i`` is ``prefix[i] * BASE**rest + suffix[i + 1]``, so that NumPy forms all deletions of all words of one length
at once and no shortened string is built. Two words that differ by a replaced letter have the same deletion at the same place (a hole);
a word is a deletion of each one with a letter more. Keys are dealt by their leading bits and sorted, and runs of equal keys stay. Their words'
strings are fetched only then, and rows meet again by the shortened string itself, so that a collision of hashes groups nothing.

A hole's words differ from each other in one letter only, so a group is no larger than the alphabet, and no pairs are written: a word's
neighbours in a group are counted, and the most frequent of them is the group's first or second. The keys of a word carry its
name of 128 bits, not its text, so that a word of a million letters costs a million numbers, not their square.

Defined cases: a null text has no words, a null doc_id counts as an empty string before the colon. Letters are those of ``LETTERS``; only A-Z are lower-cased. Rows of one
doc_id are rows of their own. Ties among forms: the first in code-point order. Extra columns are not read. Empty table: empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, cut_to, discard, lowered, scratch, table

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: How many times as frequent as a word its form is at least.
TIMES = 5
#: One run in so many loses a letter, as the digest of its document and itself says.
SLIPS = 199
BASE = np.uint64(0x9E3779B97F4A7C15)
#: What a key stands for: the word itself, the word less a letter, the word with a hole.
WHOLE, LESS, HOLE = 0, 1, 2
RADIX_BITS = 16


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, without a letter where its digest says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(SLIPS)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all words that are long and frequent enough. Shorter runs make no such word and are not even exploded."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    found = runs.select("doc_id", lowered(F.col("run")).alias("run")).select(slipped(F.col("doc_id"), F.col("run")).alias("word"))
    return found.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.full(n, BASE).cumprod(dtype=np.uint64)))


def _mixed(h: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    """Hashes mixed with small numbers, their bits spread evenly: keys are dealt by the leading ones."""
    for k, m in enumerate(more):
        h = (h + np.asarray(m).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(29))
    return h


def deletion_keys(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """``rows, key, place, role`` for words of one length, a row of code points each: whole, then place by place."""
    count, n = codes.shape
    power = powers(n)
    codes = codes.astype(np.uint64)
    suffix = np.zeros((n + 1, count), np.uint64)
    for k in range(n - 1, -1, -1):
        suffix[k] = codes[:, k] * power[n - 1 - k] + suffix[k + 1]
    rows = np.arange(count)
    yield rows, _mixed(suffix[0], n, WHOLE), -1, WHOLE
    prefix = np.zeros(count, np.uint64)
    for k in range(n):
        left = prefix * power[n - 1 - k] + suffix[k + 1]
        yield rows, _mixed(left, n, HOLE, k), k, HOLE
        first = rows if k == 0 else np.flatnonzero(codes[:, k] != codes[:, k - 1])  # of equal letters in a row one stands for all
        yield first, _mixed(left[first], n - 1, WHOLE), k, LESS
        prefix = prefix * BASE + codes[:, k]


def keys(named: DataFrame, bits: int = 64) -> DataFrame:
    """``key, role, place, a, b`` for the rows ``word, a, b``: all deletions of every word, which ``a`` and ``b`` name. Keys keep their leading ``bits``."""
    mask = np.uint64((1 << 64) - (1 << (64 - bits)))
    kind = pa.schema([("key", pa.int64()), ("role", pa.int8()), ("place", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                flat = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in b.column(0).to_pylist()]
                names = [b.column(k).to_numpy() for k in (1, 2)]
                lengths = np.array([len(f) for f in flat])
                for n in np.unique(lengths).tolist():
                    same = np.flatnonzero(lengths == n)
                    step = max(1, (1 << 20) // n)  # cells of a block
                    for at in (same[k : k + step] for k in range(0, len(same), step)):
                        for rows, key, place, role in deletion_keys(np.stack([flat[i] for i in at])):
                            own = at[rows]
                            yield pa.RecordBatch.from_arrays([pa.array((key & mask).view(np.int64)), pa.array(np.full(len(own), role, np.int8)), pa.array(np.full(len(own), place, np.int32)), *(pa.array(x[own]) for x in names)], schema=kind)

    return named.select("word", "a", "b").mapInArrow(run, "key long, role byte, place int, a long, b long")


def shared(found: DataFrame) -> DataFrame:
    """Of the ``keys`` those that others share, and by which words can be near: holes of two words, or a word and what is one letter longer."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kept(t: pa.Table) -> pa.Table:
        key, role = t.column("key").to_numpy(), t.column("role").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        good = (sizes > 1) & ((role[starts] == WHOLE) | (np.maximum.reduceat(role, starts) == HOLE))
        return t.filter(pa.array(np.repeat(good, sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of a key that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = t.column("key").to_numpy()
            ends = np.flatnonzero(key[1:] != key[:-1])
            end = int(ends[-1]) + 1 if len(ends) else 0
            if end:
                yield from kept(t.slice(0, end)).to_batches()
            held = t.slice(end)
        if held is not None:
            yield from kept(held).to_batches()

    dealt = found.repartition(parts, F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "role")
    return dealt.mapInArrow(run, found.schema)


def neighbours(counted: DataFrame, bits: int = 64) -> DataFrame:
    """``word, n_near, best`` (``less``: the negative of its count, and the ``word``) for the words of ``word, n`` that have any near word."""
    named = counted.select("word", "n", F.xxhash64("word").alias("a"), F.xxhash64(F.lit("second"), "word").alias("b"))
    members = shared(keys(named, bits)).join(named, ["a", "b"])
    end = F.length("word")
    less = F.concat(F.substring("word", F.lit(1), F.col("place")), F.when(F.col("role") == HOLE, "*").otherwise(""), F.substring("word", F.col("place") + 2, end))
    text = F.when(F.col("role") == WHOLE, F.col("word")).otherwise(less)
    members = members.select("word", "n", (F.col("role") == WHOLE).alias("whole"), (F.col("role") == HOLE).alias("hole"), text.alias("text"), F.struct((-F.col("n")).alias("less"), "word").alias("own"))
    group = W.partitionBy("hole", "text").orderBy(F.desc("whole"), "own").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = members.select("*", F.count("*").over(group).alias("size"), F.first("own").over(group).alias("first"), F.nth_value("own", 2).over(group).alias("second"), F.first("whole").over(group).alias("has_whole"))
    other = F.when(F.col("own") == F.col("first"), F.col("second")).otherwise(F.col("first"))  # the whole word comes first, and its second is the most frequent one
    near = F.when(F.col("hole") | F.col("whole"), F.col("size") - 1).when(F.col("has_whole"), 1).otherwise(0)
    pairs = met.select("word", near.cast("long").alias("near"), other.alias("other")).where("near > 0")
    return pairs.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("other").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the links ``word, form``: where following forms ends. Forms are ever more frequent, so that paths are short; each round doubles the steps."""
    spark, at, held = forms.sparkSession, forms.select("word", F.col("form").alias("root")), None
    while True:
        at, path = cut_to(at)
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        if held:
            discard(spark, held)
        held = path
        if not moved.where("moved").limit(1).count():
            return at
        at = moved.drop("moved")


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES, bits: int = 64) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word; ``bits`` of the keys change what collides, never the result."""
    with scratch(docs.sparkSession):
        counted = cut(words(docs, least_count))
        near = counted.join(neighbours(counted, bits), "word", "left")
        good = -F.col("best.less") >= times * F.col("n")
        linked = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")))
        ends = roots(linked.where("form IS NOT NULL"))
        return cut(linked.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), kept=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents."""
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def _crc_table() -> list[int]:
    table_ = list(range(256))
    for _ in range(8):
        table_ = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table_]
    return table_


ORACLE = rf"""
WITH RECURSIVE codes AS (SELECT {_crc_table()}::BIGINT[] AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents),
counts AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
bytes AS (SELECT *, list_transform(string_split(regexp_replace(hex(encode(doc || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT) AS b FROM counts),
digests AS (SELECT doc, run, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, codes),
found AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM digests),
words AS (SELECT word, sum(n)::BIGINT AS n FROM found WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words),
less AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM places),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.short = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM near),
forms AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= {TIMES} * w.n THEN r.other END AS form, CASE WHEN r.n >= {TIMES} * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""

"""SpotSigs document fingerprints.

Words are lower-cased runs of letters and digits. Each common word is an anchor; the chain of the next ``CHAIN`` content words
(words that are not anchors) after it, with the anchor, is a signature. A fingerprint is the set of a text's signatures,
kept as sorted 32-bit digests. Likeness is the Jaccard coefficient of two sets, which the ratio of their sizes bounds.

In a run of more than ``RUN`` content words without an anchor (lists, other languages) each further word is its own anchor.
A text that makes no whole chain so gets a chain at every word instead; one with fewer words than a chain, a single
signature of the whole text, so only equal short texts are alike.

``near_groups`` finds near-duplicates: sets are partitioned by length, and the signatures of a set dealt over more parts than two alike sets
may differ in; those that have one of the rarest parts of both in common, all of its signatures, are candidates, unless their sketches rule it out: for two sets of n and m signatures whose parity bits differ in d places, no more
than (n + m - d) / 2 are common. A group is what links of a Jaccard coefficient of ``LEAST`` or more reach. Every link is compared on the whole sets, and only those
that hold join anything. Some turns look for a few links a set, so that a large group is one soon; the last looks at every pair of candidates left apart.

``with_next`` brings documents and their successors together: ids are range-partitioned at quantiles, sorted in each range,
and read in order; the row that tops a range is also sent to the range before it in order. No window spans the table.

Defined cases: a null text counts as empty; two empty texts are alike (1.0). A table of one row is its own successor.
Null doc_ids come last, among themselves by text, descending, as do rows of one doc_id: each row is followed by the next in that order, a repeated row by itself.
The class of a group is its least doc_id, null if only null ids are in it. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # twice as fast on short strings
    from _md5 import md5
except ImportError:
    from hashlib import md5

from .common import cut, cut_to, discard, map_columns, scratch, slices, table
from .near import CHUNK, pairs
from .simhash import checked, united

CHAIN = 2
RUN = 8
LEAST = 0.8
#: Cells of the table of how often signatures occur, which ranks them; signatures that share a cell share a rank's count.
CELLS_LOG2 = 16
#: Words of 64 bits of a set's sketch; turns that look for a few links a set; sets above which a cell's signatures count as shared.
SKETCH, SPANNING, HEAVY = 8, 3, 20_000
#: Parts that a set's signatures are dealt over, besides two for each that may differ.
SPARE = 6
#: Common words of English, German, French and Spanish.
ANCHORS = frozenset("the a an of and to in is was that der die das und ist zu den le la les de et un une est el los las y en es".split())
_WORD = re.compile(r"[^\W_]+")


#: Of ASCII: letters in lower case, digits, and spaces for all else.
_ASCII = {k: chr(k).lower() if chr(k).isalnum() else " " for k in range(128)}


def _words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    if text.isascii():
        return text.translate(_ASCII).split()
    text = text.lower()
    for c in string.punctuation:
        text = text.replace(c, " ")
    parts = text.split()
    if all(map(str.isalnum, parts)):
        return parts
    return [w for p in parts for w in ((p,) if p.isalnum() else _WORD.findall(p))]


def signatures(text: str | None, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> np.ndarray:
    """The fingerprint: sorted distinct 32-bit digests (of MD5 the first)."""
    words = _words(text or "")
    content = [w for w in words if w not in anchors]
    spots = [i for i, w in enumerate(words) if w in anchors]
    ends = [i - k for k, i in enumerate(spots)]  # content words before each anchor
    whole = ends[: bisect_right(ends, len(content) - chain)]  # of the anchors that a whole chain follows
    found = set(map(" ".join, zip([words[i] for i in spots[: len(whole)]], *([content[at + k] for at in whole] for k in range(chain)))))
    for a, b in zip([0, *ends], [*ends, len(content)]):
        if b - a > RUN:  # further words of a run are anchors themselves
            found.update(map(" ".join, zip(*(content[a + RUN + k : b + k] for k in range(chain + 1)))))
    if not found:
        found = {" ".join(words[k : k + chain + 1]) for k in range(len(words) - chain)}
    parts = "\n".join(found).encode().split(b"\n") if found else [(text or "").encode("utf-8", "replace")]  # no word has a line end
    return np.unique(np.frombuffer(b"".join([md5(s).digest() for s in parts]), ">u4")[::4].astype(np.uint32))


def as_text(signs: np.ndarray) -> str:
    return signs.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient; 0 without a look at the sets if their sizes alone keep it under ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def with_next(docs: DataFrame, notes: DataFrame, run, schema: str, ranges: int) -> DataFrame:
    """Feed ``run`` the ``doc_id, text, edge, range, node, class_id`` rows of each range in order: descending ids, then the row that follows.

    Before the rows of a doc_id come its ``notes`` (``doc_id, node, class_id``), whose text is null and whose node is not.
    """
    at = [(k + 1) / ranges for k in range(ranges - 1)]
    known = docs.agg(F.percentile_approx("doc_id", at or [0.5], 10 * ranges).alias("at"), F.max("doc_id").alias("top"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    tops = sorted({s for s in known["at"] or [] if s != known["top"]}) if at else []
    bounds = F.array(*(F.lit(s) for s in tops)).cast("array<bigint>")
    # ranges by rising id from 0; null ids are range -1
    own = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda s: s < F.col("doc_id"))))
    bottom = -1 if known["nulls"] else 0
    follows = F.when(F.col("doc_id") == known["top"], bottom).when(F.array_contains(bounds, F.col("doc_id")), F.col("own") + 1)
    follows = F.when(F.col("doc_id").isNull(), 0 if known["top"] is not None else -1).otherwise(follows)
    parts = F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("edge")), F.struct(follows.alias("range"), F.lit(1).alias("edge")))
    dealt = docs.withColumn("own", own).select("doc_id", "text", F.explode(F.filter(parts, lambda p: p["range"].isNotNull())).alias("part")).select("doc_id", "text", "part.*")
    noted = notes.select("doc_id", F.lit(None).cast("string").alias("text"), own.alias("range"), F.lit(0).alias("edge"), "node", "class_id")
    dealt = dealt.unionByName(noted, allowMissingColumns=True).repartition(max(1, len(tops) + 2), "range")
    dealt = dealt.sortWithinPartitions("range", "edge", F.col("doc_id").desc_nulls_last(), F.col("node").isNull(), F.col("text").desc_nulls_last())
    return dealt.select("doc_id", "text", "edge", "range", "node", "class_id").mapInArrow(run, schema)


def node_of(signs: np.ndarray) -> int:
    """What names a fingerprint: 64 bits of digest, as a signed number."""
    h = xxhash.xxh64_intdigest(signs.tobytes())
    return h - (1 << 64) if h >> 63 else h


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, node, signs`` of every row, the signatures as an array of ints."""

    def run(ids, texts):
        found = [signatures(t) for t in texts]
        return {"doc_id": ids, "node": [node_of(x) for x in found], "signs": [x.view(np.int32) for x in found]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, node long, signs array<int>")


def cell_loads(classes: DataFrame) -> np.ndarray:
    """How many sets have a signature in each cell, a cell being a signature's leading bits; and last, how many sets there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << CELLS_LOG2) + 1, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).flatten().to_numpy().view(np.uint32) >> (32 - CELLS_LOG2), minlength=len(held))
            held[-1] += b.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["cell", "n"])

    found = classes.select("signs").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most the cells
    loads = np.zeros((1 << CELLS_LOG2) + 1, np.int64)
    loads[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return loads


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of each number (SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def apart_at_most(least: float, length: np.ndarray) -> np.ndarray:
    """In how many signatures two sets of that likeness differ at most, the longer of which is in a partition by length."""
    longest = np.floor((1 / least) ** (length + 1) * (1 + 1e-8))
    return np.floor(2 * longest * (1 - least) / (1 + least) + 1e-9).astype(np.int64)


def part_keys(node: np.ndarray, signs: np.ndarray, sizes: np.ndarray, loads: np.ndarray, least: float, heavy: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``key, node, known`` of some sets, whose signatures follow one another: first those of their own partition, then of the next."""
    load = loads[signs >> (32 - CELLS_LOG2)]
    worth = np.maximum(1024 * np.log2((loads[-1] + 1) / load), 0).astype(np.int64) + 1  # whole numbers: equal parts have equal sums in any order
    digest = mixed(signs.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    own = np.floor(np.log(sizes) / np.log(1 / least) + 1e-9).astype(np.int64)
    for length in (own, own + 1):
        apart = apart_at_most(least, length)
        parts = np.where(apart > 0, 2 * apart + SPARE, 0)  # where nothing may differ there is nothing to find
        first = np.cumsum(parts) - parts
        of = np.repeat(np.arange(len(sizes)), sizes)
        some = apart[of] > 0
        at = (first[of] + (digest >> np.uint64(32)).astype(np.int64) % np.maximum(parts[of], 1))[some]
        total = int(parts.sum())
        sums, value, rarest = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
        np.add.at(sums, at, digest[some])
        np.add.at(value, at, worth[some])
        np.minimum.at(rarest, at, load[some])
        whose = np.repeat(np.arange(len(sizes)), parts)
        place = np.arange(total) - first[whose]
        key = mixed(sums + mixed((length[whose] << 40 | place).astype(np.uint64))).view(np.int64)
        order = np.lexsort((key, -value, whose))
        took = order[place <= apart[whose]]  # rows are as many and by set before and after sorting
        yield key[took], node[whose[took]], rarest[took] > heavy


def prefix_keys(classes: DataFrame, least: float, heavy: int = HEAVY) -> DataFrame:
    """``key, node``: the rarest parts of every set in its partition by length and the next, where another set has them too.

    Signatures are dealt over parts by a digest, and a key names a part with all its signatures. Two sets of that likeness
    differ in d signatures at most, and so in d parts; of their parts, some 2 d, the rest are equal. Hence their d + 1 rarest parts, by one order
    for all sets, have one in common. The longer set of a pair has it in its own partition, the shorter in its own or the next.
    Parts of several signatures are hardly ever shared by chance, as single signatures are; the more sets there are, the
    more of those. This holds for any likeness, but under 0.7 sets have fewer parts with signatures than they need.

    Keys are brought together to see which are one set's alone, as most are. Parts all of whose signatures are of cells that more than
    ``heavy`` sets have, and parts without any, are kept unseen, so that no frequent one gathers in a task.
    """
    shipped = classes.sparkSession.sparkContext.broadcast(cell_loads(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes = b.column(1).value_lengths().to_numpy()
            signs = b.column(1).flatten().to_numpy().view(np.uint32)
            for key, node, known in part_keys(b.column(0).to_numpy(), signs, sizes, shipped.value, least, heavy):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(known)], names=["key", "node", "known"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, which the next batch may share its key with, and whether it went out
        for b in batches:
            if not b.num_rows:
                continue
            key, node, kept = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            kept = kept.copy()
            equal = key[1:] == key[:-1]
            kept[1:] |= equal
            kept[:-1] |= equal
            if held is not None and held[0] == key[0]:
                kept[0] = True
                if not held[2]:
                    yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], names=["key", "node"])
            held = int(key[-1]), int(node[-1]), bool(kept[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[kept])], names=["key", "node"])

    keys = classes.select("node", "signs").mapInArrow(run, "key long, node long, known boolean")
    return keys.repartition("key", F.when(F.col("known"), F.col("node"))).sortWithinPartitions("key").mapInArrow(shared, "key long, node long")


def sketches(classes: DataFrame) -> DataFrame:
    """``node, n, w0`` and on: the size of each set, and the parity of its signatures in each of 64 * ``SKETCH`` places."""
    words = [f"w{k}" for k in range(SKETCH)]

    def run(nodes, signs):
        x = [np.asarray(s, np.int32).view(np.uint32) for s in signs]
        bits = np.stack([np.packbits(np.bincount(s % (64 * SKETCH), minlength=64 * SKETCH) & 1).view(np.int64) for s in x]) if x else np.zeros((0, SKETCH), np.int64)
        return {"node": nodes, "n": [len(s) for s in x]} | {w: bits[:, k] for k, w in enumerate(words)}

    return map_columns(classes.select("node", "signs"), run, ", ".join(f"{c} long" for c in ("node", "n", *words)))


def may_be_alike(least: float):
    """A test of sketches that holds for all sets with a Jaccard coefficient of ``least`` or more."""

    def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count((x[:, 1:] ^ y[:, 1:]).view(np.uint64)).sum(1, dtype=np.int64)
        n, m = x[:, 0], y[:, 0]
        return (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9) & ((n + m - apart) * (1 + least) >= 2 * least * (n + m) - 1e-9)

    return fits


def near_groups(docs: DataFrame, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, node, class_id`` of every distinct document and fingerprint: the least doc_id of its group of near-duplicates."""
    prints, path = cut_to(fingerprints(docs))
    classes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("signs").alias("signs")))
    names = cut(prints.select("doc_id", "node").distinct())
    discard(docs.sparkSession, path)
    keys = cut(prefix_keys(classes, least))
    drawn = cut(sketches(classes))
    label = classes.select("node", F.col("node").alias("label"))
    for turn in range(SPANNING + 1):  # the last one looks at all pairs
        found = pairs(keys.join(label, "node"), drawn, may_be_alike(least), turn < SPANNING, chunk, f"xxhash64(node, {turn})")
        if found.isEmpty():
            break
        sure = cut(checked(found, classes.select("node", "signs"), least, jaccard=True))
        if not sure.isEmpty():
            label = united(label, sure)
    named = cut(classes.select("node", "first").join(label, "node").select("node", "first", F.col("label").alias("root")))
    heads = named.groupBy("root").agg(F.min("first").alias("class_id"))
    grouped = named.join(heads, "root").select("node", "class_id")
    return names.join(grouped, "node").select("doc_id", "node", "class_id")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"


def edited(text: str, follower: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + follower[:n]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text, how alike it is to that and to its successor, and its group of near-duplicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        last, noted, notes = None, object(), {}
        for b in slices(batches, 200):
            out: list[tuple] = []
            for doc_id, text, edge, part, node, group in zip(*(c.to_pylist() for c in b.columns)):
                if node is not None:
                    if doc_id != noted:
                        noted, notes = doc_id, {}
                    notes[node] = group
                    continue
                text = text or ""
                if edge and (last is None or last[3] != part):
                    last = None  # the range has its follower already
                    continue
                signs = signatures(text)
                if last is not None and last[3] == part:
                    changed = edited(last[1], text)
                    own = signatures(changed)
                    out.append((last[0], len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), as_text(last[2]), as_text(own), likeness(last[2], own), likeness(last[2], signs), last[4]))
                last = None if edge else (doc_id, text, signs, part, notes.get(node_of(signs), doc_id) if doc_id == noted else doc_id)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()))], names=names)

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark):  # the sets and keys go before the texts are dealt
        notes = cut(near_groups(docs).where(~F.col("doc_id").eqNullSafe(F.col("class_id"))), kept=True)  # of documents that are no class of their own
    return with_next(docs, notes, run, _SCHEMA, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Both texts of every document word by word: anchors, content words so far, chains, digests, and counts of shared ones.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM documents),
edits AS (SELECT d.doc_id, d.next_id, d.text, substr(d.text, 1, length(d.text) - length(d.text) // 2) || substr(f.text, 1, length(d.text) // 2) AS edited FROM d JOIN d f ON f.doc_id = d.next_id),
texts AS (SELECT doc_id, 0 AS kind, text FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
words AS (SELECT doc_id, kind, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, kind, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts)),
flagged AS (SELECT *, list_contains([{anchors}], w) AS is_anchor FROM words),
counted AS (SELECT *, sum((NOT is_anchor)::INT) OVER (PARTITION BY doc_id, kind ORDER BY i) AS c FROM flagged),
spots AS (SELECT *, is_anchor OR c - coalesce(max(CASE WHEN is_anchor THEN c END) OVER (PARTITION BY doc_id, kind ORDER BY i), 0) > {run} AS is_spot FROM counted),
content AS (SELECT doc_id, kind, c, w, lead(w) OVER (PARTITION BY doc_id, kind ORDER BY c) AS after FROM counted WHERE NOT is_anchor),
chains AS (SELECT s.doc_id, s.kind, s.w || ' ' || x.w || ' ' || x.after AS sig FROM spots s JOIN content x ON x.doc_id = s.doc_id AND x.kind = s.kind AND x.c = s.c + 1 WHERE s.is_spot AND x.after IS NOT NULL),
threes AS (SELECT doc_id, kind, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS sig FROM words WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)),
sigs AS (
  SELECT * FROM chains
  UNION ALL SELECT * FROM threes t WHERE sig IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chains c WHERE c.doc_id = t.doc_id AND c.kind = t.kind)
  UNION ALL SELECT * FROM texts t WHERE NOT EXISTS (SELECT 1 FROM chains c WHERE c.doc_id = t.doc_id AND c.kind = t.kind) AND NOT EXISTS (SELECT 1 FROM threes c WHERE c.doc_id = t.doc_id AND c.kind = t.kind AND sig IS NOT NULL)),
signs AS (SELECT DISTINCT doc_id, kind, substr(md5(sig), 1, 8) AS h FROM sigs),
prints AS (SELECT doc_id, kind, string_agg(h, '' ORDER BY h) AS fingerprint, count(*) AS n FROM signs GROUP BY doc_id, kind),
own AS (SELECT a.doc_id, count(*) AS common FROM signs a JOIN signs b ON a.doc_id = b.doc_id AND a.kind = 0 AND b.kind = 1 AND a.h = b.h GROUP BY a.doc_id),
likes AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM signs x JOIN signs y ON x.h = y.h AND x.kind = 0 AND y.kind = 0 AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
  JOIN prints p ON p.doc_id = a AND p.kind = 0 JOIN prints q ON q.doc_id = b AND q.kind = 0 WHERE common >= {least} * (p.n + q.n - common)),
reach AS (SELECT a, b FROM likes UNION SELECT r.a, l.b FROM reach r JOIN likes l ON l.a = r.b),
classes AS (SELECT a AS doc_id, least(a, min(b)) AS class_id FROM reach GROUP BY a),
follow AS (SELECT d.doc_id, count(*) AS common FROM d JOIN signs a ON a.doc_id = d.doc_id AND a.kind = 0 JOIN signs b ON b.doc_id = d.next_id AND b.kind = 0 AND a.h = b.h GROUP BY d.doc_id)
SELECT e.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint,
       coalesce(o.common, 0) / (a.n + b.n - coalesce(o.common, 0)) AS near_edited, coalesce(f.common, 0) / (a.n + x.n - coalesce(f.common, 0)) AS near_next,
       coalesce(g.class_id, e.doc_id) AS class_id
FROM edits e LEFT JOIN classes g ON g.doc_id = e.doc_id JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN prints x ON x.doc_id = e.next_id AND x.kind = 0
LEFT JOIN own o ON o.doc_id = e.doc_id LEFT JOIN follow f ON f.doc_id = e.doc_id
""".replace("{anchors}", ", ".join(f"'{w}'" for w in sorted(ANCHORS))).replace("{run}", str(RUN)).replace("{least}", str(LEAST))

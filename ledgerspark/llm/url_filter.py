"""URL filters over a sorted digest array.

Rules are ``(verdict, host, path)``. Their 64-bit xxhash keys are kept in one sorted array; the array, the
string offsets and the rule strings form one file that each worker maps into memory. A batch of urls is turned
into candidate keys (every suffix of the host at a label border, joined with the path cut to each length that
some rule path has), probed by one vectorised binary search, and each hit is confirmed against the stored
string, so a hash collision never decides.

The file is shipped to the executors only while it is at most ``max_index_bytes``. A larger rule list is dealt by digest over
shards of ``SHARD_ROWS`` rules or candidates, each with a sorted array of its own, mapped and probed in the same way by the distinct
candidates of all urls; what they hit goes back to the urls by its string.

Defined cases: a null url, or one without ``://``, has empty host and path and no rule. A rule fits its host and
all its subdomains if the url's path starts with the rule's path. The longest rule string wins; of two equally
long ones the one with the longer host. Repeated rules: a rule listed as both verdicts blocks. Urls without a
rule get ``default``, the verdict of a digest list for a non-member. Repeated rows are judged one by one.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEED = 0
SHARD_ROWS = 1 << 20
_MAPPED: dict[str, "RuleIndex"] = {}


class RuleIndex:
    """Sorted keys, offsets and strings of a rule list, readable from a buffer or a mapped file."""

    def __init__(self, keys, starts, verdicts, lengths, text):
        self.keys, self.starts, self.verdicts, self.lengths, self.text = keys, starts, verdicts, lengths, text

    @staticmethod
    def pack(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """The index as bytes: four counts, then keys, starts, path lengths, verdicts, strings."""
        own: dict[str, bool] = {}
        lengths = set()
        for verdict, host, path in rules:
            own[host + path] = own.get(host + path, False) or verdict == "block"
            lengths.add(len(path))
        order = sorted(own, key=lambda s: xxhash.xxh64_intdigest(s, seed=_SEED))
        encoded = [s.encode() for s in order]
        keys = np.array([xxhash.xxh64_intdigest(s, seed=_SEED) for s in encoded], np.uint64)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in encoded]))).astype(np.int64)
        sizes = np.array(sorted(lengths), np.int64)
        head = np.array([len(keys), len(sizes), int(starts[-1])], np.int64)
        return b"".join((head.tobytes(), keys.tobytes(), starts.tobytes(), sizes.tobytes(), np.array([own[s] for s in order], np.uint8).tobytes(), b"".join(encoded)))

    @classmethod
    def mapped(cls, name: str, packed: bytes) -> "RuleIndex":
        """The index over a file of this worker's own temporary folder, mapped once per process."""
        if name not in _MAPPED:
            _MAPPED[name] = cls.opened(packed)
        return _MAPPED[name]

    @classmethod
    def opened(cls, packed: bytes) -> "RuleIndex":
        fd, path = tempfile.mkstemp(suffix=".rules")
        with os.fdopen(fd, "wb") as f:
            f.write(packed)
        raw = np.memmap(path, np.uint8, "r")
        os.unlink(path)  # the mapping keeps it until it goes
        n, m, size = raw[:24].view(np.int64).tolist()
        at = 24
        parts = []
        for kind, count in ((np.uint64, n), (np.int64, n + 1), (np.int64, m), (np.uint8, n), (np.uint8, size)):
            end = at + count * np.dtype(kind).itemsize
            parts.append(raw[at:end].view(kind))
            at = end
        keys, starts, lengths, verdicts, text = parts
        return cls(keys, starts, verdicts, lengths.tolist(), text)

    def probe(self, names: list[str]) -> Iterator[tuple[int, int]]:
        """Index pairs of names and the rules whose strings they are: one binary search for all, then strings confirm."""
        digests = np.array([xxhash.xxh64_intdigest(s, seed=_SEED) for s in names], np.uint64)
        low = np.searchsorted(self.keys, digests, "left")
        high = np.searchsorted(self.keys, digests, "right")
        for j in np.flatnonzero(high > low).tolist():
            for k in range(low[j], high[j]):
                if self.text[self.starts[k] : self.starts[k + 1]].tobytes() == names[j].encode():
                    yield j, k

    def find(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """For each url the winning rule string and whether it blocks."""
        found: list[tuple[str, bool] | None] = [None] * len(hosts)
        best: list[tuple[int, int]] = [(0, 0)] * len(hosts)
        names, rows, widths = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            at = 0
            while at >= 0:
                for k in self.lengths:
                    if k <= len(path):
                        names.append(host[at:] + path[:k])
                        rows.append(i)
                        widths.append(len(host) - at)
                at = host.find(".", at) + 1 or -1
        if not names or not len(self.keys):
            return found
        for j, k in self.probe(names):
            i, rank = rows[j], (len(names[j]), widths[j])
            if rank > best[i]:
                found[i], best[i] = (names[j], bool(self.verdicts[k])), rank
        return found


def url_parts(url) -> tuple:
    """Host (A-Z lower-cased) and path columns of a url column."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def _sharded(parts: DataFrame, rules, spark: SparkSession) -> DataFrame:
    """The same verdicts by sorted digest arrays over shards of the rules, for rule lists of any size."""
    known = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    known = cut(known.withColumn("rule", F.concat("host", "path")).groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("blocks"), F.max(F.length("path")).alias("path_length")))
    lengths = known.agg(F.collect_set("path_length")).scalar()  # at most as many values as a path has characters
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = (
        parts.where("host <> ''")
        .select("host", "path")
        .distinct()
        .withColumn("lengths", lengths)
        .select("host", "path", F.explode(suffixes).alias("suffix"), "lengths")
        .select("host", "path", "suffix", F.explode(F.filter("lengths", lambda k: k <= F.length("path"))).alias("k"))
        .select("host", "path", "suffix", F.concat("suffix", F.expr("left(path, k)")).alias("rule"))
    )
    tried = cut(tried)
    names = cut(tried.select("rule").distinct())
    shards = max(known.count(), names.count()) // SHARD_ROWS + 1
    shard = F.pmod(F.xxhash64("rule"), F.lit(shards)).alias("shard")

    def probe(own: pa.Table, asked: pa.Table) -> pa.Table:
        blocks = own.column("blocks").to_pylist()
        index = RuleIndex.opened(RuleIndex.pack(("block" if x else "allow", r, "") for r, x in zip(own.column("rule").to_pylist(), blocks)))
        wanted = asked.column("rule").to_pylist()
        hits = list(index.probe(wanted)) if len(blocks) and wanted else []
        return pa.table({"rule": pa.array([wanted[j] for j, _ in hits], pa.string()), "blocks": pa.array([bool(index.verdicts[k]) for _, k in hits], pa.bool_())})

    found = known.select(shard, "rule", "blocks").groupBy("shard").cogroup(names.select(shard, "rule").groupBy("shard")).applyInArrow(probe, "rule string, blocks boolean")
    won = (
        tried.join(found, "rule")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "blocks"), F.struct(F.length("rule"), F.length("suffix"))).alias("won"))
        .select("host", "path", F.col("won.rule").alias("rule"), F.col("won.blocks").alias("blocks"))
    )
    return parts.join(won, ["host", "path"], "left")


def filter_urls(urls: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_index_bytes: int = 64 << 20) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``urls``; ``rules`` is a list or a DataFrame of rules."""
    spark = urls.sparkSession
    host, path = url_parts(F.col(url_col))
    parts = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    packed = None if isinstance(rules, DataFrame) else RuleIndex.pack(rules)
    if packed is None or len(packed) > max_index_bytes:
        out = _sharded(parts, rules, spark)
    else:
        name = xxhash.xxh3_128_hexdigest(packed)
        shipped = spark.sparkContext.broadcast(packed)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = RuleIndex.mapped(name, shipped.value)
            for b in batches:
                found = index.find(b.column("host").to_pylist(), b.column("path").to_pylist())
                rule = pa.array([x and x[0] for x in found], pa.string())
                blocks = pa.array([x and x[1] for x in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([*b.columns, rule, blocks], names=[*b.schema.names, "rule", "blocks"])

        kind = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("blocks", T.BooleanType())])
        out = parts.mapInArrow(probe, kind)
    verdict = F.when(F.col("blocks"), "block").when(~F.col("blocks"), "allow").otherwise(F.lit(default))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_VALUES}),
parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
won AS (
  SELECT page_id, host, path,
         (SELECT max_by(struct_pack(r := rhost || rpath, v := verdict), length(rhost || rpath)) FROM rules
          WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS w
  FROM parts)
SELECT page_id, host, path, w.r AS rule, coalesce(w.v, 'allow') AS verdict FROM won
"""

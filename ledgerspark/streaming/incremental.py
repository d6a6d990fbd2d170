"""Incremental work: micro-batches that re-fold what changed and hand on only what differs.

A growing log is no new file to a file stream, and a later replay may change a session that went out before, so the honest form is a
re-fold per batch: files whose size differs from the cursor are read again, their sessions folded, digests compared with the
stored ones, and the changed rows handed to a sink. A stream of usage keeps its rows in a table by session, and each batch
folds all stored rows of the sessions that it touches. State is written only after the sink succeeded; a batch that fails is
done again with the same result.

State tables are Parquet parts under a root named by the parser epoch: a new epoch starts from nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.joins import changed


class StateTable:
    """A keyed table of any size; the first column of its schema is the key, whose hash gives a row's bucket.

    A write appends the batch's rows alone, to the buckets of their keys. A manifest, a small file that replaces the one before, names the
    parts of every bucket and their rows; nothing is found by listing folders. Reading takes a key's newest row, or with ``history``
    every row. A bucket of more than ``deltas`` parts is written together, and before rows come in buckets split one after the other (linear
    hashing; the rows are counted for it), so that each keeps some ``bucket_rows`` rows however large the table becomes. Parts are sorted by hash in small pages:
    reading a few keys reads the pages that hold them.

    Rows keep the number of their version, so that one which is written again takes its own place, wherever its rows are by then.
    """

    #: Rows of a page, and the number of keys up to which a read asks for their hashes.
    PAGE, ASKED = 100, 256

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, epoch: int = 1, buckets: int = 1, history: bool = False, bucket_rows: int = 50_000, deltas: int = 4):
        self.spark, self.schema, self.first, self.history = spark, schema, buckets, history
        self.bucket_rows, self.deltas = bucket_rows, deltas
        self.base = f"{root}/epoch={epoch}/{name}"
        self.kind = StructType.fromDDL(schema)
        self.key = self.kind.names[0]
        self.stored = StructType([*self.kind.fields, *StructType.fromDDL("_h long, _seq long").fields])

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def manifest(self) -> dict:
        """``number``, ``last`` version, ``buckets`` (how many), ``parts`` (of each bucket: name, latest version in it, rows) and ``dead`` parts."""
        fs, path = self._fs()
        folder = path(f"{self.base}/manifest")
        found = [int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json")] if fs.exists(folder) else []
        if not found:
            return {"number": 0, "last": 0, "buckets": self.first, "parts": {}, "dead": []}
        got = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = fs.open(path(f"{self.base}/manifest/{max(found)}.json"))
        try:
            return json.loads(got.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, found: dict) -> None:
        fs, path = self._fs()
        number = found["number"] = found["number"] + 1
        draft = path(f"{self.base}/manifest/{number}.draft")
        out = fs.create(draft, True)
        out.write(json.dumps(found).encode())
        out.close()
        fs.rename(draft, path(f"{self.base}/manifest/{number}.json"))
        fs.delete(path(f"{self.base}/manifest/{number - 2}.json"), False)

    @staticmethod
    def _bucket(h: Column, buckets: int) -> Column:
        """Linear hashing by leading bits, the first counting least: buckets that have split take one bit more, and each is a range of hashes."""
        bits = buckets.bit_length() - 1
        lead = lambda n: reduce(lambda a, k: a + F.shiftleft(F.shiftrightunsigned(h, 63 - k).bitwiseAND(F.lit(1)), k), range(n), F.lit(0).cast("long"))
        return F.when(lead(bits + 1) < buckets, lead(bits + 1)).otherwise(lead(bits)).cast("int")

    def touched(self, rows: DataFrame, buckets: int | None = None) -> set[int]:
        """Buckets of the keys of ``rows``."""
        at = self._bucket(F.xxhash64(self.key), buckets or self.manifest()["buckets"])
        return {r["bucket"] for r in rows.select(at.alias("bucket")).distinct().collect()}

    def _load(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*(f"{self.base}/{p}" for p in parts))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.kind.names if c != self.key]
        if self.history or not rest:
            return rows
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest, "_h", "_seq"), "_seq").alias("_x")).select(self.key, "_x.*")

    def _merged(self, found: dict, buckets: Iterable[int]) -> DataFrame:
        """The rows of some buckets; those that have one part need no look for newer ones."""
        of = [found["parts"].get(str(b), []) for b in buckets]
        alone = [parts[0][0] for parts in of if len(parts) == 1]
        more = [p[0] for parts in of if len(parts) > 1 for p in parts]
        return self._load(alone).unionByName(self._newest(self._load(more))) if more else self._load(alone)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the keys of a frame: from their buckets alone, and of few keys from their pages."""
        found = self.manifest()
        if keys is None:
            return self._merged(found, range(found["buckets"])).select(*self.kind.names)
        few = [r["h"] for r in keys.select(F.xxhash64(self.key).alias("h")).distinct().limit(self.ASKED + 1).collect()]
        asked = len(few) <= self.ASKED
        own = {int(b) for b in (self._place(h, found["buckets"]) for h in few)} if asked else self.touched(keys, found["buckets"])
        if not own:
            return self._load([]).select(*self.kind.names)
        rows = self._load([p[0] for b in own for p in found["parts"].get(str(b), [])])
        if asked:
            rows = rows.where(reduce(lambda a, b: a | b, (F.col("_h") == h for h in few)))
        return self._newest(rows.join(keys.select(self.key).distinct(), self.key, "left_semi")).select(*self.kind.names)

    @staticmethod
    def _place(h: int, buckets: int) -> int:
        """``_bucket`` of a number."""
        bits = buckets.bit_length() - 1
        lead = lambda n: sum((h >> (63 - k) & 1) << k for k in range(n))
        return lead(bits + 1) if lead(bits + 1) < buckets else lead(bits)

    def _store(self, rows: DataFrame, name: str, buckets: int) -> dict[str, int]:
        """Write rows that have ``_h`` and ``_seq`` as a part of each bucket; returns how many rows each got."""
        at = rows.withColumn("bucket", self._bucket(F.col("_h"), buckets)).hint("rebalance", "bucket")
        pages = {f"parquet.page.{k}": self.PAGE for k in ("row.count.limit", "size.row.check.min", "size.row.check.max")}
        at.sortWithinPartitions("bucket", "_h").write.mode("overwrite").options(**pages).partitionBy("bucket").parquet(f"{self.base}/{name}")
        counts = self.spark.read.schema("_h long, bucket int").parquet(f"{self.base}/{name}").groupBy("bucket").count()
        return {str(r["bucket"]): r["count"] for r in counts.collect()}

    def write(self, rows: DataFrame, version: int) -> None:
        """Append ``rows`` as a version, in the place of one of that number that was written before; then keep the table in shape."""
        found = self.manifest()
        dead, found["dead"] = found["dead"], []
        if version <= found["last"]:
            self._without(found, version)
        self._split(found, rows.count())
        counts = self._store(rows.select(*self.kind.names, F.xxhash64(self.key).alias("_h"), F.lit(version).cast("long").alias("_seq")), f"v{version}", found["buckets"])
        for b, n in counts.items():
            found["parts"].setdefault(b, []).append([f"v{version}/bucket={b}", version, n])
        found["last"] = max(found["last"], version)
        self._commit(found)
        self._tidy(found)
        self._clear(found, [d for d in dead if not d.startswith(f"v{version}/")])

    def _without(self, found: dict, version: int) -> None:
        """Take a version out of the parts that hold it."""
        for b, parts in found["parts"].items():
            found["parts"][b] = [p for p in parts if p[0].split("/")[0] != f"v{version}"]
        mixed = {int(b) for b, parts in found["parts"].items() if any(p[0].startswith("c") and p[1] >= version for p in parts)}
        if mixed:
            self._rewrite(found, mixed, found["buckets"], F.col("_seq") != version)

    def _split(self, found: dict, more: int) -> None:
        """Split buckets for so many rows to come, which so are written once, where they stay."""
        before, rows = found["buckets"], more + sum(p[2] for parts in found["parts"].values() for p in parts)
        after = max(before, -(-rows // self.bucket_rows))
        source = lambda b: b if b < before else source(b - (1 << (b.bit_length() - 1)))
        if after > before:
            self._rewrite(found, {source(b) for b in range(before, after)}, after, kind="s")

    def _tidy(self, found: dict) -> None:
        """Put the parts of a bucket together where there are too many."""
        again = {int(b) for b, parts in found["parts"].items() if len(parts) > self.deltas}
        if again:
            self._rewrite(found, again, found["buckets"])
            self._commit(found)

    def _rewrite(self, found: dict, again: set[int], buckets: int, kept: Column | None = None, kind: str = "") -> None:
        """Write the rows of some buckets anew, each as one part, over so many buckets."""
        parts, found["buckets"] = [p for b in again for p in found["parts"].pop(str(b), [])], buckets
        if not parts:
            return
        rows = self._newest(self._load([p[0] for p in parts]))
        found["dead"] += [p[0] for p in parts]
        name, seq = f"c{found['number']}{kind}", max(p[1] for p in parts)
        for b, n in self._store(rows if kept is None else rows.where(kept), name, buckets).items():
            found["parts"][b] = [[f"{name}/bucket={b}", seq, n]]

    def _clear(self, found: dict, dead: list[str]) -> None:
        """Delete parts that were replaced a write ago; newer ones may still be read by what comes lazily."""
        fs, path = self._fs()
        used = {p[0].split("/")[0] for parts in found["parts"].values() for p in parts} | {d.split("/")[0] for d in found["dead"]}
        for part in {d if d.split("/")[0] in used else d.split("/")[0] for d in dead}:
            fs.delete(path(f"{self.base}/{part}"), True)

    def files(self) -> int:
        """How many parts the table has."""
        return sum(map(len, self.manifest()["parts"].values()))

    def version(self, number: int) -> DataFrame:
        """The rows of the version that was written last."""
        return self.spark.read.schema(self.kind).parquet(f"{self.base}/v{number}").select(*self.kind.names)

    def upsert(self, rows: DataFrame) -> None:
        """Rows of ``rows``, one a key, replace those of the same key."""
        self.write(rows, self.manifest()["last"] + 1)


def upsert(table: StateTable, rows: DataFrame) -> None:
    table.upsert(rows)


def grown_files(listing: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files (``path, size``) that the cursor does not know at that size."""
    return changed(listing, cursors, "path", "size")


def sync_once(
    listing: DataFrame, cursors: StateTable, digests: StateTable, fold: Callable[[DataFrame], DataFrame], send: Callable[[DataFrame], None],
    stamps: StateTable | None = None, attribution: str | None = None, whole: bool = False,
) -> int:
    """One pass: changed files, their sessions, those with a new digest to ``send``; then the state. Returns how many were sent.

    ``fold`` turns files into rows ``session, payload, digest``; with ``whole`` it gets all files once any has changed, as sources
    need whose messages are replayed across files. ``send`` may see a row again after a failure and must put it in the place of
    the one before. A confirmed ``attribution`` (null: not confirmed) other than the one in ``stamps`` (``name, stamp``) folds
    every file again, so that sessions go out anew with what it changes.
    """
    flipped = False
    if stamps is not None and attribution is not None:
        held = {r["stamp"] for r in stamps.read().where("name = 'attribution'").collect()}
        flipped = held != {attribution}
    grown = (listing if flipped else grown_files(listing, cursors.read())).persist()
    try:
        again = listing if whole and not grown.isEmpty() else grown
        fresh = changed(fold(again), digests.read()).persist()
        try:
            send(fresh)
            digests.upsert(fresh.select("session", "digest"))
            cursors.upsert(grown.select("path", "size"))
            if flipped:
                stamps.upsert(stamps.spark.createDataFrame([("attribution", attribution)], stamps.schema))
            return fresh.count()
        finally:
            fresh.unpersist()
    finally:
        grown.unpersist()


def send_in_chunks(rows: DataFrame, post: Callable[[list[str]], None], size: int = 100) -> None:
    """Hand ``payload`` texts to ``post`` in chunks, from the executors. A failed chunk fails the task, whose retry sends its rows again."""

    def each(part) -> None:
        held: list[str] = []
        for row in part:
            held.append(row["payload"])
            if len(held) == size:
                post(held)
                held = []
        if held:
            post(held)

    rows.select("payload").foreachPartition(each)


def sync_stream(
    batches: DataFrame, atoms: StateTable, digests: StateTable, fold: Callable[[DataFrame], DataFrame], send: Callable[[DataFrame, int], None],
    checkpoint: str, copies: StateTable | None = None, **trigger,
):
    """A streaming query over usage batches: each is stored, its sessions folded over all their rows, and sent if their digest changed.

    ``atoms`` holds the rows of every batch so far (a table with ``history``, whose key is the session); a batch that is done again
    takes its own place there. The tables belong to the checkpoint: a new one needs new tables.

    Where messages are replayed across sessions, ``copies`` holds the same rows by message. A batch then touches every session that has one
    of its messages. What these sessions own depends on all their messages, older ones too, and on whoever else has those; so the fold
    gets every row of every message of theirs, of whatever session. Sessions that are only context so are folded in part and not sent.
    A fold that can leave a session with nothing should give a row that says so, since what went out before stands until then.
    """

    def each(batch: DataFrame, number: int) -> None:
        atoms.write(batch, number)
        own, cached = atoms.version(number), []

        def distinct(rows: DataFrame) -> DataFrame:
            cached.append(rows.distinct().persist())
            return cached[-1]

        keys = own.select(atoms.key)
        if copies is not None:
            bound = own.where(F.col(copies.key).isNotNull())
            copies.write(bound, number)
            keys = keys.unionByName(copies.read(distinct(bound.select(copies.key))).select(atoms.key))
        keys = distinct(keys)
        held = atoms.read(keys)
        if copies is not None:  # only the names of their messages are kept: rows come from the table by message
            shared = copies.read(distinct(held.where(F.col(copies.key).isNotNull()).select(copies.key)))
            context = held.where(F.col(copies.key).isNull()).unionByName(shared.select(*held.columns))
        folded = fold(held if copies is None else context).join(keys.withColumnRenamed(atoms.key, digests.key), digests.key, "left_semi")
        fresh = changed(folded, digests.read(keys.withColumnRenamed(atoms.key, digests.key))).persist()
        try:
            send(fresh, number)
            digests.upsert(fresh.select(digests.key, "digest"))
        finally:
            for frame in (fresh, *cached):
                frame.unpersist()

    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def advance_watermark(table: StateTable, seen: DataFrame) -> None:
    """The greatest time (``ts``) per store, the key of the table; it never goes back, and drops no late rows."""
    latest = seen.groupBy(table.key).agg(F.max("ts").alias("ts"))
    both = table.read(latest).unionByName(latest)
    table.upsert(both.groupBy(table.key).agg(F.max("ts").alias("ts")))


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``path, size, mtime_ms`` of the files under a root, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def fingerprint(files: DataFrame) -> str:
    """A digest of the whole listing: equal as long as no file came, went or changed."""
    one = files.select(F.xxhash64("path", "size", "mtime_ms").cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    return one.select(F.sha1(F.concat_ws(":", "n", "h"))).first()[0]


def scan_due(now_ms: int, changed_ms: int | None, last_ms: int | None, settle_ms: int = 800, floor_ms: int = 3000, sustained_ms: int = 6000, fallback_ms: int = 15_000) -> bool:
    """Whether to fold again: once changes have settled and the floor is over, under lasting changes, or at the latest by the fallback."""
    if last_ms is None or now_ms - last_ms >= fallback_ms:
        return True
    if changed_ms is None or changed_ms <= last_ms:
        return False
    return now_ms - last_ms >= floor_ms and (now_ms - changed_ms >= settle_ms or now_ms - last_ms >= sustained_ms)

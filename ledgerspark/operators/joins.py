"""Joins that a plain equality does not express, and guarded equalities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import carried

SKEW_MS = 2000


def model_in_force(events: DataFrame, turns: DataFrame, key: str = "session", ts: str = "ts", model: str = "model", fallback: Column | None = None, skew_ms: int = SKEW_MS) -> DataFrame:
    """``events`` with the model of the latest turn that starts before ``ts + skew_ms`` (strictly); turns without a model are passed over.

    Turns and events become one stream, turns moved back by the skew; equal times put events first.
    """
    names = events.columns
    left = events.select(*names, F.col(ts).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_model"))
    right = turns.select(F.col(key), (F.col(ts) - skew_ms).alias("_at"), F.lit(1).alias("_kind"), F.col(model).alias("_model"))
    both = left.unionByName(right, allowMissingColumns=True)
    seen = carried(both, key, "_at", F.col("_model"), "_found", ("_kind",)).where("_kind = 0")
    own = fallback if fallback is not None else F.lit(None).cast("string")
    return seen.select(*names, F.coalesce("_found", own, F.lit("unknown")).alias("model_in_force"))


#: Shas that one batch of lists holds, or one session's if they are more; and the most sessions that are answered beside one copy of a folder's commits.
_LISTED, _BESIDE = 1 << 18, 1000
#: Parts of a folder's commits when they meet the lengths of its sessions.
_SALTS = 16


class _Held:
    """A group's commits by sha, as columns."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.shas = pa.concat_arrays([p.column("sha").cast(pa.large_string()) for p in parts] or [pa.array([], pa.large_string())])
        self.at = np.concatenate([p.column("at").to_numpy() for p in parts] or [np.empty(0, "int64")])
        fresh = pc.not_equal(self.shas[1:], self.shas[:-1]).to_numpy(zero_copy_only=False)
        self.number = None if fresh.all() else np.concatenate(([0], np.cumsum(fresh)))

    def within(self, begin: int, end: int, most: int | None) -> pa.Array:
        places = np.flatnonzero((self.at >= begin) & (self.at <= end))
        if self.number is not None:
            places = places[np.diff(self.number[places], prepend=-1) != 0]
        return self.shas.take(pa.array(places[:most]))


def _lists(kind: T.StructType, most: int | None, between: str | None) -> Callable:
    """A step over rows by ``group``, its commits by sha before its sessions, that gives each session's distinct shas. It holds one group's commits."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def batch(sessions: list[pa.Array], lists: list[pa.Array]) -> pa.RecordBatch:
        counts = np.array([len(x) for x in lists])
        shas = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.concat_arrays(lists).cast(pa.string()))
        shas = shas if between is None else pc.binary_join(shas, between)
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((pa.concat_arrays(sessions), pa.array(counts), shas), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, held = None, [], None
        for b in batches:
            turn = pc.or_(*(pc.not_equal(c[1:], c[:-1]) for c in (b.column("group"), b.column("asks"))))
            edges = [0, *(np.flatnonzero(turn.to_numpy(zero_copy_only=False)) + 1), b.num_rows] if b.num_rows else []
            sessions, lists, size = [], [], 0
            for at, end in pairwise(edges):
                rows, group = b.slice(at, end - at), b.column("group")[at].as_py()
                if group != name:
                    name, parts, held = group, [], None
                if not b.column("asks")[at].as_py():
                    parts.append(rows)
                    continue
                held = held or _Held(parts)
                for k, span in enumerate(zip(rows.column("at").to_pylist(), rows.column("upto").to_pylist())):
                    sessions.append(rows.column("session")[k : k + 1])
                    lists.append(held.within(*span, most))
                    size += len(lists[-1])
                    if size >= _LISTED:
                        yield batch(sessions, lists)
                        sessions, lists, size = [], [], 0
            if sessions:
                yield batch(sessions, lists)

    return run


def commits_in_session(sessions: DataFrame, commits: DataFrame, most: int | None = None, between: str | None = None) -> DataFrame:
    """``session, n, shas`` for each row of ``sessions`` (one a session): all distinct commits of its folder between its start and end, by sha; only the first ``most``, if given.

    ``shas`` is an array of ``n``, or one text with ``between`` between them.

    Time is cut into blocks of more than half a session's length and at most all of it (a power of two), so that a session lies in the block in which it
    starts and the two after. Sessions of a folder and block are answered beside these three blocks' commits, a thousand sessions beside each copy of them.
    A session is dealt once and its list is made whole where it goes out; pairs of sessions and commits are never rows and never shuffled.
    """
    sound = F.col("session").isNotNull() & F.col("cwd").isNotNull() & (F.col("ended_at") >= F.col("started_at"))
    asked = sessions.where(sound).select("session", "cwd", F.col("started_at").cast("long").alias("at"), F.col("ended_at").cast("long").alias("upto"))
    asked = asked.withColumn("bits", F.expr("length(bin(greatest(upto - at, 1L))) - 1")).withColumn("first", F.expr("shiftright(at, bits)"))
    place = F.row_number().over(W.partitionBy("cwd", "bits", "first").orderBy("session")) - 1
    asked = asked.withColumn("part", F.floor(place / _BESIDE))
    wanted = asked.select("cwd", "bits", "first", "part").distinct()
    lengths = wanted.select("cwd", "bits").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = commits.where("sha is not null and at is not null").select("cwd", "sha", F.col("at").cast("long").alias("at"), F.pmod(F.xxhash64("sha", "at"), F.lit(_SALTS)).cast("int").alias("salt"))
    dealt = dealt.join(lengths, ["cwd", "salt"]).drop("salt")
    dealt = dealt.select("*", F.explode(F.expr("sequence(shiftright(at, bits) - 2, shiftright(at, bits))")).alias("first")).join(wanted, ["cwd", "bits", "first"])
    group = F.concat_ws("\0", "bits", "first", "part", "cwd").alias("group")
    rows = dealt.select(group, F.lit(False).alias("asks"), "sha", "at").unionByName(asked.select(group, F.lit(True).alias("asks"), "at", "upto", "session"), allowMissingColumns=True)
    rows = rows.repartition(int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")  # so many in any case: lists are far larger than what is dealt
    texts, none = (T.ArrayType(T.StringType()), F.array()) if between is None else (T.StringType(), F.lit(""))
    kind = T.StructType([T.StructField("session", sessions.schema["session"].dataType), T.StructField("n", T.LongType()), T.StructField("shas", texts)])
    found = rows.sortWithinPartitions("group", "asks", "sha").mapInArrow(_lists(kind, most, between), kind)
    rest = sessions.where(~F.coalesce(sound, F.lit(False)))
    return found.unionByName(rest.select("session", F.lit(0).cast("long").alias("n"), none.cast(texts).alias("shas")))


def attribute_grants(sessions: DataFrame, grants: DataFrame) -> DataFrame:
    """``sessions`` with ``canonical_id`` where the grants of their slug name exactly one."""
    sure = grants.groupBy("slug").agg(F.min("canonical_id").alias("canonical_id"), F.countDistinct("canonical_id").alias("n"), F.array_sort(F.collect_set("grant_id")).alias("grant_ids")).where("n = 1").drop("n")
    return sessions.join(sure, "slug", "left")


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of ``over``, and those of ``base`` whose key it lacks."""
    return over.unionByName(base.join(over.select(key), key, "left_anti"))


def changed(rows: DataFrame, stored: DataFrame, key: str = "session", digest: str = "digest") -> DataFrame:
    """Rows whose digest is new or differs from the stored one."""
    old = stored.select(key, F.col(digest).alias("_old"))
    return rows.join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col(digest))).drop("_old")


def on_calendar(days: DataFrame, last_day: Column, n: int, counts: list[str]) -> DataFrame:
    """A row for each of the ``n`` days up to ``last_day``, zero where ``days`` has none."""
    spark = days.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last_day, n - 1), last_day)).alias("day"))
    return calendar.join(days, "day", "left").select("day", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))


def live_deltas(sessions: DataFrame, baseline: DataFrame, active: DataFrame | None = None, now_ms: int = 0, window_ms: int = 15 * 60_000) -> DataFrame:
    """Tokens since the baseline (absent: 0) per session with any; then recent sessions of active harnesses at zero.

    Columns ``session, harness, tokens, ctx_pct, rank``: those that burned by tokens, the others by how full their context is.
    """
    base = baseline.select("session", F.col("tokens").alias("_base"))
    seen = sessions.join(base, "session", "left").withColumn("delta", F.col("tokens") - F.coalesce("_base", F.lit(0)))
    burned = seen.where("delta > 0").select("session", "harness", F.col("delta").alias("tokens"), "ctx_pct", F.lit(0).alias("seeded"))
    if active is None:
        return burned
    recent = seen.where((F.col("delta") <= 0) & F.col("ctx_pct").isNotNull() & (F.lit(now_ms) - F.col("last_at") <= window_ms))
    seeded = recent.join(active, "harness", "left_semi").select("session", "harness", F.col("delta").alias("tokens"), "ctx_pct", F.lit(1).alias("seeded"))
    return burned.unionByName(seeded)


#: Prefixes under which a catalog may list an id, most likely first.
CATALOG_PREFIXES = ("", "anthropic/", "openai/", "xai/", "gemini/", "x-ai/")


def catalog_match(ids: DataFrame, catalog: DataFrame, prefixes: tuple[str, ...] = CATALOG_PREFIXES) -> DataFrame:
    """Each id with its catalog row: under the first prefix that is listed, else its newest variant dated in digits."""
    own = ids.select("model").distinct()
    tried = own.select("model", F.posexplode(F.array(*(F.concat(F.lit(p), F.col("model")) for p in prefixes))).alias("rank", "catalog_id"))
    direct = tried.join(catalog, "catalog_id").groupBy("model").agg(F.min_by("catalog_id", "rank").alias("catalog_id"))
    base = F.regexp_replace("catalog_id", r"^[a-z-]+/", "")
    cuts = F.filter(F.sequence(F.lit(2), F.length("base")), lambda k: (F.substring("base", k, F.lit(1)) == "-") & F.substring("base", k + 1, F.lit(1)).rlike(r"\d"))
    stems = catalog.select("catalog_id", base.alias("base")).where("length(base) > 2").select("catalog_id", "base", F.explode(cuts).alias("k"))
    dated = stems.select(F.expr("left(base, k - 1)").alias("model"), "catalog_id").groupBy("model").agg(F.max("catalog_id").alias("dated_id"))
    joined = own.join(direct, "model", "left").join(dated, "model", "left")
    return joined.select("model", F.coalesce("catalog_id", "dated_id").alias("catalog_id"))


def native_match(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each id with the row of its own vendor (``provider, model, input_rate`` and more), the likeliest provider first."""
    from ..functions.text import native_providers

    tried = ids.select("model").distinct().select("model", F.posexplode(native_providers(F.col("model"))).alias("rank", "provider"))
    rest = [c for c in catalog.columns if c not in ("model", "provider")]
    found = tried.join(catalog.where("input_rate is not null"), ["provider", "model"])
    best = found.groupBy("model").agg(F.min_by(F.struct("provider", *rest), "rank").alias("x"))
    return best.select("model", "x.*")

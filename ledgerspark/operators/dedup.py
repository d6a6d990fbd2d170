"""Removing replays: usage rows, invocations, sessions, files.

Usage rows (``atoms``) have ``ord`` (a sortable place), ``thread``, ``message_id``, ``request_id``, ``is_sidechain``, ``cost``,
``has_speed``, the four token counts and whatever else goes along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import COUNTS, total_tokens

VERSION = r"^\d+\.\d+\.\d"


def valid() -> Column:
    """Rows to count: absent ids are fine, empty ones are not; a version must start like one."""
    filled = [F.col(c).isNull() | (F.col(c) != "") for c in ("session_id", "request_id", "message_id", "model")]
    out = F.col("version").isNull() | F.col("version").rlike(VERSION)
    for f in filled:
        out = out & f
    return out


def _worth() -> list[Column]:
    """Sorts the best record of a group first: main thread, tokens, cost, speed; then the earliest."""
    return [F.coalesce("is_sidechain", F.lit(False)).alias("w1"), (-total_tokens()).alias("w2"), (-F.coalesce("cost", F.lit(0.0))).alias("w3"), (~F.coalesce("has_speed", F.lit(False))).alias("w4"), F.col("ord").alias("w5")]


def exact_tier(atoms: DataFrame) -> DataFrame:
    """One row per message and request (null equals null): the best record, with the thread of the earliest as ``owner``.

    Both come from aggregates that combine before the shuffle, so a message replayed a million times is no hot group.
    """
    rest = [c for c in atoms.columns if c not in ("message_id", "request_id")]
    best = F.min(F.struct(*_worth(), F.struct(*rest).alias("row")))["row"].alias("best")
    found = atoms.groupBy("message_id", "request_id").agg(best, F.min(F.struct("ord", "thread"))["thread"].alias("owner"))
    return found.select("message_id", "request_id", *(F.col("best")[c].alias(c) for c in rest), "owner").select(*atoms.columns, "owner")


def two_tiers(atoms: DataFrame) -> DataFrame:
    """Both tiers for rows with a message id: the survivors that a reading in order would leave, with their ``owner``.

    Read in order, a message's records form a list. A row meets the record of its request; failing that, a sidechain row meets the first record and any row a
    sidechain record; else it is added. It takes the record's place if it is main and the other is not, or is worth more, and the place
    keeps its first thread. Hence a sidechain record can only stand first, until the first main row takes its place; sidechain rows after that change nothing.
    So what is left can be told without an order of meetings. Of a message with main rows: per request the best of its main rows; the owner is the
    thread of its earliest main row, but for the request of the message's first main row, where it is that of the message's first row. Of one without:
    the best row of all. These are aggregates, which combine before the shuffle.
    """
    rest = [c for c in atoms.columns if c not in ("message_id", "request_id")]
    main = ~F.coalesce("is_sidechain", F.lit(False))
    best = F.min(F.struct(*_worth(), F.struct(*rest, "request_id").alias("row")))
    groups = atoms.groupBy("message_id", "request_id").agg(best.alias("best"), F.min(F.struct("ord", "thread")).alias("first"), F.min(F.when(main, F.struct("ord", "thread"))).alias("main"), F.max(~main).alias("side"))
    whole = groups.groupBy("message_id").agg(F.max("side").alias("any_side"), F.min("first").alias("earliest"), F.min(F.when(F.col("main").isNotNull(), F.struct("main.ord", F.struct("request_id").alias("r")))).alias("opening"), F.min("best").alias("top"))
    whole = whole.where("any_side").select(F.col("message_id").alias("_message"), "earliest", "opening", "top")
    met = groups.join(whole, F.col("message_id") == F.col("_message"), "left")
    alone = F.col("earliest").isNotNull() & F.col("opening").isNull()  # sidechain rows only: one record, at the request of the best
    stays = F.col("earliest").isNull() | F.col("main").isNotNull() | (alone & F.col("top.row.request_id").eqNullSafe(F.col("request_id")))
    opens = F.col("earliest").isNotNull() & (alone | F.col("opening.r.request_id").eqNullSafe(F.col("request_id")))
    owner = F.when(opens, F.col("earliest.thread")).otherwise(F.coalesce("main.thread", "first.thread"))
    return met.where(stays).select("message_id", "request_id", *(F.col("best.row")[c].alias(c) for c in rest), owner.alias("owner")).select(*atoms.columns, "owner")


def deduplicate(atoms: DataFrame) -> DataFrame:
    """All surviving rows with their ``owner``. Rows without a message id are kept as they are, and never shuffled."""
    free = atoms.where("message_id is null").withColumn("owner", F.col("thread"))
    return free.unionByName(two_tiers(atoms.where("message_id is not null")))


def file_grain(atoms: DataFrame, file: str = "path") -> DataFrame:
    """Deduplication within each file alone: the file becomes part of the message id."""
    own = atoms.withColumn("_id", F.col("message_id")).withColumn("message_id", F.when(F.col("message_id").isNotNull(), F.concat_ws("\0", F.col(file), F.col("message_id"))))
    return deduplicate(own).withColumn("message_id", F.col("_id")).drop("_id")


def thread_totals(atoms: DataFrame, kept: DataFrame) -> DataFrame:
    """Per thread: surviving messages and counts; a thread whose rows all went stays as a row of zeros."""
    threads = atoms.groupBy("thread").agg(F.min("ts").alias("first_ts"))
    own = kept.groupBy(F.col("owner").alias("thread")).agg(F.count("*").alias("messages"), *(F.sum(c).alias(c) for c in COUNTS))
    joined = threads.join(own, "thread", "left")
    return joined.select("thread", "first_ts", F.coalesce("messages", F.lit(0)).alias("messages"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS))


def count_invocations(events: DataFrame) -> DataFrame:
    """``thread, id, n`` of invocations; a key counts once, for the event that comes first; events without one always count."""
    keyed = events.where("key is not null").groupBy("key").agg(F.min(F.struct("ord", "thread", "id")).alias("first")).select("first.thread", "first.id")
    return keyed.unionByName(events.where("key is null").select("thread", "id")).groupBy("thread", "id").agg(F.count("*").alias("n"))


def cap_buckets(counts: DataFrame, group: str, most: int = 16, other: str = "other") -> DataFrame:
    """At most ``most`` ids per group: the smallest, beyond the first ``most - 1``, are added up as ``other``."""
    from pyspark.sql import Window as W

    ranked = counts.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "id"))).withColumn("all", F.count("*").over(W.partitionBy(group)))
    name = F.when((F.col("all") > most) & (F.col("rn") >= most), other).otherwise(F.col("id"))
    return ranked.groupBy(group, name.alias("id")).agg(F.sum("n").alias("n"))


def latest_sessions(sessions: DataFrame, key: str = "session") -> DataFrame:
    """One row per session id: the later end wins, then more tokens, then the first."""
    rest = [c for c in sessions.columns if c != key]
    best = F.min(F.struct((-F.col("ended_at")).alias("a"), (-total_tokens()).alias("b"), F.col("ord").alias("c"), F.struct(*rest).alias("row")))["row"]
    found = sessions.groupBy(key).agg(best.alias("best"))
    return found.select(key, *(F.col("best")[c].alias(c) for c in rest)).select(*sessions.columns)


def largest_copies(files: DataFrame) -> DataFrame:
    """One path per file name: the largest, then the first discovered (``name, size, ord, path``)."""
    best = F.min(F.struct((-F.col("size")).alias("a"), F.col("ord").alias("b"), F.col("path").alias("path")))["path"]
    return files.groupBy("name").agg(best.alias("path"))

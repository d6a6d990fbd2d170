"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, linear between knots ``(time, weight)``. Its integral
up to a time, scaled to the source's target, is the source's cumulative token demand at that time. The documents of
a source, in a fixed pseudo-random order and repeated as often as its target needs, supply those tokens one after
the other; a copy's training position is the time at which the demand reaches the tokens supplied before it, found by inverting
the integral, a quadratic within each stretch between knots. Documents are range-sorted by position.

Targets: ``budget`` times all tokens is shared by weight; a target stops at ``most`` times its source's size and the excess
is shared anew among the others. The copy that reaches a target is taken in part (``words``); all others whole.

Nothing is collected. Running totals go through ``running_totals``: a source that holds a third of all rows is dealt over
``SHARDS`` shards by the same digest that orders it, and only one sum per source and shard is added up in a row.

Defined cases: null text has size 0. A null source is a source of its own, last in order. A document of size 0 is never
taken and has no position. Equal doc_ids, nulls included, share a digest and are ordered by size; rows that also agree in
size may change places, which changes no sum. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, running_totals, table, word_count

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2.0
SHARD_DIGITS = 3  # hexadecimal: 4096 shards a source
#: By rank modulo their number: falling, rising, and a peak in the middle. Times strictly rise from 0 to 1.
SCHEDULES = (
    ((0.0, 2.0), (1.0, 0.5)),
    ((0.0, 0.5), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 2.0), (1.0, 0.5)),
)


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``source, rank, source_size, target`` of rows ``source, size``; one row per source passes through one task."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sources.select("*", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    weighed = ranked.select(
        "*",
        F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("rank") % len(weights) + 1).alias("weight"),
        (F.col("source_size") * most).alias("cap"),
        (F.sum("source_size").over(every) * budget).alias("goal"),
    )
    # in order of cap by weight the sources that stop at their cap come first
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levelled = weighed.select("*", (left / F.sum("weight").over(onward)).alias("level"))
    stops = F.col("cap") <= F.col("level") * F.col("weight")
    shared = levelled.select("*", stops.alias("stops"), F.min(F.when(~stops, F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"].alias("share"))
    return shared.select("source", "rank", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("share") * F.col("weight")).alias("target"))


def demand_time(share: Column, schedule) -> Column:
    """The time at which a schedule's integral reaches ``share`` (0 to 1) of its whole."""
    stretches = [(t0, w0, t1, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    whole = sum(s[4] for s in stretches)
    found, done = F.lit(1.0), whole
    for t0, w0, t1, w1, area in reversed(stretches):
        done -= area
        need, slope = share * whole - F.lit(done), (w1 - w0) / (t1 - t0)
        # w0 * x + slope / 2 * x^2 = need, in the form that also holds for slope 0
        below = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + need * (2.0 * slope), F.lit(0.0)))
        step = F.coalesce(F.try_divide(need * 2.0, below), F.lit(0.0))  # no weight yet and nothing needed
        found = F.when(share * whole < F.lit(done + area), F.lit(t0) + step).otherwise(found)
    return found


def schedule_positions(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``docs`` (``doc_id, source, size`` and more) with ``source_size, target`` and ``copies``.

    ``copies`` holds for each taken copy of a document its pass, training position and the number of words taken;
    ``before``, the tokens of its source that come before it.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = cut(docs.withColumn("digest", digest).withColumn("shard", F.substring(digest, 1, SHARD_DIGITS)))
    targets = source_targets(rows.select("source", "size"), weights, budget, most)
    placed = running_totals(rows, ["source"], ["digest", F.col("doc_id").asc_nulls_last(), "size"], "shard", {"before": "size"}, targets)

    def copy(k: Column) -> Column:
        supplied = F.col("before") + k * F.col("source_size")
        words = F.least(F.greatest(F.floor("target") - supplied, F.lit(0)), F.col("size"))
        share = F.try_divide(supplied, F.col("target"))
        time = F.lit(None).cast("double")
        for i, schedule in enumerate(schedules):
            time = F.when(F.col("rank") % len(schedules) == i, demand_time(share, schedule)).otherwise(time)
        return F.struct(k.cast("int").alias("pass"), time.alias("position"), words.cast("long").alias("words"))

    passes = F.array(*(copy(F.lit(k)) for k in range(-int(-most // 1))))
    return placed.withColumn("copies", F.filter(passes, lambda c: c["words"] > 0)).drop("digest", "shard", "rank")


def mix(docs: DataFrame, size: Callable[[Column], Column] = word_count, **options) -> DataFrame:
    """Documents in training order: a row per taken copy, with ``mix_pass``, ``mix_position`` and ``mix_words``; texts stay whole.

    Rows that agree in doc_id, source and size are scheduled as one, and each of them is taken as that one is. Where ``docs``
    has columns that start with ``mix_``, underscores before the new names keep them apart.
    """
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    sized = docs.select("doc_id", "source", size(F.col("text")).alias("size")).distinct()
    copies = schedule_positions(sized, **options).select("doc_id", "source", "size", F.explode("copies").alias("copy")).select("doc_id", "source", "size", "copy.*")
    rows = docs.select(*(F.col(c).alias(f"d_{c}") for c in docs.columns), size(F.col("text")).alias("own_size"))
    on = rows["d_doc_id"].eqNullSafe(copies["doc_id"]) & rows["d_source"].eqNullSafe(copies["source"]) & (rows["own_size"] == copies["size"])
    found = rows.join(copies, on).select(*(rows[f"d_{c}"].alias(c) for c in docs.columns), *(copies[c].alias(prefix + c) for c in ("pass", "position", "words")))
    return found.repartitionByRange(f"{prefix}position", "doc_id").sortWithinPartitions(f"{prefix}position", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents in order of their first training position; those not taken follow."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    placed = schedule_positions(docs).withColumn("position", F.get("copies", F.lit(0))["position"])
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    due = F.coalesce("position", F.try_divide("before", "source_size") + 1, F.lit(2.0))
    ordered = placed.withColumn("due", due).repartitionByRange("due", "doc_id").sortWithinPartitions("due", "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.round("position", 6).alias("position"))


def _time_sql(schedule) -> str:
    stretches = [(t0, w0, t1, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    done = whole = sum(s[4] for s in stretches)
    found = "1.0"
    for t0, w0, t1, w1, area in reversed(stretches):
        done -= area
        slope = (w1 - w0) / (t1 - t0)
        need = f"(share * {whole!r} - {done!r})"
        step = f"{need} * 2.0 / ({w0!r} + sqrt(greatest({w0 * w0!r} + {need} * ({2.0 * slope!r}), 0.0)))"
        found = f"CASE WHEN share * {whole!r} < {done + area!r} THEN {t0!r} + {step} ELSE {found} END"
    return found


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [{', '.join(f'{float(w)!r}::DOUBLE' for w in WEIGHTS)}][rank % {len(WEIGHTS)} + 1] AS weight,
         source_size * {MOST!r}::DOUBLE AS cap, sum(source_size) OVER () * {BUDGET!r}::DOUBLE AS goal
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s)),
l AS (
  SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, rank, source_size,
         CASE WHEN cap <= level * weight THEN cap
              ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap > level * weight) END AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id NULLS LAST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, greatest(least(floor(target) - before, size), 0)::BIGINT AS first,
         greatest(least(floor(target) - before - source_size, size), 0)::BIGINT AS second,
         before / nullif(target, 0) AS share
  FROM p)
SELECT doc_id, size, source_size, target, first + second AS taken,
       CASE WHEN first > 0 THEN round(CASE rank % {len(SCHEDULES)} {' '.join(f'WHEN {i} THEN {_time_sql(s)}' for i, s in enumerate(SCHEDULES))} END, 6) END AS position
FROM c
"""

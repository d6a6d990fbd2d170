"""Ordered state within a key, for keys of any size.

A key's rows are cut into buckets of its order column; windows run inside a bucket, and one summary row per bucket carries
state across. So even a key with a third of all rows is spread over its buckets. State that depends on its whole path is taken
apart first: ``anchored_block`` follows pointers over ever longer stretches of time, and ``cumulative_deltas`` hands a sequential step only the
ends of a key's rising stretches, which rows then meet again by stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import cut, discard

BUCKET_MS = 6 * 3600 * 1000


def swept(
    df: DataFrame, key: str, order: str, sums: dict[str, Column] | None = None, lasts: dict[str, tuple[Column, bool]] | None = None,
    then: tuple[str, ...] = (), width: int = BUCKET_MS,
) -> DataFrame:
    """``df`` with running ``sums`` and ``lasts`` in one pass, over the key's rows ordered by the long ``order``, ties by ``then``.

    A sum runs up to and with each row. A last is the last non-null value up to each row (with it or, if false, before it).
    ``width`` is the span of a bucket. Rows are dealt once, by key and bucket; the summaries, their join and the windows use that dealing.
    """
    sums, lasts = sums or {}, lasts or {}
    bucket = F.floor(F.col(order) / width)
    rows = df.select("*", F.struct(F.col(key).alias("k"), bucket.alias("b")).alias("_g"), *(v.alias(f"_v_{n}") for n, v in sums.items()), *(v.alias(f"_v_{n}") for n, (v, _) in lasts.items()))
    rows = rows.repartition("_g")  # a struct of nulls equals another
    newest = lambda n: F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(order, *then, f"_v_{n}")))[f"_v_{n}"]
    ends = rows.groupBy("_g").agg(*(F.sum(f"_v_{n}").alias(f"_e_{n}") for n in sums), *(newest(n).alias(f"_e_{n}") for n in lasts))
    before = W.partitionBy("_g.k").orderBy("_g.b").rowsBetween(W.unboundedPreceding, -1)
    bases = ends.select("_g", *(F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.last(f"_e_{n}", True).over(before).alias(f"_b_{n}") for n in lasts))
    place = W.partitionBy("_g").orderBy(order, *then)
    upto, ahead = place.rowsBetween(W.unboundedPreceding, W.currentRow), place.rowsBetween(W.unboundedPreceding, -1)
    found = {n: F.sum(f"_v_{n}").over(upto) + F.col(f"_b_{n}") for n in sums}
    found |= {n: F.coalesce(F.last(f"_v_{n}", True).over(upto if current else ahead), F.col(f"_b_{n}")) for n, (_, current) in lasts.items()}
    return rows.join(bases, "_g").select(*(F.col(c) for c in df.columns if c not in found), *(c.alias(n) for n, c in found.items()))


def carried(df: DataFrame, key: str, order: str, value: Column, name: str, then: tuple[str, ...] = (), width: int = BUCKET_MS, current: bool = True) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` of the key up to each row (before it, if not ``current``)."""
    return swept(df, key, order, lasts={name: (value, current)}, then=then, width=width)


def running(df: DataFrame, key: str, order: str, values: dict[str, Column], then: tuple[str, ...] = (), width: int = BUCKET_MS) -> DataFrame:
    """``df`` with the sum of each of ``values`` over the key's rows up to and with each row."""
    return swept(df, key, order, values, then=then, width=width)


def changes(df: DataFrame, key: str, order: str, fields: list[str], width: int) -> DataFrame:
    """Change points: rows in which any of ``fields`` differs from the key's row before; the first always counts."""
    seen = carried(df, key, order, F.struct(*fields), "_prev", width=width, current=False)
    same = reduce(lambda a, b: a & b, (F.col(f).eqNullSafe(F.col(f"_prev.{f}")) for f in fields))
    return seen.where(F.col("_prev").isNull() | ~same).drop("_prev")


def in_order(df: DataFrame, key: str, order: list[str], begin: Callable, step: Callable, schema: T.StructType) -> DataFrame:
    """Stream each key's rows in order through ``step(state, row)``, which returns the new state and an output row or none.

    For state that depends on its whole path. Rows are sorted (spilling if need be), never gathered; what is held is one state.
    ``begin(key)`` gives a key's first state; a state's ``last`` attribute, if any, is put out when the key ends.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or row[0] != name:
                    if state is not None and hasattr(state, "last"):
                        out.append(state.last())
                    name, state = row[0], begin(row[0])
                made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
        if state is not None and hasattr(state, "last"):
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(state.last(), arrow)], schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class _Mark:
    held = 0


def cumulative_deltas(snapshots: DataFrame, key: str, order: list[str], total: str, fields: list[str], width: int = 10_000) -> DataFrame:
    """Increments of cumulative counters per snapshot, under a watermark guard. ``order`` starts with a long; ``width`` is its span of a bucket.

    Stale snapshots give no row; after a reset the baseline starts anew without credit. Columns: key, order, the fields as increments,
    ``accepted``.

    Where totals rise, the watermark is the row itself once it has been passed; so of a rising stretch only its first and last total decide whether
    the watermark from before is held, and which one leaves it. The stretches (one more than there are drops) are read in order, each key's by one
    task; rows never are.
    """
    first, *then = order
    named = snapshots.select(key, *order, F.coalesce(F.col(total), F.lit(0)).alias("_total"), *(F.coalesce(f, F.lit(0)).alias(f) for f in fields))
    seen = carried(named, key, first, F.col("_total"), "_before", tuple(then), width, current=False)
    rows = running(seen, key, first, {"_stretch": (F.col("_total") < F.col("_before")).cast("int")}, tuple(then), width).drop("_before")
    rows = rows.withColumn("_stretch", F.coalesce("_stretch", F.lit(0)).cast("long"))
    ends = rows.groupBy(key, "_stretch").agg(F.min("_total").alias("_low"), F.max("_total").alias("_high"))

    def step(state: _Mark, row: tuple) -> tuple:
        name, stretch, low, high = row
        held = state.held
        state.held = held if held * 0.98 <= low and high < held else high
        return name, stretch, low, held

    kind = T.StructType([ends.schema[key], ends.schema["_stretch"], ends.schema["_low"], T.StructField("_held", ends.schema["_low"].dataType)])
    marks = in_order(ends, key, ["_stretch"], lambda _: _Mark(), step, kind)
    marks = marks.withColumnsRenamed({key: "_key", "_stretch": "_number"})
    met = rows.join(marks, rows[key].eqNullSafe(marks["_key"]) & (rows["_stretch"] == marks["_number"]))
    fresh = met.where(~((F.col("_held") * F.lit(0.98) <= F.col("_low")) & (F.col("_total") < F.col("_held")))).select(*rows.columns)
    steps = carried(fresh, key, first, F.struct(*fields), "_last", tuple(then), width, current=False)
    grown = lambda f: F.greatest(F.col(f) - F.coalesce(F.col("_last")[f], F.lit(0)), F.lit(0)).cast(snapshots.schema[f].dataType).alias(f)
    return steps.select(key, *order, *(grown(f) for f in fields), F.col("_total").alias("accepted"))


def _next_points(points: DataFrame, key: str, ts: str, window_ms: int) -> DataFrame:
    """``points`` with ``_to``: the first time of the key that is ``window_ms`` or more later."""
    at = points.select(key, F.col(ts).alias("_at"), F.col(ts).alias("_point"), *(c for c in points.columns if c not in (key, ts)), F.lit(0).alias("_probe"))
    probes = points.select(key, (F.col(ts) + window_ms).alias("_at"), F.lit(None).cast("long").alias("_point"), *(c for c in points.columns if c not in (key, ts)), F.lit(1).alias("_probe"))
    both = at.unionByName(probes).withColumn("_back", -F.col("_at"))  # from the latest on; a point before the probes of its time
    found = carried(both, key, "_back", F.col("_point"), "_to", ("_probe",)).where("_probe = 1")
    return found.select(key, (F.col("_at") - window_ms).alias(ts), *(c for c in points.columns if c not in (key, ts)), "_to")


def anchored_block(events: DataFrame, key: str, ts: str, value: str, window_ms: int) -> DataFrame:
    """The current block per key: it opens at an event and, once ``window_ms`` are over, again at the next event.

    An event that follows the one before after ``window_ms`` or more opens a block whatever came before, so only what follows the last such
    event counts. Where that is longer than a block, each event points to the one that would open the next block. Pointers out of a
    stretch of time are joined to pointers out of the next one, which doubles the stretches; of these only those near a
    stretch's start are needed, so that each round has half the rows of the one before.
    """
    points = events.where(F.col(ts).isNotNull()).groupBy(key, ts).agg(F.sum(value).alias("v"))
    seen = carried(points, key, ts, F.col(ts), "_prev", current=False)
    opens = F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") >= window_ms)
    ends = cut(seen.groupBy(key).agg(F.max(F.when(opens, F.col(ts))).alias("_from"), F.max(ts).alias("last_ts")).withColumnRenamed(key, "_key"))
    longest = ends.agg(F.max(F.col("last_ts") - F.col("_from"))).first()[0] or 0
    held: list[DataFrame] = []
    starts = ends.select("_key", "last_ts", F.col("_from").alias("block_start"))
    if longest >= window_ms:
        tail = seen.join(ends.where(F.col("last_ts") - F.col("_from") >= window_ms), F.col(key).eqNullSafe(F.col("_key"))).where(F.col(ts) >= F.col("_from"))
        nodes = cut(_next_points(tail.select(key, ts, "_from", "_prev"), key, ts, window_ms).withColumn("_last", F.col(ts)))
        held.append(nodes)
        size = window_ms
        while size <= longest:
            size *= 2
            since = F.col(ts) - F.col("_from")
            end = F.col("_from") + (F.floor(since / size) + 1) * size
            passed = lambda t: F.floor((t - F.col("_from") - window_ms) / size)  # noqa: B023, E731
            entry = (since % size < window_ms) | F.col("_prev").isNull() | (passed(F.col(ts)) != passed(F.col("_prev")))
            inside = F.coalesce(F.col("_to") < end, F.lit(False))
            left = nodes.where(entry).withColumn("_inside", inside)
            right = nodes.select(F.col(key).alias("_rkey"), F.col(ts).alias("_rts"), F.col("_to").alias("_rto"), F.col("_last").alias("_rlast"))
            met = left.join(right, F.col(key).eqNullSafe(F.col("_rkey")) & (F.when(F.col("_inside"), F.col("_to")) == F.col("_rts")), "left")
            pick = lambda far, near, name: F.when(F.col("_inside"), F.col(far)).otherwise(F.col(near)).alias(name)
            nodes = cut(met.select(key, ts, "_from", "_prev", pick("_rto", "_to", "_to"), pick("_rlast", "_last", "_last")))
            held.append(nodes)
        found = nodes.where(F.col(ts) == F.col("_from")).select(F.col(key).alias("_fkey"), "_last")
        starts = starts.join(found, F.col("_key").eqNullSafe(F.col("_fkey")), "left").select("_key", "last_ts", F.coalesce("_last", "block_start").alias("block_start"))
        starts = cut(starts)
        discard(events.sparkSession, *held)
    used = points.join(starts, F.col(key).eqNullSafe(F.col("_key"))).where(F.col(ts) >= F.col("block_start"))
    used = used.groupBy(key, "block_start", "last_ts").agg(F.sum(F.coalesce("v", F.lit(0))).cast("long").alias("used"))
    return used.select(key, "block_start", "last_ts", "used", (F.col("block_start") + window_ms).alias("resets_at"))

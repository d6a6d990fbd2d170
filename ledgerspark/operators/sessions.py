"""Sessions out of atoms: the fold that all harnesses share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import COUNTS, total_tokens
from . import activity as A


def fold(usage: DataFrame, events: DataFrame, harness: str, gap_ms: int = A.GAP_MS, efficiency: bool = False) -> DataFrame:
    """One row per session: counts, models, most used model, activity, turns; with ``efficiency`` also context growth.

    Sessions without usage but with activity are left out; ``ended_at`` is the start plus the wall time.
    """
    models = usage.groupBy("session", "model").agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS), F.sum("thinking").cast("long").alias("thinking"), F.count("*").alias("messages"))
    own = models.withColumn("total", total_tokens()).groupBy("session").agg(
        F.max_by("model", F.struct("total", "model")).alias("model"), F.array_sort(F.collect_list(F.struct("model", *COUNTS))).alias("models"),
        *(F.sum(c).alias(c) for c in COUNTS), F.sum("thinking").alias("thinking"), F.sum("messages").alias("messages"),
    )
    starts = events.groupBy("session").agg(F.min("ts").alias("started_at"))
    out = own.join(starts, "session", "left").join(A.activity(events, gap_ms=gap_ms), "session", "left").join(A.loops(events, gap_ms=gap_ms), "session", "left")
    out = out.withColumn("ended_at", F.col("started_at") + F.col("wall_ms")).withColumn("harness", F.lit(harness))
    if efficiency:
        main = usage if "is_sidechain" in usage.columns else usage.withColumn("is_sidechain", F.lit(False))
        mue = A.efficiency(main)
        names = [c for c in mue.columns if c != "session"]
        out = out.join(mue.select("session", F.struct(*names).alias("mue")), "session", "left").join(A.occupancy(main).select("session", F.struct("occupancy", "model", "at").alias("context")), "session", "left")
    return out

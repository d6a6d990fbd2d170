"""Active and idle time of sessions from their event times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import carried, swept

GAP_MS, FLOOR_MS, TAIL_MS = 300_000, 1000, 30_000
DAY_MS = 86_400_000


def gaps(events: DataFrame, session: str = "session", ts: str = "ts") -> DataFrame:
    """``session, ts, prev, n``: each distinct time of a session, the time before it and its number of events."""
    times = events.where(F.col(ts).isNotNull()).groupBy(session, ts).agg(F.count("*").alias("n"))
    return carried(times, session, ts, F.col(ts), "prev", current=False)


def _credit(gap: Column, gap_ms: int, floor_ms: int) -> Column:
    return F.least(F.greatest(gap, F.lit(min(max(0, floor_ms), gap_ms))), F.lit(gap_ms))


def activity(events: DataFrame, session: str = "session", ts: str = "ts", gap_ms: int = GAP_MS, floor_ms: int = FLOOR_MS) -> DataFrame:
    """``wall_ms, active_ms, idle_ms`` per session: gaps credited between floor and cap, the last event with a short tail."""
    tail = min(gap_ms, TAIL_MS)
    gap = F.col(ts) - F.col("prev")
    again = (F.col("n") - 1) * _credit(F.lit(0), gap_ms, floor_ms)  # repeated times are gaps of zero
    credit = F.coalesce(_credit(gap, gap_ms, floor_ms), F.lit(0)) + again
    idle = F.coalesce(F.greatest(gap - gap_ms, F.lit(0)), F.lit(0))
    sums = gaps(events, session, ts).groupBy(session).agg((F.sum(F.when(F.col("prev").isNotNull(), credit).otherwise(again)) + tail).cast("long").alias("active_ms"), F.sum(idle).cast("long").alias("idle_ms"))
    return sums.select(session, (F.col("active_ms") + F.col("idle_ms")).alias("wall_ms"), "active_ms", "idle_ms")


def loops(events: DataFrame, session: str = "session", ts: str = "ts", prompt: str = "is_prompt", gap_ms: int = GAP_MS) -> DataFrame:
    """``turns, longest_loop_ms``: prompts, and the longest active stretch after one and before the next.

    Any event at a prompt's time is a border; a stretch is known by the prompt that opened it.
    """
    times = events.where(F.col(ts).isNotNull()).groupBy(session, ts).agg(F.sum(F.col(prompt).cast("long")).alias("prompts"))
    border = F.when(F.col("prompts") > 0, F.col(ts))
    marked = swept(times, session, ts, lasts={"prev": (F.col(ts), False), "opened": (border, True)})
    step = F.when((F.col("prompts") == 0) & F.col("opened").isNotNull(), F.least(F.col(ts) - F.col("prev"), F.lit(gap_ms))).otherwise(0)
    stretches = marked.groupBy(session, "opened").agg(F.sum(step).alias("ms"), F.sum("prompts").alias("prompts"))
    return stretches.groupBy(session).agg(F.sum("prompts").alias("turns"), F.max("ms").alias("longest_loop_ms"))


def by_day(spans: DataFrame, keys: list[str], start: str, length: str, names: dict[str, Column]) -> DataFrame:
    """Clip spans of milliseconds into UTC days and sum them: ``keys, day`` and a sum for each of ``names`` (its condition)."""
    begin, end = F.col(start), F.col(start) + F.col(length)
    first, last = F.floor(begin / DAY_MS), F.floor((end - 1) / DAY_MS)
    parts = spans.where(F.col(length) > 0).withColumn("day_no", F.explode(F.sequence(first, last)))
    inside = F.least(end, (F.col("day_no") + 1) * DAY_MS) - F.greatest(begin, F.col("day_no") * DAY_MS)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day_no").cast("int"))
    return parts.groupBy(*keys, day.alias("day")).agg(*(F.sum(F.when(c, inside).otherwise(0)).cast("long").alias(n) for n, c in names.items()))


def day_slices(events: DataFrame, session: str = "session", ts: str = "ts", gap_ms: int = GAP_MS, floor_ms: int = FLOOR_MS) -> DataFrame:
    """``active_ms, idle_ms`` per session and UTC day; they add up to ``activity`` exactly."""
    tail = min(gap_ms, TAIL_MS)
    gap = F.col(ts) - F.col("prev")
    floor = min(max(0, floor_ms), gap_ms)
    span = lambda start, length, kind: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), F.lit(kind).alias("kind"))
    own = F.array(span(F.col("prev"), _credit(gap, gap_ms, floor_ms), "active"), span(F.col("prev") + gap_ms, gap - gap_ms, "idle"))
    again = F.array_repeat(span(F.col(ts), F.lit(floor), "active"), (F.col("n") - 1).cast("int"))  # repeated times are gaps of zero
    held = F.filter(F.concat(own, again), lambda x: x["start"].isNotNull() & (x["length"] > 0))
    between = gaps(events, session, ts).select(session, F.explode(held).alias("x")).select(session, "x.*")
    last = events.where(F.col(ts).isNotNull()).groupBy(session).agg(F.max(ts).alias("start")).select(session, "start", F.lit(tail).cast("long").alias("length"), F.lit("active").alias("kind"))
    spans = between.unionByName(last)
    return by_day(spans, [session], "start", "length", {"active_ms": F.col("kind") == "active", "idle_ms": F.col("kind") == "idle"})


def session_days(usage: DataFrame, events: DataFrame, session: str = "session", ts: str = "ts", counts: tuple[str, ...] = ("input", "output", "cache_read", "cache_creation"), **options) -> DataFrame:
    """Tokens and activity per session and UTC day, for sessions that touch at least two days.

    Usage without a time goes to the last day that its session touches.
    """
    slices = day_slices(events, session, ts, **options)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts) / DAY_MS).cast("int"))
    dated = usage.select(session, day.alias("day"), *counts)
    touched = slices.select(session, "day").unionByName(dated.select(session, "day")).where("day is not null")
    ends = touched.groupBy(session).agg(F.max("day").alias("last_day"), F.countDistinct("day").alias("days")).where("days >= 2")
    placed = dated.join(ends, session).groupBy(session, F.coalesce("day", "last_day").alias("day")).agg(*(F.sum(c).alias(c) for c in counts))
    joined = slices.join(ends.select(session), session, "left_semi").join(placed, [session, "day"], "full")
    return joined.select(session, "day", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("active_ms", "idle_ms", *counts)))


def end_anchored_days(usage: DataFrame, events: DataFrame, session: str = "session", ts: str = "ts", counts: tuple[str, ...] = ("input", "output", "cache_read", "cache_creation"), **options) -> DataFrame:
    """As ``session_days``, with a session's tokens all on its last day (logs that state only a session total)."""
    slices = day_slices(events, session, ts, **options)
    ends = slices.groupBy(session).agg(F.max("day").alias("day"), F.count("*").alias("days")).where("days >= 2")
    totals = usage.groupBy(session).agg(*(F.sum(c).alias(c) for c in counts)).join(ends.select(session, "day"), session)
    joined = slices.join(ends.select(session), session, "left_semi").join(totals, [session, "day"], "left")
    return joined.select(session, "day", "active_ms", "idle_ms", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))


def efficiency(usage: DataFrame, session: str = "session", ts: str = "ts", then: tuple[str, ...] = ("ord",), min_points: int = 8, drop_from: int = 20_000, drop_to: float = 0.5) -> DataFrame:
    """Context growth per session: the slope of log cumulative context on log cumulative output, and what goes with it.

    Main-thread rows only. Null-free rows come back only for sessions with ``min_points`` points that have both sums.
    """
    main = usage.where("not coalesce(is_sidechain, false)").withColumn("context", F.col("input") + F.col("cache_read") + F.col("cache_creation"))
    seen = swept(main, session, ts, {"cum_output": F.col("output"), "cum_context": F.col("context")}, {"prev_context": (F.col("context"), False)}, then)
    point = (F.col("cum_output") > 0) & (F.col("cum_context") > 0)
    x, y = F.when(point, F.ln("cum_output")), F.when(point, F.ln("cum_context"))
    found = seen.groupBy(session).agg(
        F.regr_slope(y, x).alias("slope"),
        F.count_if(point).alias("log_points"),
        F.sum("context").alias("c_actual"),
        F.sum("output").alias("outputs"),
        F.min(F.when(F.col("context") > 0, F.col("context"))).alias("least"),
        F.count_if((F.col("prev_context") >= drop_from) & (F.col("context") < drop_to * F.col("prev_context"))).alias("compactions"),
        F.count("*").alias("points"),
    )
    ideal = F.col("least") * F.col("points")
    return found.where((F.col("log_points") >= min_points) & (F.col("c_actual") > 0) & (F.col("outputs") > 0)).select(
        session,
        F.coalesce("slope", F.lit(1.0)).alias("alpha"),
        "c_actual",
        ideal.alias("c_ideal"),
        F.least(F.lit(1.0), ideal / F.col("c_actual")).alias("ratio"),
        (F.col("c_actual") / F.col("outputs")).alias("cost_per_output"),
        "compactions",
        "points",
    )


def occupancy(usage: DataFrame, session: str = "session", ts: str = "ts", then: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The last non-zero main-thread context per session, with its model and time; rows without a time come last."""
    context = F.col("input") + F.col("cache_read") + F.col("cache_creation")
    main = usage.where("not coalesce(is_sidechain, false)").withColumn("context", context).where("context > 0")
    place = F.struct(F.col(ts).isNull(), ts, *then)
    best = main.groupBy(session).agg(F.max_by(F.struct("context", "model", ts), place).alias("last"))
    return best.select(session, F.col("last.context").alias("occupancy"), F.col("last.model").alias("model"), F.col(f"last.{ts}").alias("at"))

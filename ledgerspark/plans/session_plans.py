"""Queries of the activity, dedup, ordered-state and efficiency operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pricing import COUNTS
from ..operators import activity as A
from ..operators import dedup as D
from ..operators import ordered as O
from .bindings import GAP_MS, sessions, sql, usage

QUERIES: dict = {}
ORACLE: dict = {}
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


@query("w1_gaps", sql("SELECT session, ts, lag(ts) OVER (PARTITION BY session ORDER BY ts) AS prev, n FROM times", "times"))
def gaps(spark, d):
    return A.gaps(usage(spark, d))


_ACTIVE = """SELECT session, CAST(sum(CASE WHEN gap IS NULL THEN 0 ELSE least(greatest(gap, 1000), {g}) END) + 30000 AS BIGINT) AS active_ms,
  CAST(sum(coalesce(greatest(gap - {g}, 0), 0)) AS BIGINT) AS idle_ms FROM gaps GROUP BY session"""


@query("a7_activity", sql(f"SELECT *, active_ms + idle_ms AS wall_ms FROM ({_ACTIVE.format(g=300000)})", "gaps"))
def activity(spark, d):
    return A.activity(usage(spark, d))


@query("a7_activity_long_gap", sql(f"SELECT *, active_ms + idle_ms AS wall_ms FROM ({_ACTIVE.format(g=GAP_MS)})", "gaps"))
def activity_long_gap(spark, d):
    return A.activity(usage(spark, d), gap_ms=GAP_MS)


@query(
    "a8_loops",
    sql(
        f"""SELECT session, CAST(sum(p) AS BIGINT) AS turns, CAST(max(ms) AS BIGINT) AS longest_loop_ms FROM (
             SELECT session, island, sum(prompts) AS p, sum(CASE WHEN prompts = 0 AND island > 0 THEN least(gap, {GAP_MS}) ELSE 0 END) AS ms FROM (
               SELECT *, ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) AS gap, sum((prompts > 0)::INT) OVER (PARTITION BY session ORDER BY ts) AS island FROM times)
             GROUP BY session, island) GROUP BY session""",
        "times",
    ),
)
def loops(spark, d):
    return A.loops(usage(spark, d), gap_ms=GAP_MS)


@query("w2_prompt_islands", sql("SELECT session, ts, CASE WHEN max(CASE WHEN prompts > 0 THEN ts END) OVER w IS NOT NULL THEN max(CASE WHEN prompts > 0 THEN ts END) OVER w END AS opened FROM times WINDOW w AS (PARTITION BY session ORDER BY ts)", "times"))
def prompt_islands(spark, d):
    times = usage(spark, d).groupBy("session", "ts").agg(F.max(F.col("is_prompt")).alias("p"))
    return O.carried(times, "session", "ts", F.when(F.col("p"), F.col("ts")), "opened").select("session", "ts", "opened")


@query("a9_day_slices", sql("SELECT * FROM slices", "slices"))
def day_slices(spark, d):
    return A.day_slices(usage(spark, d), gap_ms=GAP_MS)


_TOUCHED = "SELECT session, count(DISTINCT day) AS days, max(day) AS last_day FROM (SELECT session, day FROM slices UNION ALL SELECT session, CAST(make_timestamp(ts * 1000) AS DATE) FROM usage) GROUP BY session HAVING count(DISTINCT day) >= 2"


@query(
    "a10_session_days",
    sql(
        f"""SELECT coalesce(s.session, t.session) AS session, coalesce(s.day, t.day) AS day, coalesce(active_ms, 0) AS active_ms, coalesce(idle_ms, 0) AS idle_ms,
              {', '.join(f'coalesce({c}, 0) AS {c}' for c in COUNTS)}
            FROM (SELECT * FROM slices WHERE session IN (SELECT session FROM ({_TOUCHED}))) s
            FULL JOIN (SELECT u.session, coalesce(CASE WHEN ord % 50 <> 0 THEN CAST(make_timestamp(ts * 1000) AS DATE) END, last_day) AS day, {_SUMS} FROM usage u JOIN ({_TOUCHED}) k USING (session) GROUP BY ALL) t
            ON s.session = t.session AND s.day = t.day""",
        "slices",
    ),
)
def session_days(spark, d):
    rows = usage(spark, d)
    undated = rows.withColumn("ts", F.when(F.col("ord") % 50 != 0, F.col("ts")))  # some usage without a time
    return A.session_days(undated, rows, gap_ms=GAP_MS)


@query(
    "a11_end_anchored_days",
    sql(
        f"""SELECT s.session, s.day, active_ms, idle_ms, {', '.join(f'coalesce(t.{c}, 0) AS {c}' for c in COUNTS)} FROM slices s
            JOIN (SELECT session, max(day) AS last_day FROM slices GROUP BY session HAVING count(*) >= 2) k USING (session)
            LEFT JOIN (SELECT session, {_SUMS} FROM usage GROUP BY session) t ON t.session = s.session AND s.day = k.last_day""",
        "slices",
    ),
)
def end_anchored_days(spark, d):
    rows = usage(spark, d)
    return A.end_anchored_days(rows, rows, gap_ms=GAP_MS)


@query("f10_day_keys", sql("SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS day, count(*) AS n FROM usage GROUP BY 1", "usage"))
def day_keys(spark, d):
    from ..operators.views import local_day

    return usage(spark, d).groupBy(local_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


_BEST = "row_number() OVER (PARTITION BY message_id, request_id ORDER BY is_sidechain, input + output + cache_read + cache_creation DESC, cost DESC, has_speed DESC, ord)"


@query(
    "a1_dedup_exact",
    sql(f"SELECT ord, message_id, request_id, model, input, output, cache_read, cache_creation, owner FROM (SELECT *, {_BEST} AS rn, first_value(thread) OVER (PARTITION BY message_id, request_id ORDER BY ord) AS owner FROM usage) WHERE rn = 1", "usage"),
)
def dedup_exact(spark, d):
    rows = usage(spark, d).select("ord", "thread", "message_id", "request_id", "is_sidechain", "cost", "has_speed", "model", *COUNTS)
    return D.exact_tier(rows).select("ord", "message_id", "request_id", "model", *COUNTS, "owner")


_RECORD = "struct_pack(r := request_id, s := is_sidechain, t := input + output + cache_read + cache_creation, c := cost, v := has_speed, ord := ord, owner := thread)"
_WINS = "CASE WHEN x.s <> y.s THEN y.s WHEN x.t <> y.t THEN x.t > y.t WHEN x.c <> y.c THEN x.c > y.c ELSE x.v AND NOT y.v END"
_MEETS = """coalesce(nullif(list_position(list_transform(acc, lambda y: y.r IS NOT DISTINCT FROM x.r), true), 0),
                     nullif(list_position(list_transform(acc, lambda y: x.s OR y.s), true), 0), 0)"""


@query(
    "a1_dedup_two_tier",
    sql(
        f"""SELECT u.ord, u.message_id, u.request_id, u.model, u.input, u.output, u.cache_read, u.cache_creation, k.owner FROM (
             SELECT unnest(list_reduce(xs, lambda acc, x: CASE WHEN {_MEETS} = 0 THEN list_append(acc, x)
               ELSE list_transform(acc, lambda y, i: CASE WHEN i = {_MEETS} AND {_WINS} THEN struct_pack(r := x.r, s := x.s, t := x.t, c := x.c, v := x.v, ord := x.ord, owner := y.owner) ELSE y END) END, []), recursive := true)
             FROM (SELECT message_id, list({_RECORD} ORDER BY ord) AS xs FROM usage WHERE ord % 9 <> 0 GROUP BY message_id)) k
           JOIN usage u ON u.ord = k.ord
           UNION ALL SELECT ord, NULL, request_id, model, input, output, cache_read, cache_creation, thread FROM usage WHERE ord % 9 = 0""",
        "usage",
    ),
)
def dedup_two_tier(spark, d):
    rows = usage(spark, d).select("ord", "thread", F.when(F.col("ord") % 9 != 0, F.col("message_id")).alias("message_id"), "request_id", "is_sidechain", "cost", "has_speed", "model", *COUNTS)
    return D.deduplicate(rows).select("ord", "message_id", "request_id", "model", *COUNTS, "owner")


@query("a2_model_fold", sql(f"SELECT session, model, {_SUMS} FROM usage GROUP BY session, model", "usage"))
def model_fold(spark, d):
    return usage(spark, d).groupBy("session", "model").agg(*(F.sum(c).alias(c) for c in COUNTS))


@query(
    "a6_thread_totals",
    sql(
        f"""SELECT t.thread, first_ts, coalesce(messages, 0) AS messages, {', '.join(f'coalesce({c}, 0) AS {c}' for c in COUNTS)} FROM (SELECT thread, min(ts) AS first_ts FROM usage GROUP BY thread) t
            LEFT JOIN (SELECT owner, count(*) AS messages, {_SUMS} FROM (SELECT *, {_BEST} AS rn, first_value(thread) OVER (PARTITION BY message_id, request_id ORDER BY ord) AS owner FROM usage) WHERE rn = 1 GROUP BY owner) k ON k.owner = t.thread""",
        "usage",
    ),
)
def thread_totals(spark, d):
    rows = usage(spark, d)
    return D.thread_totals(rows, D.exact_tier(rows.select("ord", "thread", "message_id", "request_id", "is_sidechain", "cost", "has_speed", *COUNTS)))


@query(
    "a13_invocations",
    sql(
        """SELECT thread, id, count(*) AS n FROM (
             SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS rn FROM (SELECT ord, thread, 's' || (k % 23) AS id, CASE WHEN ord % 4 <> 0 THEN 'k' || (ord % 700) END AS key FROM usage))
           WHERE key IS NULL OR rn = 1 GROUP BY thread, id""",
        "usage",
    ),
)
def invocations(spark, d):
    events = usage(spark, d).select("ord", "thread", F.concat(F.lit("s"), F.col("k") % 23).alias("id"), F.when(F.col("ord") % 4 != 0, F.concat(F.lit("k"), F.col("ord") % 700)).alias("key"))
    return D.count_invocations(events)


@query(
    "a14_capped_buckets",
    sql(
        """SELECT thread, CASE WHEN n_all > 16 AND rn >= 16 THEN 'other' ELSE id END AS id, CAST(sum(n) AS BIGINT) AS n FROM (
             SELECT *, row_number() OVER (PARTITION BY thread ORDER BY n DESC, id) AS rn, count(*) OVER (PARTITION BY thread) AS n_all FROM (SELECT thread, 's' || (k % 23) AS id, count(*) AS n FROM usage GROUP BY 1, 2)) GROUP BY 1, 2""",
        "usage",
    ),
)
def capped_buckets(spark, d):
    counts = usage(spark, d).groupBy("thread", F.concat(F.lit("s"), F.col("k") % 23).alias("id")).agg(F.count("*").alias("n"))
    return D.cap_buckets(counts, "thread")


@query("a15_latest_sessions", sql("SELECT session, ended_at, ord, input, output, cache_read, cache_creation FROM (SELECT session % 40 AS session, ts // 86400000 AS ended_at, ord, input, output, cache_read, cache_creation, row_number() OVER (PARTITION BY session % 40 ORDER BY ts // 86400000 DESC, input + output + cache_read + cache_creation DESC, ord) AS rn FROM usage) WHERE rn = 1", "usage"))
def latest_sessions(spark, d):
    rows = usage(spark, d).select((F.col("session") % 40).alias("session"), F.floor(F.col("ts") / 86_400_000).alias("ended_at"), "ord", *COUNTS)
    return D.latest_sessions(rows)


@query("sc3_largest_copies", "SELECT 'f' || (o_custkey % 300) AS name, arg_min('/r/' || o_orderkey, (-CAST(round(o_totalprice) AS BIGINT), o_orderkey)) AS path FROM orders GROUP BY 1")
def largest_copies(spark, d):
    files = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("f"), F.col("o_custkey") % 300).alias("name"), F.round("o_totalprice").cast("long").alias("size"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("/r/"), "o_orderkey").alias("path"))
    return D.largest_copies(files)


@query("a21_most_used", sql("SELECT arg_max(id, (n, -first)) AS id, max(n) AS n FROM (SELECT 's' || (k % 23) AS id, count(*) AS n, min(ord) AS first FROM usage GROUP BY 1)", "usage"))
def most_used(spark, d):
    from ..operators.views import most_used

    counts = usage(spark, d).groupBy(F.concat(F.lit("s"), F.col("k") % 23).alias("id"), (F.col("ord") % 3).alias("part")).agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    return most_used(counts)


_TOTAL = "CASE WHEN k = 0 THEN ord % 100 WHEN k < 8 THEN ord * 10 - ord // 3 WHEN k < 16 THEN ord * 10 - ord // 100 ELSE ord * 10 END"


@query(
    "w3_cumulative_deltas",
    "WITH RECURSIVE "
    + sql("", "usage").removeprefix("WITH ").rstrip()
    + f""",
  snaps AS (SELECT session, ord, {_TOTAL} AS total, ord * 6 - k AS input, ord * 2 + k AS output, row_number() OVER (PARTITION BY session ORDER BY ord) AS rn FROM usage),
  fold AS (
    SELECT session, ord, rn, total AS mark, total, input, output, true AS taken FROM snaps WHERE rn = 1
    UNION ALL
    SELECT s.session, s.ord, s.rn, CASE WHEN s.total >= f.mark THEN s.total WHEN s.total >= f.mark * 0.98 THEN f.mark ELSE s.total END, s.total, s.input, s.output,
           NOT (s.total < f.mark AND s.total >= f.mark * 0.98)
    FROM fold f JOIN snaps s ON s.session = f.session AND s.rn = f.rn + 1)
SELECT session, ord, CAST(greatest(input - coalesce(lag(input) OVER w, 0), 0) AS BIGINT) AS input, CAST(greatest(output - coalesce(lag(output) OVER w, 0), 0) AS BIGINT) AS output, total AS accepted
FROM fold WHERE taken WINDOW w AS (PARTITION BY session ORDER BY rn)""",
)
def cumulative_deltas(spark, d):
    k, ord_ = F.col("k"), F.col("ord")
    total = F.when(k == 0, ord_ % 100).when(k < 8, ord_ * 10 - F.floor(ord_ / 3)).when(k < 16, ord_ * 10 - F.floor(ord_ / 100)).otherwise(ord_ * 10)
    snaps = usage(spark, d).select("session", "ord", total.alias("total"), (ord_ * 6 - k).alias("input"), (ord_ * 2 + k).alias("output"))
    return O.cumulative_deltas(snaps, "session", ["ord"], "total", ["input", "output"])


_WINDOW = 5 * 3600 * 1000


@query(
    "w8_current_block",
    "WITH RECURSIVE "
    + sql("", "usage").removeprefix("WITH ").rstrip()
    + f""",
  pts AS (SELECT session, ts, sum(input + output + cache_read + cache_creation) AS v, row_number() OVER (PARTITION BY session ORDER BY ts) AS rn FROM usage GROUP BY session, ts),
  fold AS (SELECT session, rn, ts AS block FROM pts WHERE rn = 1 UNION ALL SELECT p.session, p.rn, CASE WHEN p.ts >= f.block + {_WINDOW} THEN p.ts ELSE f.block END FROM fold f JOIN pts p ON p.session = f.session AND p.rn = f.rn + 1),
  ends AS (SELECT session, arg_max(block, rn) AS block_start FROM fold GROUP BY session)
SELECT e.session, block_start, max(p.ts) AS last_ts, CAST(sum(p.v) FILTER (p.ts >= block_start) AS BIGINT) AS used, block_start + {_WINDOW} AS resets_at FROM ends e JOIN pts p ON p.session = e.session GROUP BY e.session, block_start""",
)
def current_block(spark, d):
    rows = usage(spark, d).withColumn("total", sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0])))
    return O.anchored_block(rows, "session", "ts", "total", _WINDOW)


@query("w9_change_points", sql("SELECT session, ord, a, b FROM (SELECT session, ord, k // 40 AS a, cache_creation // 4 AS b, lag(k // 40) OVER w AS pa, lag(cache_creation // 4) OVER w AS pb, row_number() OVER w AS rn FROM usage WINDOW w AS (PARTITION BY session ORDER BY ord)) WHERE rn = 1 OR a <> pa OR b <> pb", "usage"))
def change_points(spark, d):
    rows = usage(spark, d).select("session", "ord", F.floor(F.col("k") / 40).alias("a"), F.floor(F.col("cache_creation") / 4).alias("b"))
    return O.changes(rows, "session", "ord", ["a", "b"], 1000)


_PAID = "CASE WHEN k < 20 THEN 'cloud' WHEN k < 30 THEN 'bearer' WHEN k < 60 THEN 'api_key' WHEN k < 90 THEN 'subscription' ELSE 'unknown' END"


@query("f15_billing_flips", sql(f"SELECT session, ord, source, CASE WHEN was = 'subscription' AND source = 'api_key' THEN 'to_api_key' ELSE 'other_change' END AS kind FROM (SELECT session, ord, source, lag(source) OVER w AS was FROM (SELECT session, ord, {_PAID} AS source FROM usage) WINDOW w AS (PARTITION BY session ORDER BY ord)) WHERE was <> source", "usage"))
def billing_flips(spark, d):
    from ..functions.text import billing_source, flip_kind

    k = F.col("k")
    rows = usage(spark, d).select("session", "ord", billing_source(k < 20, k < 30, k < 60, k < 90).alias("source"))
    seen = O.carried(rows, "session", "ord", F.col("source"), "was", width=1000, current=False)
    return seen.withColumn("kind", flip_kind(F.col("was"), F.col("source"))).where("kind <> 'none'").select("session", "ord", "source", "kind")


@query("w5_running_sums", sql("SELECT session, ord, CAST(sum(output) OVER w AS BIGINT) AS cum_output, CAST(sum(input + cache_read + cache_creation) OVER w AS BIGINT) AS cum_context FROM usage WINDOW w AS (PARTITION BY session ORDER BY ts, ord)", "usage"))
def running_sums(spark, d):
    rows = O.running(usage(spark, d), "session", "ts", {"cum_output": F.col("output"), "cum_context": F.col("input") + F.col("cache_read") + F.col("cache_creation")}, ("ord",))
    return rows.select("session", "ord", "cum_output", "cum_context")


@query(
    "a12_context_efficiency",
    sql(
        """SELECT session, round(coalesce(regr_slope(y, x), 1.0), 8) AS alpha, CAST(sum(c) AS BIGINT) AS c_actual, CAST(min(CASE WHEN c > 0 THEN c END) * count(*) AS BIGINT) AS c_ideal,
              round(least(1.0, min(CASE WHEN c > 0 THEN c END) * count(*) / sum(c)), 8) AS ratio, round(sum(c) / sum(output), 8) AS cost_per_output,
              count(*) FILTER (prev >= 20000 AND c < 0.5 * prev) AS compactions, count(*) AS points
           FROM (SELECT *, CASE WHEN co > 0 AND cc > 0 THEN ln(co) END AS x, CASE WHEN co > 0 AND cc > 0 THEN ln(cc) END AS y, lag(c) OVER (PARTITION BY session ORDER BY ts, ord) AS prev FROM (
              SELECT *, CAST(sum(output) OVER w AS DOUBLE) AS co, CAST(sum(c) OVER w AS DOUBLE) AS cc FROM (SELECT *, input * 20 + cache_read + cache_creation AS c FROM usage WHERE NOT is_sidechain) WINDOW w AS (PARTITION BY session ORDER BY ts, ord)))
           GROUP BY session HAVING count(x) >= 8 AND sum(c) > 0 AND sum(output) > 0""",
        "usage",
    ),
)
def context_efficiency(spark, d):
    rows = A.efficiency(usage(spark, d).withColumn("input", F.col("input") * 20))
    return rows.select("session", F.round("alpha", 8).alias("alpha"), "c_actual", "c_ideal", F.round("ratio", 8).alias("ratio"), F.round("cost_per_output", 8).alias("cost_per_output"), "compactions", "points")


@query("w6_compactions", sql("SELECT session, count(*) AS n FROM (SELECT session, c, lag(c) OVER (PARTITION BY session ORDER BY ts, ord) AS prev FROM (SELECT *, input * 20 + cache_read + cache_creation AS c FROM usage WHERE NOT is_sidechain)) WHERE prev >= 20000 AND c < 0.5 * prev GROUP BY session", "usage"))
def compactions(spark, d):
    rows = usage(spark, d).withColumn("input", F.col("input") * 20)
    return A.efficiency(rows, min_points=0).where("compactions > 0").select("session", F.col("compactions").alias("n"))


@query("w7_occupancy", sql("SELECT session, arg_max(c, (t, ord)) AS occupancy, arg_max(model, (t, ord)) AS model FROM (SELECT *, input + cache_read + cache_creation AS c, ts AS t FROM usage) WHERE NOT is_sidechain AND c > 0 GROUP BY session", "usage"))
def occupancy(spark, d):
    return A.occupancy(usage(spark, d)).select("session", "occupancy", "model")


@query("a25_watermark", sql("SELECT harness, max(ts) AS watermark FROM usage GROUP BY harness", "usage"))
def watermark(spark, d):
    return usage(spark, d).groupBy("harness").agg(F.max("ts").alias("watermark"))


@query("a26_deployment", sql("SELECT max(tokens) AS peak, CAST(sum(tokens) AS BIGINT) AS total, count(*) AS sessions, CAST(max(ended_at) - min(started_at) AS BIGINT) AS span_ms FROM sessions", "sessions"))
def deployment(spark, d):
    return sessions(spark, d).agg(F.max("tokens").alias("peak"), F.sum("tokens").alias("total"), F.count("*").alias("sessions"), (F.max("ended_at") - F.min("started_at")).alias("span_ms"))


@query(
    "large_fold_lineitem",
    "SELECT l_returnflag || l_linestatus AS model, count(DISTINCT l_orderkey) AS sessions, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1",
)
def large_fold_lineitem(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.groupBy(F.concat("l_returnflag", "l_linestatus").alias("model")).agg(F.countDistinct("l_orderkey").alias("sessions"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))

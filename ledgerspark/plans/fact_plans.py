"""Queries of single facts of logs, stored state, and passes over state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import state
from ..functions import text as T
from ..sources import corpus, logs, sinks, sqlite
from ..sources.lines import lines, stem, text_lines
from ..streaming import incremental as I
from . import bindings
from .bindings import sql, usage
from .home_plans import _row, homes_of, stored
from .source_plans import as_files, iso, name
from .stream_plans import folder
from .text_plans import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(label: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[label] = fn
        if oracle:
            ORACLE[label] = oracle
        return fn

    return keep


_CLAUDE = "(SELECT session, CAST(session AS VARCHAR) AS s, ord, model, project FROM usage WHERE harness = 'claude_code' UNION ALL SELECT session, CAST(session + 1000000 AS VARCHAR), ord, model, project FROM usage WHERE harness = 'claude_code' AND session % 2 = 0)"


@query("sc1_log_lines", sql(f"SELECT s AS session, count(*) AS n FROM {_CLAUDE} GROUP BY s", "usage"))
def log_lines(spark, d):
    rows = lines(text_lines(spark, homes_of(spark, d, "claude_code")["claude_code"], "*.jsonl"))
    return rows.groupBy(stem(F.col("path")).alias("session")).agg(F.count("*").alias("n"))


@query("w12_thread_facts", sql(f"SELECT s AS session, '/w/' || any_value(project) AS cwd, CAST(any_value(session) AS VARCHAR) AS tool_session_id, arg_max(model, ord) AS last_model FROM {_CLAUDE} GROUP BY s", "usage"))
def thread_facts(spark, d):
    return corpus.atoms_of(spark, "claude_code", [homes_of(spark, d, "claude_code")["claude_code"]]).meta.select("session", "cwd", "tool_session_id", "last_model")


@query("sc12_grok_credits", sql("SELECT 'T' || arg_max(k, (session, ord)) AS tier, CAST(arg_max(k, (session, ord)) AS DOUBLE) AS percent, 'WEEKLY' AS period, arg_max(ts, (session, ord)) AS resets_at_ms FROM (SELECT *, 1000000 + session AS name FROM usage) WHERE NOT is_prompt", "usage"))
def grok_credits(spark, d):
    config = F.struct(F.col("k").alias("creditUsagePercent"), F.struct(F.lit("WEEKLY").alias("type"), iso(F.col("ts")).alias("end")).alias("currentPeriod"))
    ctx = F.struct(F.concat(F.lit("T"), F.col("k")).alias("subscriptionTier"), F.when(~F.col("is_prompt"), config).alias("config"))
    line = F.to_json(F.struct(iso(F.col("ts")).alias("ts"), F.lit("billing: fetched credits config").alias("msg"), ctx.alias("ctx")))
    rows = usage(spark, d).withColumn("session", F.col("session") + 1_000_000)  # file names in order
    return logs.grok_credits(as_files(rows, line, name("/g/{}/unified.jsonl"))).select("tier", "percent", "period", "resets_at_ms")


@query("sc27_codex_limits", sql("SELECT x.slot, CAST(x.percent AS DOUBLE) AS percent, x.minutes::BIGINT AS minutes, x.resets AS resets_at_ms FROM (SELECT unnest([{'slot': 'primary', 'percent': k, 'minutes': 300, 'resets': 5000000}, {'slot': 'secondary', 'percent': k + 1, 'minutes': 10080, 'resets': ts + 60000}]) AS x FROM (SELECT arg_max(k, (session, ord)) AS k, arg_max(ts, (session, ord)) AS ts FROM usage))", "usage"))
def codex_limits(spark, d):
    lane = lambda percent, minutes, **more: F.struct(percent.alias("used_percent"), F.lit(minutes).alias("window_minutes"), *(F.lit(v).alias(n) for n, v in more.items()))
    limits = F.struct(lane(F.col("k"), 300, resets_at=5000).alias("primary"), lane(F.col("k") + 1, 10_080, resets_in_seconds=60).alias("secondary"))
    line = F.to_json(F.struct(F.lit("event_msg").alias("type"), iso(F.col("ts")).alias("timestamp"), F.struct(F.lit("token_count").alias("type"), limits.alias("rate_limits")).alias("payload")))
    rows = usage(spark, d).withColumn("session", F.col("session") + 1_000_000)
    return logs.codex_limits(as_files(rows, line, name("/c/rollout-{}.jsonl")))


@query("sc28_vendor_limits", """
SELECT c_custkey, kind, lane_group, percent, resets_at FROM (
  SELECT c_custkey, 'five_hour_stated' AS kind, 'session' AS lane_group, c_acctbal AS percent, '2026-01-01T00:00:00Z' AS resets_at FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'session', 'session', c_acctbal / 2, '2026-01-01T00:00:00Z' FROM customer WHERE c_custkey % 3 = 1
  UNION ALL SELECT c_custkey, 'weekly_all', 'weekly', c_acctbal / 4, '2026-01-02T00:00:00Z' FROM customer WHERE c_custkey % 3 = 1)""")
def vendor_limits(spark, d):
    k, at = F.col("c_custkey"), F.lit("2026-01-01T00:00:00Z")
    stated = F.array(F.struct(F.lit("five_hour_stated").alias("kind"), F.lit("session").alias("group"), F.col("c_acctbal").alias("percent"), F.lit("normal").alias("severity"), at.alias("resets_at"), F.struct(F.struct(k.cast("string").alias("display_name")).alias("model")).alias("scope")))
    window = lambda share, at: F.struct((F.col("c_acctbal") / share).alias("utilization"), at.alias("resets_at"))
    body = F.struct(F.when(k % 3 == 0, stated).alias("limits"), F.when(k % 3 == 1, window(2, at)).alias("five_hour"), F.when(k % 3 == 1, window(4, F.lit("2026-01-02T00:00:00Z"))).alias("seven_day"))
    rows = table(spark, d, "customer").select("c_custkey", F.to_json(body).alias("value"))
    return logs.vendor_limits(rows, keep=("c_custkey",)).select("c_custkey", "kind", "lane_group", "percent", "resets_at")


@query("sc21_copilot_traces", sql("SELECT CAST(session AS VARCHAR) AS session, model, count(*) AS n, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, min(ts) AS first_ts FROM usage WHERE harness = 'copilot' AND k <> 3 GROUP BY session, model", "usage"))
def copilot_traces(spark, d):
    root = folder(spark).removeprefix("file:")
    rows = usage(spark, d).where("harness = 'copilot'")
    said = F.to_json(F.struct(F.col("session").cast("string").alias("copilot.session.id"), F.col("model").alias("gen_ai.request.model"), F.when(F.col("k") != 3, F.col("input")).alias("gen_ai.usage.input_tokens"), F.col("output").alias("gen_ai.usage.output_tokens"), F.col("cache_read").alias("gen_ai.usage.cache_read_tokens")))
    values = _row("tit", F.when(F.col("ord") % 2 == 0, F.col("session").cast("string")), F.col("ts") * 1_000_000, said)
    stored(rows.select(F.concat((F.col("session") % 4).cast("string"), F.lit("/traces.db")).alias("path"), F.lit("spans").alias("into"), values.alias("row")), root, {"spans": "session_id, start_time_unix_nano, attributes"})
    found = sqlite.copilot_traces(spark, [f"{root}/{k}/traces.db" for k in range(4)]).usage
    return found.groupBy("session", "model").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("input", "output", "cache_read")), F.min("ts").alias("first_ts"))


@query("p13_org_context", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_custkey % 2 = 0 END AS enrolled, CASE WHEN c_custkey % 4 < 2 THEN c_custkey END AS checked_at, CASE WHEN c_custkey % 4 < 2 AND c_custkey % 3 <> 0 THEN c_name END AS org_id, CASE WHEN c_custkey % 4 < 2 THEN CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 2 END END::INT AS grants FROM customer")
def org_context(spark, d):
    k = F.col("c_custkey")
    grant = lambda slug: F.struct(F.lit("g").alias("grantId"), F.lit("c").alias("canonicalRepoId"), slug.alias("slug"))
    grants = F.array(grant(F.lit("a/b")), grant(F.when(k % 5 != 0, "c/d")))  # one without its slug goes
    body = F.to_json(F.struct(F.when(k % 4 != 3, k % 2 == 0).alias("enrolled"), F.when(k % 4 != 2, k).alias("checkedAt"), F.when(k % 3 != 0, F.col("c_name")).alias("orgId"), F.struct(grants.alias("grants")).alias("attribution")))
    body = F.when(k % 4 == 2, F.lit('{"enrolled":true,"checkedAt":"7"}')).otherwise(body)
    got = table(spark, d, "customer").select("c_custkey", state.org_context(body).alias("x"))
    return got.select("c_custkey", "x.enrolled", "x.checked_at", "x.org_id", F.when(F.col("x").isNotNull(), F.size("x.grants")).alias("grants"))


@query("f17_version_order", "SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 0 WHEN (a, b, c) < (x, y, z) THEN -1 WHEN (a, b, c) > (x, y, z) THEN 1 ELSE 0 END::INT AS sign FROM (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 12 AS b, o_orderkey % 13 AS c, o_custkey % 3 AS x, o_custkey % 12 AS y, o_custkey % 13 AS z FROM orders)")
def version_order(spark, d):
    version = lambda n: F.concat(F.lit(" v"), n % 3, F.lit("."), n % 12, F.lit("."), n % 13, F.lit("-rc1"))
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", T.newer(F.when(k % 17 == 0, "none").otherwise(version(k)), version(F.col("o_custkey"))).cast("int").alias("sign"))


@query("p14_hermes_entry_points", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'cli' WHEN p_partkey % 4 = 1 THEN 'unknown' WHEN p_partkey % 4 = 2 THEN lower(replace(p_brand, '#', '-')) ELSE 'unknown' END AS entry FROM part")
def hermes_entry_points(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.lit("Terminal ")).when(k % 4 == 1, F.lit("  ")).when(k % 4 == 2, F.regexp_replace("p_brand", "#", "-")).otherwise(F.concat(F.col("p_brand"), F.lit(" app")))
    return table(spark, d, "part").select("p_partkey", T.hermes_entry_point(raw).alias("entry"))


@query("t1_grown_files", "SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 1000 AS size FROM orders WHERE o_orderkey % 5 IN (0, 1)")
def grown_files(spark, d):
    """Of every five files one is new, one has grown, three are as the cursor knows them."""
    k = F.col("o_orderkey")
    listing = table(spark, d, "orders").select(k.cast("string").alias("path"), (k % 1000).alias("size"), (k % 5).alias("kind"))
    cursors = I.StateTable(spark, folder(spark), "cursors", "path string, size long")
    cursors.upsert(listing.where("kind > 1").select("path", "size"))
    cursors.upsert(listing.where("kind = 1").select("path", (F.col("size") - 1).alias("size")))
    return I.grown_files(listing.select("path", "size"), cursors.read())


@query("t5_attribution_flip", sql("SELECT CAST(session AS VARCHAR) AS session, CASE WHEN session % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS sent FROM usage GROUP BY session", "usage"))
def attribution_flip(spark, d):
    """Four passes: all, those that grew, none (an unconfirmed flip), all (a confirmed one). How often each session went out."""
    root = folder(spark)
    make = lambda name, schema: I.StateTable(spark, root, name, schema)
    cursors, digests, stamps = make("cursors", "path string, size long"), make("digests", "session string, digest string"), make("stamps", "name string, stamp string")
    files = usage(spark, d).groupBy(F.col("session").cast("string").alias("path")).agg(F.count("*").alias("size"))
    grown = files.withColumn("size", F.col("size") + (F.col("path").cast("long") % 3 == 0).cast("long"))
    for k, (rows, stamp) in enumerate(((files, "a"), (grown, "a"), (grown, None), (grown, "b"))):
        fold = lambda g, stamp=stamp: g.select(F.col("path").alias("session"), F.col("size").cast("string").alias("payload"), F.concat_ws(":", "size", F.lit(stamp)).alias("digest"))
        I.sync_once(rows, cursors, digests, fold, lambda out, k=k: out.select("session").write.mode("overwrite").parquet(f"{root}/out/pass={k}"), stamps, stamp)
    return spark.read.schema("session string, pass int").parquet(f"{root}/out").groupBy("session").agg(F.count("*").alias("sent"))


_REPLAYED = "(SELECT session, message_id, output AS n, 2 * ord AS ord FROM usage UNION ALL SELECT session + 1, message_id, output + k % 2, 2 * ord - 1 + 2 * (k % 2) FROM usage WHERE k % 3 = 0)"


def fed(rows, number, path):
    """Write the rows of each batch to a folder of its number, in one pass over them."""
    rows.withColumn("batch", number).write.partitionBy("batch").parquet(path)


@query("t11_late_replay", sql(f"SELECT CAST(s.session AS VARCHAR) AS session, CAST(CAST(coalesce(sum(n), 0) AS BIGINT) AS VARCHAR) AS payload FROM (SELECT DISTINCT session FROM {_REPLAYED}) s LEFT JOIN (SELECT message_id, max(n) AS n, arg_min(session, ord) AS session FROM {_REPLAYED} GROUP BY message_id) o ON o.session = s.session GROUP BY s.session", "usage"))
def late_replay(spark, d):
    """Chains of sessions with replayed messages, in four batches in no order: records that come late change what other sessions own, and by whom."""
    root = folder(spark)
    own = usage(spark, d).select("session", "message_id", F.col("output").alias("n"), (2 * F.col("ord")).alias("ord"), "k")
    again = own.where("k % 3 = 0").select(F.col("session") + 1, "message_id", F.col("n") + F.col("k") % 2, F.col("ord") - 1 + 2 * (F.col("k") % 2), "k")
    rows = own.union(again).drop("k").select(F.col("session").cast("string").alias("session"), "message_id", "n", F.col("ord").cast("long").alias("ord"))
    fed(rows, F.pmod(F.xxhash64("session", "ord"), F.lit(4)), f"{root}/fed")
    atoms = I.StateTable(spark, f"{root}/state", "atoms", "session string, message_id string, n long, ord long", history=True)
    copies = I.StateTable(spark, f"{root}/state", "copies", "message_id string, session string, n long, ord long", history=True)
    digests = I.StateTable(spark, f"{root}/state", "digests", "session string, digest string")

    def fold(held):
        kept = held.groupBy("message_id").agg(F.max("n").alias("n"), F.min_by("session", "ord").alias("session"))
        payload = F.coalesce("n", F.lit(0)).cast("string").alias("payload")
        totals = held.select("session").distinct().join(kept.groupBy("session").agg(F.sum("n").alias("n")), "session", "left")
        return totals.select("session", payload).withColumn("digest", F.sha2("payload", 256))

    for k in range(4):  # a run of the stream for each batch, from the checkpoint of the one before
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/fed/batch={{{','.join(map(str, range(k + 1)))}}}")
        send = lambda out, n: out.select("session", "payload").write.mode("overwrite").parquet(f"{root}/out/batch={n}")
        I.sync_stream(stream, atoms, digests, fold, send, f"{root}/checkpoint", copies).awaitTermination()
    sent = spark.read.schema("session string, payload string, batch long").parquet(f"{root}/out")
    return sent.groupBy("session").agg(F.max_by("payload", "batch").alias("payload"))


@query("sk4_wire_rows", sql("SELECT CAST(session AS VARCHAR) AS session, sha256('{\"session\":\"' || session || '\",\"harness\":\"' || min(harness) || '\",\"input\":' || CAST(sum(input) AS BIGINT) || ',\"output\":' || CAST(sum(output) AS BIGINT) || '}') AS digest FROM usage GROUP BY session", "usage"))
def wire_rows(spark, d):
    """What leaves: the allowed fields alone (no folder), and their digest."""
    rows = usage(spark, d).groupBy(F.col("session").cast("string").alias("session")).agg(F.min("harness").alias("harness"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.min("project").alias("cwd"))
    return sinks.with_digest(sinks.wire(rows)).select("session", "digest")

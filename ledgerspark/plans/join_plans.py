"""Queries of the join, limit, drift and sink operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pricing import COUNTS, total_tokens
from ..operators import joins as J
from ..operators import views as V
from .bindings import sessions, sql, table, usage

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


@query(
    "j1_session_metadata",
    sql("SELECT u.ord, u.session, m.mktsegment FROM usage u LEFT JOIN (SELECT c_custkey, c_mktsegment AS mktsegment FROM customer WHERE c_custkey % 3 = 0) m ON m.c_custkey = u.session", "usage"),
)
def session_metadata(spark, d):
    meta = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("mktsegment"))
    return usage(spark, d).select("ord", "session").join(meta, "session", "left").select("ord", "session", "mktsegment")


@query(
    "j2_model_in_force",
    sql(
        """SELECT e.ord, e.session, coalesce(t.model, CASE WHEN e.session % 2 = 0 THEN 'fallback' END, 'unknown') AS model_in_force
           FROM (SELECT ord, session, ts + 1999 AS at FROM usage WHERE event_type <> 'signup') e
           ASOF LEFT JOIN (SELECT session, ts, model FROM usage WHERE event_type = 'signup' AND k % 5 <> 0) t ON e.session = t.session AND e.at >= t.ts""",
        "usage",
    ),
)
def model_in_force(spark, d):
    rows = usage(spark, d)
    turns = rows.where("event_type = 'signup'").select("session", "ts", F.when(F.col("k") % 5 != 0, F.col("model")).alias("model"))
    events = rows.where("event_type <> 'signup'").select("ord", "session", "ts", F.when(F.col("session") % 2 == 0, "fallback").alias("own"))
    return J.model_in_force(events, turns, fallback=F.col("own")).select("ord", "session", "model_in_force")


@query("w4_last_model", sql("SELECT session, ord, last_value(CASE WHEN k % 4 = 0 THEN model END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ord) AS model_in_force FROM usage", "usage"))
def last_model(spark, d):
    from ..operators.ordered import carried

    rows = carried(usage(spark, d), "session", "ord", F.when(F.col("k") % 4 == 0, F.col("model")), "model_in_force", width=1000)
    return rows.select("session", "ord", "model_in_force")


_AT = "1704067200000 + (o_orderkey * 7919 % 2592000) * 1000"


@query(
    "j5_commits_in_session",
    sql(
        f"""SELECT s.session, coalesce(len(shas), 0)::BIGINT AS n, coalesce(array_to_string(shas, ','), '') AS shas FROM sessions s LEFT JOIN (
             SELECT session, list_sort(list(DISTINCT 'c' || o_orderkey)) AS shas FROM sessions JOIN orders ON cwd = 'p' || (o_custkey % 10) AND {_AT} BETWEEN started_at AND started_at + 86400000 GROUP BY session) c ON c.session = s.session""",
        "sessions",
    ),
)
def commits_in_session(spark, d):
    commits = table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 10).alias("cwd"), F.concat(F.lit("c"), "o_orderkey").alias("sha"), (F.lit(1704067200000) + (F.col("o_orderkey") * 7919 % 2592000) * 1000).alias("at"))
    own = sessions(spark, d).withColumn("ended_at", F.col("started_at") + 86_400_000)
    return J.commits_in_session(own, commits, between=",")


_GRANTS = "SELECT 'p' || (c_custkey % 10) AS slug, 'g' || c_custkey AS grant_id, CASE WHEN c_custkey % 10 < 6 THEN 'canon' || (c_custkey % 10) ELSE 'canon' || c_custkey END AS canonical_id FROM customer"


@query("j8_grants", sql(f"SELECT s.session, g.canonical_id, g.n AS grants FROM sessions s LEFT JOIN (SELECT slug, min(canonical_id) AS canonical_id, count(DISTINCT grant_id) AS n FROM ({_GRANTS}) GROUP BY slug HAVING count(DISTINCT canonical_id) = 1) g ON g.slug = s.cwd", "sessions"))
def grants(spark, d):
    key = F.col("c_custkey")
    own = table(spark, d, "customer").select(F.concat(F.lit("p"), key % 10).alias("slug"), F.concat(F.lit("g"), key).alias("grant_id"), F.concat(F.lit("canon"), F.when(key % 10 < 6, key % 10).otherwise(key)).alias("canonical_id"))
    found = J.attribute_grants(sessions(spark, d).withColumnRenamed("cwd", "slug"), own)
    return found.select("session", "canonical_id", F.when(F.col("canonical_id").isNotNull(), F.size("grant_ids").cast("long")).alias("grants"))


@query("j9_session_messages", sql("SELECT s.session, coalesce(m.messages, 0) AS messages, m.last_ts FROM (SELECT DISTINCT c_custkey AS session FROM customer) s LEFT JOIN (SELECT session, count(*) AS messages, max(ts) AS last_ts FROM usage GROUP BY session) m USING (session)", "usage"))
def session_messages(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("session")).distinct()
    found = usage(spark, d).groupBy("session").agg(F.count("*").alias("messages"), F.max("ts").alias("last_ts"))
    return own.join(found, "session", "left").select("session", F.coalesce("messages", F.lit(0)).alias("messages"), "last_ts")


@query("j11_overlay", sql("SELECT session, tokens, 'file' AS src FROM sessions WHERE session % 3 = 0 UNION ALL SELECT session, tokens * 2, 'db' FROM sessions WHERE session % 2 = 0 AND session % 3 <> 0", "sessions"))
def overlay(spark, d):
    own = sessions(spark, d).select("session", "tokens")
    files = own.where("session % 3 = 0").withColumn("src", F.lit("file"))
    stored = own.where("session % 2 = 0").select("session", (F.col("tokens") * 2).alias("tokens"), F.lit("db").alias("src"))
    return J.overlay(stored, files, "session")


@query("j13_calendar", sql("SELECT c.day, coalesce(t.tokens, 0)::BIGINT AS tokens FROM (SELECT unnest(generate_series(DATE '2024-02-05' - 29, DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day) c LEFT JOIN (SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS day, sum(input + output + cache_read + cache_creation) AS tokens FROM usage GROUP BY 1) t ON t.day = c.day", "usage"))
def calendar(spark, d):
    days = usage(spark, d).groupBy(V.local_day(F.col("ts")).alias("day")).agg(F.sum(total_tokens()).alias("tokens"))
    return J.on_calendar(days, F.lit("2024-02-05").cast("date"), 30, ["tokens"])


_LIVE = """
SELECT session, harness, tokens - base AS tokens, ctx_pct, CASE WHEN tokens > base THEN 0 ELSE 1 END AS seeded FROM (
  SELECT s.session, harness, tokens, CASE WHEN s.session % 4 = 0 THEN 0 WHEN s.session % 4 = 1 THEN tokens ELSE tokens // 2 END AS base, CASE WHEN s.session % 7 <> 0 THEN (s.session % 100)::DOUBLE END AS ctx_pct, ended_at FROM sessions s)
WHERE tokens > base OR (ctx_pct IS NOT NULL AND harness IN ('codex', 'grok', 'pi') AND 1706600000000 - ended_at <= 86400000)"""


@query("j14_live_deltas", sql(_LIVE, "sessions"))
def live_deltas(spark, d):
    own = sessions(spark, d).select("session", "harness", "tokens", F.when(F.col("session") % 7 != 0, (F.col("session") % 100).cast("double")).alias("ctx_pct"), F.col("ended_at").alias("last_at"))
    baseline = own.where("session % 4 <> 0").select("session", F.when(F.col("session") % 4 == 1, F.col("tokens")).otherwise(F.floor(F.col("tokens") / 2)).alias("tokens"))
    active = spark.createDataFrame([("codex",), ("grok",), ("pi",)], "harness string")
    return J.live_deltas(own, baseline, active, 1706600000000, 86_400_000)


@query("j17_active_harnesses", sql("SELECT session, harness FROM sessions WHERE harness IN (SELECT harness FROM usage WHERE ts > 1706500000000)", "sessions"))
def active_harnesses(spark, d):
    live = usage(spark, d).where("ts > 1706500000000").select("harness").distinct()
    return sessions(spark, d).select("session", "harness").join(live, "harness", "left_semi").select("session", "harness")


_DIGEST = "sha256(session || '|' || harness || '|' || tokens)"


@query("j15_changed_sessions", sql(f"SELECT session, {_DIGEST} AS digest FROM sessions WHERE session % 5 <> 0", "sessions"))
def changed_sessions(spark, d):
    own = sessions(spark, d).select("session", F.sha2(F.concat_ws("|", "session", "harness", "tokens"), 256).alias("digest"))
    stored = own.where("session % 3 <> 0").select("session", F.when(F.col("session") % 5 == 0, F.col("digest")).otherwise(F.lit("old")).alias("digest"))
    rest = own.where("session % 3 = 0 and session % 5 = 0").select("session", "digest")
    return J.changed(own, stored.unionByName(rest))


@query("u1_union_of_harnesses", sql("SELECT harness, count(*) AS rows, CAST(sum(input) AS BIGINT) AS input FROM usage GROUP BY harness", "usage"))
def union_of_harnesses(spark, d):
    from ..sources.registry import union_tagged

    rows = usage(spark, d)
    names = ["claude_code", "codex", "grok", "pi", "openclaw", "opencode", "hermes", "copilot", "gemini"]
    parts = {n: rows.where(F.col("harness") == n).drop("harness") for n in names}
    return union_tagged(parts).groupBy("harness").agg(F.count("*").alias("rows"), F.sum("input").alias("input"))


@query("a16_scan_health", sql("SELECT harness, count(*) FILTER (k < 6) AS unknown, count(*) AS total, count(*) FILTER (k < 6) > 20 AND count(*) FILTER (k < 6) > count(*) * 0.05 AS drift FROM usage GROUP BY harness", "usage"))
def scan_health(spark, d):
    return V.health(usage(spark, d), "harness", F.col("k") < 6)


@query("p16_drift_within_week", sql("SELECT harness, max(ts) AS at FROM usage WHERE k = 0 GROUP BY harness HAVING 1706659200000 - max(ts) < 7 * 86400000", "usage"))
def drift_within_week(spark, d):
    return usage(spark, d).where("k = 0").groupBy("harness").agg(F.max("ts").alias("at")).where(F.lit(1706659200000) - F.col("at") < 7 * 86_400_000)


@query("p6_sessions_with_usage", sql("SELECT session, CAST(sum(input + output) AS BIGINT) AS total FROM (SELECT session % 60 AS session, CASE WHEN session % 60 < 5 THEN 0 ELSE input END AS input, CASE WHEN session % 60 < 5 THEN 0 ELSE output END AS output FROM usage) GROUP BY session HAVING sum(input + output) > 0", "usage"))
def sessions_with_usage(spark, d):
    own = (F.col("session") % 60).alias("session")
    rows = usage(spark, d).select(own, F.when(F.col("session") % 60 < 5, 0).otherwise(F.col("input") + F.col("output")).alias("n"))
    return rows.groupBy("session").agg(F.sum("n").alias("total")).where("total > 0")


@query("p1_valid_rows", sql(r"SELECT ord FROM (SELECT ord, CASE WHEN k < 10 THEN NULL WHEN k < 20 THEN '1.2' WHEN k < 30 THEN 'x1.2.3' ELSE '1.2.' || k END AS version, CASE WHEN ord % 11 = 0 THEN '' WHEN ord % 11 = 1 THEN NULL ELSE request_id END AS request_id FROM usage) WHERE (version IS NULL OR regexp_matches(version, '^\d+\.\d+\.\d')) AND (request_id IS NULL OR request_id <> '')", "usage"))
def valid_rows(spark, d):
    from ..operators.dedup import valid

    k, o = F.col("k"), F.col("ord")
    rows = usage(spark, d).withColumns({"version": F.when(k < 10, None).when(k < 20, "1.2").when(k < 30, "x1.2.3").otherwise(F.concat(F.lit("1.2."), k)), "request_id": F.when(o % 11 == 0, "").when(o % 11 != 1, F.col("request_id")), "session_id": F.lit("s")})
    return rows.where(valid()).select("ord")


@query(
    "f14_limit_lanes",
    """SELECT 'h' || n_nationkey AS harness, 'h' || n_nationkey || ' ' || CASE WHEN n_nationkey % 3 = 0 THEN '5h' WHEN n_nationkey % 3 = 1 THEN 'weekly' ELSE '24h' END AS label, least(100.0, greatest(0.0, n_regionkey * 40.0 - 10))::DOUBLE AS percent, false AS estimate, CASE WHEN n_nationkey % 3 = 1 THEN 'WEEKLY' ELSE 'SESSION' END AS lane_group, NULL::BIGINT AS used FROM nation WHERE n_nationkey % 2 = 0
       UNION ALL SELECT 'h' || n_nationkey, 'h' || n_nationkey || ' 5h window', NULL, true, 'SESSION', n_nationkey::BIGINT FROM nation WHERE n_nationkey % 2 = 1""",
)
def limit_lanes(spark, d):
    nation = table(spark, d, "nation").select(F.concat(F.lit("h"), "n_nationkey").alias("harness"), F.col("n_nationkey").cast("long").alias("used"), (F.col("n_regionkey") * 40.0 - 10).alias("percent"))
    minutes = F.when(F.col("used") % 3 == 0, 300).when(F.col("used") % 3 == 1, 10_080).otherwise(1_440)
    windows = nation.where("used % 2 = 0").select("harness", minutes.alias("minutes"), F.lit(None).cast("string").alias("scope"), "percent")
    return V.limit_lanes(windows, nation.select("harness", "used"))


@query("f26_cross_org_disclosure", "SELECT slug, count(DISTINCT org) AS other_orgs FROM (SELECT 'r' || (o_custkey % 50) AS slug, o_orderpriority AS org FROM orders) WHERE org <> '1-URGENT' GROUP BY slug")
def cross_org_disclosure(spark, d):
    held = table(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 50).alias("slug"), F.col("o_orderpriority").alias("org"))
    return held.where("org <> '1-URGENT'").groupBy("slug").agg(F.size(F.collect_set("org")).cast("long").alias("other_orgs"))


@query("f18_live_signature", sql("SELECT session, string_agg(model || ':' || input || ':' || output || ':' || cache_read || ':' || cache_creation, '|' ORDER BY model || ':' || input || ':' || output || ':' || cache_read || ':' || cache_creation) AS signature FROM (SELECT session, model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_creation) AS BIGINT) AS cache_creation FROM usage GROUP BY session, model) GROUP BY session", "usage"))
def live_signature(spark, d):
    from ..functions.text import live_signature

    models = usage(spark, d).groupBy("session", "model").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return models.groupBy("session").agg(F.collect_list(F.struct("model", *COUNTS)).alias("models")).select("session", live_signature(F.col("models")).alias("signature"))


_MODEL = """'{"model":"' || model || '","input":' || input || ',"output":' || output || ',"cache_read":' || cache_read || ',"cache_creation":' || cache_creation || '}'"""
_SUM4 = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)


@query(
    "sk2_wire_digest",
    sql(
        f"""SELECT session, payload, sha256(payload) AS digest FROM (
             SELECT s.session, '{{"session":' || s.session || ',"harness":"' || s.harness || '","models":[' || m.models || '],"input":' || m.input || ',"output":' || m.output || ',"cache_read":' || m.cache_read
               || ',"cache_creation":' || m.cache_creation || ',"started_at":' || s.started_at || ',"ended_at":' || s.ended_at || ',"repo_hash":null}}' AS payload
             FROM sessions s JOIN (SELECT session, string_agg({_MODEL}, ',' ORDER BY model) AS models, {_SUM4} FROM (SELECT session, model, {_SUM4} FROM usage GROUP BY session, model) GROUP BY session) m USING (session))""",
        "sessions",
    ),
)
def wire_digest(spark, d):
    from ..sources.sinks import wire, with_digest

    rows = usage(spark, d)
    models = rows.groupBy("session", "model").agg(*(F.sum(c).alias(c) for c in COUNTS))
    nested = models.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("model", *COUNTS))).alias("models"), *(F.sum(c).alias(c) for c in COUNTS))
    own = sessions(spark, d).drop("models").join(nested, "session").withColumn("repo_hash", F.lit(None).cast("string"))
    return with_digest(wire(own)).select("session", "payload", "digest")


@query("sk4_json_rows", sql("SELECT '{\"model\":\"' || model || '\",\"total\":' || total || '}' AS value FROM (SELECT model, CAST(sum(input + output + cache_read + cache_creation) AS BIGINT) AS total FROM usage GROUP BY model)", "usage"))
def json_rows(spark, d):
    found = usage(spark, d).groupBy("model").agg(F.sum(total_tokens()).alias("total"))
    return found.select(F.to_json(F.struct("model", "total")).alias("value"))


@query("a22_provider_files", "SELECT provider, count(*) AS files FROM (SELECT CASE o_orderkey % 9 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'opencode' WHEN 3 THEN 'grok' WHEN 4 THEN 'pi' WHEN 5 THEN 'openclaw' WHEN 6 THEN 'hermes' WHEN 7 THEN 'copilot' END AS provider FROM orders) GROUP BY provider")
def provider_files(spark, d):
    from ..functions.text import provider_of_path

    shapes = ["/h/.codex/sessions/2026/01/rollout-{}.jsonl", "/h/.claude/projects/p/{}.JSONL", "/h/{}/opencode-dev.db", "C:\\{}\\logs\\unified.jsonl", "/h/.pi/agent/sessions/{}/x.jsonl", "/h/agents/{}/sessions/s.jsonl", "/h/{}/state.db", "/h/{}/session-store.db", "/h/agents/{}/notes.txt"]
    key = F.col("o_orderkey").cast("string")
    options = [F.concat(F.lit(s.split("{}")[0]), key, F.lit(s.split("{}")[1])) for s in shapes]
    path = F.element_at(F.array(*options), (F.col("o_orderkey") % len(shapes) + 1).cast("int"))
    return table(spark, d, "orders").groupBy(provider_of_path(path).alias("provider")).agg(F.count("*").alias("files"))


@query("a27_limits_panel", "SELECT 'all' AS harness, 'monthly budget' AS label, 40.0::DOUBLE AS percent, 'BUDGET' AS lane_group UNION ALL SELECT 'h' || n_nationkey, 'h' || n_nationkey || ' 5h window', NULL, 'SESSION' FROM nation")
def limits_panel(spark, d):
    nation = table(spark, d, "nation").select(F.concat(F.lit("h"), "n_nationkey").alias("harness"), F.col("n_nationkey").cast("long").alias("used"))
    none = spark.createDataFrame([], "harness string, minutes int, scope string, percent double")
    return V.limits_panel(V.limit_lanes(none, nation), "mix", 20.0, 50.0).select("harness", "label", "percent", "lane_group")

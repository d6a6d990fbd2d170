"""Queries of the scalar functions, over the driver's text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .bindings import sql, table, usage

QUERIES: dict = {}
ORACLE: dict = {}
KEY = b"workspace-key"


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


_RAW = "CASE c_custkey % 6 WHEN 0 THEN ' /Plan:Plan ' WHEN 1 THEN '/model' WHEN 2 THEN 'a:b' WHEN 3 THEN 'bad id!' WHEN 4 THEN 'X/' || c_custkey ELSE c_name END"


def _raw():
    k = F.col("c_custkey")
    return F.when(k % 6 == 0, " /Plan:Plan ").when(k % 6 == 1, "/model").when(k % 6 == 2, "a:b").when(k % 6 == 3, "bad id!").when(k % 6 == 4, F.concat(F.lit("X/"), k)).otherwise(F.col("c_name"))


@query("f3_skill_id", f"SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'plan' WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE CASE WHEN regexp_matches(lower({_RAW}), '^[a-z0-9:_./-]{{1,64}}$') THEN lower({_RAW}) END END AS id FROM customer")
def skill_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.skill_id(_raw()).alias("id"))


@query("f4_agent_id", f"SELECT c_custkey, CASE WHEN regexp_matches(lower(trim({_RAW})), '^[a-z0-9:_./-]{{1,64}}$') THEN lower(trim({_RAW})) END AS id FROM customer")
def agent_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.agent_id(_raw()).alias("id"))


@query("f5_command_tags", "SELECT page_id, CAST(len(tags) AS BIGINT) AS n, array_to_string(tags, '|') AS tags FROM (SELECT page_id, regexp_extract_all(html, '<title>([^<>]{1,80})</title>', 1) AS tags FROM pages)")
def command_tags(spark, d):
    found = table(spark, d, "pages").select("page_id", T.command_tags(F.col("html"), "title").alias("tags"))
    return found.select("page_id", F.size("tags").cast("long").alias("n"), F.array_join("tags", "|").alias("tags"))


@query("p9_repo_slug", r"SELECT page_id, CASE WHEN len(parts) >= 2 AND regexp_matches(slug, '^[a-z0-9._-]+/[a-z0-9._-]+$') THEN slug END AS slug FROM (SELECT page_id, parts, lower(parts[-2] || '/' || regexp_replace(parts[-1], '(?i)\.git$', '')) AS slug FROM (SELECT page_id, list_filter(string_split(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/'), lambda x: x <> '') AS parts FROM pages))")
def repo_slug(spark, d):
    return table(spark, d, "pages").select("page_id", T.repo_slug(F.col("url")).alias("slug"))


@query("p10_org_gate", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'org/r' || c_custkey END AS slug FROM customer")
def org_gate(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", T.org_repo(k % 2 == 0, F.when(k % 3 == 0, "noslash").otherwise(F.concat(F.lit(" ORG/r"), k))).alias("slug"))


@query("p11_base_name", r"SELECT page_id, CASE WHEN name <> '' AND NOT regexp_matches(name, '^[A-Za-z]:$') THEN name END AS name FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[/\\]+$', ''), '([^/\\]+)$', 1) AS name FROM pages)")
def base_name(spark, d):
    return table(spark, d, "pages").select("page_id", T.base_name(F.col("url")).alias("name"))


@query("p14_entry_point", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'subagent' WHEN c_custkey % 6 = 0 THEN 'vscode' WHEN c_custkey % 6 = 1 THEN 'cli' WHEN c_custkey % 6 = 2 THEN 'desktop' WHEN c_custkey % 6 = 3 THEN 'unknown' WHEN c_custkey % 6 = 4 THEN 'opencode x' ELSE CASE WHEN regexp_matches(lower(c_mktsegment), '^[a-z0-9._:-]{1,64}$') THEN lower(c_mktsegment) ELSE 'unknown' END END AS entry_point FROM customer")
def entry_point(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 6 == 0, "VS-Code").when(k % 6 == 1, " terminal").when(k % 6 == 2, "claude-desktop").when(k % 6 == 3, "two words").when(k % 6 == 4, "OpenCode x").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", T.entry_point(raw, k % 10 == 0).alias("entry_point"))


_PADS = [bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query("f11_repo_hash", f"SELECT c_custkey, left(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(lower(c_name))))), 32) AS repo_hash FROM customer")
def repo_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.repo_hash(KEY, F.concat(F.lit("/home/u/"), "c_name")).alias("repo_hash"))


# One decimal of the exact value: printf rounds it, and halves that doubles hold exactly go up.
_TENTH = "CASE WHEN {x} * 4 = floor({x} * 4) AND CAST({x} * 4 AS BIGINT) % 2 = 1 THEN printf('%.1f', floor({x} * 10) / 10 + 0.1) ELSE printf('%.1f', {x}) END"
_COMPACT = "CASE WHEN n < 0 THEN '-' ELSE '' END || CASE WHEN a >= 1e9 THEN " + _TENTH.format(x="(a / 1e9)") + " || 'B' WHEN a >= 1e6 THEN " + _TENTH.format(x="(a / 1e6)") + " || 'M' WHEN a >= 1e3 THEN " + _TENTH.format(x="(a / 1e3)") + " || 'K' ELSE CAST(CAST(a AS BIGINT) AS VARCHAR) END"


@query("f12_compact_numbers", rf"""
SELECT o_orderkey, {_COMPACT} AS short, (o_orderkey // 60) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS clock,
       CASE WHEN m < 60 THEN m || 'm' WHEN m < 2880 THEN (m // 60) || 'h' || CASE WHEN m % 60 <> 0 THEN ' ' || (m % 60) || 'm' ELSE '' END ELSE CAST(floor(m / 1440.0 + 0.5) AS BIGINT) || 'd' END AS span,
       CASE WHEN o_orderkey >= 1000 THEN '$' || regexp_replace({_TENTH.format(x="(o_orderkey / 1000.0::DOUBLE)")}, '\.0$', '') || 'k' ELSE '$' || o_orderkey END AS tick
FROM (SELECT *, abs(n) AS a FROM (SELECT o_orderkey, CAST(o_orderkey % 5000 AS BIGINT) AS m,
      CAST((CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 1 END) * CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 50 WHEN 1 THEN o_orderkey * 50000 ELSE o_orderkey * 50000000 END AS DOUBLE) AS n FROM orders))""")
def compact_numbers(spark, d):
    k = F.col("o_orderkey")
    n = F.when(k % 7 == 0, -1).otherwise(1) * F.when(k % 3 == 0, k * 50).when(k % 3 == 1, k * 50_000).otherwise(k * 50_000_000)  # halves of a tenth among them
    return table(spark, d, "orders").select("o_orderkey", T.compact(n).alias("short"), T.clock(k * 60_000).alias("clock"), T.short_span(k % 5000).alias("span"), T.money_tick(k).alias("tick"))


@query("f13_percent_clamp", "SELECT c_custkey, least(100.0, greatest(0.0, c_acctbal / 50)) AS percent FROM customer")
def percent_clamp(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.percent(F.col("c_acctbal") / 50).alias("percent"))


@query("f17_semver", r"SELECT o_orderkey, a * 1000000 + b * 1000 + c AS rank FROM (SELECT o_orderkey, o_orderkey % 7 AS a, o_orderkey % 11 AS b, o_orderkey % 13 AS c FROM orders)")
def semver(spark, d):
    k = F.col("o_orderkey")
    v = T.semver(F.concat(F.lit("v"), k % 7, F.lit("."), k % 11, F.lit("."), k % 13, F.lit("-rc1")))
    return table(spark, d, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", (F.col("v")[0].cast("long") * 1_000_000 + F.col("v")[1] * 1000 + F.col("v")[2]).alias("rank"))


@query("f20_model_of_json", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type || '/' || p_brand END AS model FROM part")
def model_of_json(spark, d):
    k = F.col("p_partkey")
    raw = F.to_json(F.struct(F.when(k % 5 != 0, F.col("p_brand")).alias("id"), F.when(k % 3 != 0, F.col("p_type")).alias("providerID")))
    return table(spark, d, "part").select("p_partkey", T.model_of_json(raw).alias("model"))


@query("f24_weighted_tokens", sql("SELECT session, round(sum(input + output + cache_creation + cache_read * 0.02::DOUBLE), 4) AS weighted FROM usage GROUP BY session", "usage"))
def weighted_tokens(spark, d):
    return usage(spark, d).groupBy("session").agg(F.round(F.sum(T.weighted()), 4).alias("weighted"))


@query("f31_short_model", sql("SELECT DISTINCT model, CASE WHEN length(short) > 14 THEN short[1:13] || '…' ELSE short END AS short FROM (SELECT model, regexp_replace(model, '^claude-', '') AS short FROM usage)", "usage"))
def short_model(spark, d):
    return usage(spark, d).select("model").distinct().select("model", T.short_model(F.col("model")).alias("short"))


@query("p12_user_rate_errors", "SELECT p_partkey, (CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size > 40 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS errors FROM part")
def user_rate_errors(spark, d):
    k = F.col("p_partkey")
    errors = T.rate_errors(F.when(k % 7 == 0, "bad id").otherwise("id"), F.when(F.col("p_size") > 40, 0.0).otherwise(F.col("p_retailprice")), F.when(k % 4 == 0, 10_001.0).otherwise(1.0), F.lit(None).cast("double"), F.lit(0.0))
    return table(spark, d, "part").select("p_partkey", F.size(errors).cast("long").alias("errors"))


@query("p3_human_turns", "SELECT conv_id, count(*) FILTER (role = 'user') AS turns, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def human_turns(spark, d):
    rows = table(spark, d, "conversations")
    return rows.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.count("*").alias("messages"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("f23_budget_gauge", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN least(1.0, greatest(0.0, c_acctbal / ((c_custkey % 4) * 1000))) END AS share FROM customer")
def budget_gauge(spark, d):
    budget = (F.col("c_custkey") % 4) * 1000
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide("c_acctbal", budget)))
    return table(spark, d, "customer").select("c_custkey", F.when(budget > 0, share).alias("share"))


@query("f22_org_slug", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'acme' || c_custkey WHEN 1 THEN 'o' || c_custkey END AS slug FROM customer")
def org_slug(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" Acme"), k)).when(k % 4 == 1, F.concat(F.lit("https://h/x/ORG/O"), k, F.lit("/?q"))).when(k % 4 == 2, "two words").otherwise("a/b")
    return table(spark, d, "customer").select("c_custkey", T.org_slug(raw).alias("slug"))


@query("f25_counts_only", sql("SELECT session, model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cache_creation) AS BIGINT) AS cache_creation FROM usage GROUP BY session, model", "usage"))
def counts_only(spark, d):
    counts = ("input", "output", "cache_read", "cache_creation")
    models = usage(spark, d).groupBy("session", "model").agg(*(F.sum(c).alias(c) for c in counts))
    nested = models.groupBy("session").agg(T.counts_only(F.collect_list(F.struct("model", *counts))).alias("m"))
    return nested.select("session", F.explode("m").alias("model", "c")).select("session", "model", "c.input", "c.cache_creation")

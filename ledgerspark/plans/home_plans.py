"""Queries over all harnesses at once: the events written as the logs and stores of nine harnesses, and read back from their homes."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..operators import views
from ..operators.ordered import running
from ..shared import cut
from ..sources import corpus
from . import bindings
from .bindings import sql
from .pricing_plans import _COST, _GROUPED, _PARTIAL, _SUMS
from .source_plans import iso
from .stream_plans import folder

QUERIES: dict = {}
ORACLE: dict = {}
_STORES = 4  # databases of a harness that has only one in a home


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


def written(rows: DataFrame, root: str) -> None:
    """Write ``path, ord, line`` rows as text files under a shared folder: each file's lines in order, streamed, none held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = out = draft = full = None
        for b in batches:
            for p, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != path:
                    if out:
                        out.close()
                        os.replace(draft, full)
                    full = os.path.join(root, p)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    draft = f"{full}.{uuid.uuid4().hex}"  # another try of this task has one of its own
                    path, out = p, open(draft, "w", encoding="utf-8")
                out.write(line + "\n")
        if out:
            out.close()
            os.replace(draft, full)
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["done"])

    rows.repartition("path").sortWithinPartitions("path", "ord").select("path", "line").mapInArrow(run, "done long").collect()  # a row a partition


def stored(rows: DataFrame, root: str, tables: dict[str, str]) -> None:
    """Write rows (``path`` of a database, ``into`` a table, then its values as ``row``) as SQLite databases, one group a database."""

    def run(name: tuple, group: pd.DataFrame) -> pd.DataFrame:
        full = os.path.join(root, name[0])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        draft = f"{full}.{uuid.uuid4().hex}"  # another try of this task has one of its own
        db = sqlite3.connect(draft)
        for table, columns in tables.items():
            db.execute(f"CREATE TABLE {table} ({columns})")
        for table, part in group.groupby("into"):
            marks = ",".join("?" * len(tables[table].split(",")))
            db.executemany(f"INSERT INTO {table} VALUES ({marks})", ([x if kind == "t" else (None if x is None else int(x)) for kind, x in zip(row[0], row[1:])] for row in part["row"]))
        db.commit()
        db.close()
        os.replace(draft, full)
        return pd.DataFrame({"done": [len(group)]})

    rows.groupBy("path").applyInPandas(run, "done long").collect()  # a row a database


def _row(kinds: str, *values: Column) -> Column:
    """Values of a database row after their kinds (t text, i integer), as texts."""
    return F.array(F.lit(kinds), *(v.cast("string") for v in values))


def homes_of(spark, d: str, *only: str) -> dict[str, str | list[str]]:
    """The events as nine harnesses' files (or ``only`` some): a user's events are a session of one of them. Written anew each time."""
    root = folder(spark).removeprefix("file:")
    wanted = only or tuple(bindings.HARNESSES)
    rows = bindings.usage(spark, d).withColumn("s", F.col("session").cast("string")).withColumn("cwd", F.concat(F.lit("/w/"), F.col("project")))
    of = lambda h: rows.where(F.col("harness") == h)
    js = lambda *c: F.to_json(F.struct(*c))
    stamp = iso(F.col("ts")).alias("timestamp")
    path = lambda before, after: F.concat(F.lit(before), F.col("s"), F.lit(after))

    def keep(harness: str, values: DataFrame, tables: dict[str, str]) -> None:
        if harness in wanted:
            stored(values, f"{root}/{harness}", tables)

    def put(harness: str, lines: DataFrame) -> None:
        if harness not in wanted:
            return
        written(lines.select("path", "ord", "line"), f"{root}/{harness}")

    def with_head(body: DataFrame, head: Column, own: DataFrame) -> DataFrame:
        heads = own.groupBy("s", "cwd", "session").agg(F.min("ts").alias("ts")).withColumn("line", head).withColumn("ord", F.lit(-1).cast("long"))
        return body.select("s", "ord", "line").unionByName(heads.select("s", "ord", "line"))

    own = of("claude_code")
    counts = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_creation").alias("cache_creation_input_tokens"))
    line = js(F.lit("assistant").alias("type"), stamp, F.lit("1.2.3").alias("version"), "cwd", F.col("s").alias("sessionId"), F.col("ord").cast("string").alias("requestId"), F.struct(F.col("ord").cast("string").alias("id"), "model", counts.alias("usage")).alias("message"))
    lines = own.select("s", "session", "ord", line.alias("line"))
    replays = lines.where("session % 2 = 0").select((F.col("session") + 1_000_000).cast("string").alias("s"), "session", "ord", "line")  # resumed sessions replay what they go on from
    put("claude_code", lines.unionByName(replays).withColumn("path", path("p/", ".jsonl")))

    sums = running(of("codex"), "session", "ord", {"ci": F.col("input") + F.col("cache_read"), "cc": F.col("cache_read"), "co": F.col("output")}, width=1000)
    total = F.struct((F.col("ci") + F.col("co")).alias("total_tokens"), F.col("ci").alias("input_tokens"), F.col("cc").alias("cached_input_tokens"), F.col("co").alias("output_tokens"))
    turn = js(F.lit("turn_context").alias("type"), stamp, F.struct("model").alias("payload"))
    tick = js(F.lit("event_msg").alias("type"), stamp, F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage"), F.struct((F.col("input") + F.col("cache_read")).alias("input_tokens")).alias("last_token_usage"), F.lit(272_000).alias("model_context_window")).alias("info")).alias("payload"))
    head = js(F.lit("session_meta").alias("type"), F.struct(F.col("s").alias("id"), "cwd").alias("payload"))
    put("codex", with_head(sums.select("s", "ord", F.concat(turn, F.lit("\n"), tick).alias("line")), head, of("codex")).withColumn("path", path("2026/rollout-", ".jsonl")))

    own = of("grok")
    one = own.groupBy("s", "cwd").agg(F.min("ord").alias("ord"))
    ctx = F.struct((F.col("input") + F.col("cache_read")).alias("prompt_tokens"), F.col("cache_read").alias("cached_prompt_tokens"), F.col("output").alias("completion_tokens"))
    put("grok", own.select(F.concat(F.lit("logs/"), F.col("session") % 8, F.lit("/unified.jsonl")).alias("path"), "ord", js(iso(F.col("ts")).alias("ts"), F.col("s").alias("sid"), F.lit("shell.turn.inference_done").alias("msg"), ctx.alias("ctx")).alias("line")))
    put("grok", one.select(path("sessions/c/", "/events.jsonl").alias("path"), "ord", js(iso(F.lit(0).cast("long")).alias("ts"), F.lit("turn_started").alias("type"), F.lit("grok-4.5").alias("model_id")).alias("line")))
    put("grok", one.select(path("sessions/c/", "/summary.json").alias("path"), "ord", js(F.struct(F.col("s").alias("id"), "cwd").alias("info")).alias("line")))
    mark = spark.createDataFrame([("config.toml", 0, 'source = "xai-org/plugin-marketplace"')], "path string, ord long, line string")
    put("grok", mark)

    message = lambda usage: js(F.lit("message").alias("type"), stamp, F.struct(F.lit("assistant").alias("role"), "model", usage.alias("usage")).alias("message"))
    net = F.struct("input", "output", F.col("cache_read").alias("cacheRead"), F.col("cache_creation").alias("cacheWrite"))
    head = js(F.lit("session").alias("type"), F.col("s").alias("id"), F.lit(3).alias("version"), iso(F.col("ts")).alias("timestamp"), "cwd")
    for harness, before in (("pi", "--w--/"), ("openclaw", "agents/a/sessions/")):
        put(harness, with_head(of(harness).withColumn("line", message(net)), head, of(harness)).withColumn("path", path(before, ".jsonl")))

    own = of("gemini")
    tokens = F.struct((F.col("input") + F.col("cache_read")).alias("input"), "output", F.col("cache_read").alias("cached"))
    item = js(F.lit("gemini").alias("type"), stamp, "model", tokens.alias("tokens"))
    first = F.col("ord") == F.min("ord").over(W.partitionBy("session"))
    inner = own.select("s", "session", "ord", F.concat(F.when(~first, ",").otherwise(""), item).alias("line"))
    ends = own.groupBy("s", "session").agg(F.max("ord").alias("ord"))
    opened = ends.select("s", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit('{"sessionId":"'), F.col("s"), F.lit('","messages":[')).alias("line"))
    closed = ends.select("s", (F.col("ord") + 1).alias("ord"), F.lit("]}").alias("line"))
    put("gemini", inner.select("s", "ord", "line").unionByName(opened).unionByName(closed).withColumn("path", F.concat(F.lit("tmp/"), F.col("s"), F.lit("/chats/c.json"))))
    put("gemini", own.groupBy("s", "cwd").agg(F.min("ord").alias("ord")).select(F.concat(F.lit("tmp/"), F.col("s"), F.lit("/.project_root")).alias("path"), "ord", F.col("cwd").alias("line")))

    name, bucket = F.concat_ws("-", "s", "model"), (F.col("session") % _STORES).cast("string")
    per_model = lambda h: of(h).groupBy("s", "session", "cwd", "model").agg(*(F.sum(c).alias(c) for c in P.COUNTS), F.min("ts").alias("ts"))
    own = per_model("hermes")
    values = _row("tttiiiiiiit", name, F.lit("cli"), F.col("model"), F.floor(F.col("ts") / 1000), F.floor(F.col("ts") / 1000), *(F.col(c) for c in P.COUNTS), F.lit(0), F.col("cwd"))
    keep("hermes", own.select(F.concat(bucket, F.lit("/state.db")).alias("path"), F.lit("sessions").alias("into"), values.alias("row")), {"sessions": "id, source, model, started_at, ended_at, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, cwd", "messages": "session_id, role, timestamp"})

    own = per_model("opencode")
    values = _row("tttiiiiiii", name, F.col("cwd"), js(F.col("model").alias("id")), F.col("input"), F.col("output"), F.lit(0), F.col("cache_read"), F.col("cache_creation"), F.col("ts"), F.col("ts"))
    at = F.when(F.col("session") % _STORES == 0, "opencode.db").otherwise(F.concat(F.lit("opencode-c"), bucket, F.lit(".db")))
    keep("opencode", own.select(at.alias("path"), F.lit("session").alias("into"), values.alias("row")), {"session": "id, directory, model, tokens_input, tokens_output, tokens_reasoning, tokens_cache_read, tokens_cache_write, time_created, time_updated", "message": "session_id, time_created"})

    own = of("copilot")
    values = _row("titiiiiit", F.col("s"), F.col("ord"), F.col("model"), *(F.col(c) for c in P.COUNTS), F.lit(0), iso(F.col("ts")))
    events = own.select(F.concat(bucket, F.lit("/session-store.db")).alias("path"), F.lit("assistant_usage_events").alias("into"), values.alias("row"))
    heads = own.groupBy("s", "session", "cwd").agg(F.min("ord").alias("ord")).select(F.concat(bucket, F.lit("/session-store.db")).alias("path"), F.lit("sessions").alias("into"), _row("tt", F.col("s"), F.col("cwd")).alias("row"))
    keep("copilot", events.unionByName(heads), {"assistant_usage_events": "session_id, turn_index, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, created_at", "sessions": "id, cwd"})

    homes = {h: f"{root}/{h}" for h in bindings.HARNESSES}
    homes |= {h: [f"{root}/{h}/{k}" for k in range(_STORES)] for h in ("hermes", "copilot")}
    return {h: homes[h] for h in wanted}


#: What the formats keep of the events: three have no cache writes, grok's sessions one model, two stores a start per session and model.
_HOMES = """
SELECT * REPLACE (CASE WHEN harness IN ('codex', 'grok', 'gemini') THEN 0 ELSE cache_creation END AS cache_creation,
                  CASE WHEN harness = 'grok' THEN 'grok-4.5' ELSE model END AS model,
                  CASE harness WHEN 'hermes' THEN min(ts) OVER (PARTITION BY session, model) // 1000 * 1000 WHEN 'opencode' THEN min(ts) OVER (PARTITION BY session, model) ELSE ts END AS ts) FROM usage"""
_PRICED = f", homes AS ({_HOMES}), homes_priced AS (SELECT u.*, r.* EXCLUDE (model_key), s.model_key FROM homes u LEFT JOIN (SELECT * FROM resolved UNION ALL SELECT 'grok-4.5', max(model_key) FROM rates WHERE starts_with('grok-4.5', model_key) HAVING NOT EXISTS (SELECT 1 FROM resolved WHERE model = 'grok-4.5')) s USING (model) LEFT JOIN rates r ON r.model_key = s.model_key)\n"


def _sql(body: str) -> str:
    return sql(_PRICED + body.replace("priced", "homes_priced"), "usage", "rates", "resolved")


def priced(spark, d: str) -> DataFrame:
    usage = cut(corpus.read(spark, homes_of(spark, d)).usage)  # asked for its models, then for its sums
    return P.with_rates(usage, P.rates(spark))


@query("sc34_homes_by_model", _sql(f"SELECT coalesce(model, 'TOTAL') AS model, {_SUMS}, CAST(sum(input + output + cache_read + cache_creation) AS BIGINT) AS total, {_COST} AS cost_usd, {_PARTIAL} AS partial, CAST(grouping(model) AS INTEGER) AS is_total FROM {_GROUPED.format(keys='1 AS one')} GROUP BY ROLLUP (model)"))
def homes_by_model(spark, d):
    return views.by_model(priced(spark, d))


@query("sc34_homes_by_project", _sql(f"SELECT project, CAST(sum(total) AS BIGINT) AS total, arg_max(model, (total, model)) AS top_model, count(DISTINCT model) AS models, {_COST} AS cost_usd, {_PARTIAL} AS partial FROM (SELECT *, input + output + cache_read + cache_creation AS total FROM {_GROUPED.format(keys='project')}) GROUP BY project HAVING sum(total) > 0"))
def homes_by_project(spark, d):
    return views.by_project(priced(spark, d))


_LAST = "(SELECT max(DATE '1970-01-01' + CAST(ts // 86400000 AS INTEGER)) FROM homes)"


@query("sc38_homes_by_day", _sql(f"SELECT day, CAST(sum(total) AS BIGINT) AS total, arg_max(model, (total, model)) AS top_model, {_COST} AS cost_usd, {_PARTIAL} AS partial FROM (SELECT *, input + output + cache_read + cache_creation AS total FROM {_GROUPED.format(keys=chr(68) + 'ATE ' + chr(39) + '1970-01-01' + chr(39) + ' + CAST(ts // 86400000 AS INTEGER) AS day')}) WHERE day > {_LAST} - 30 GROUP BY day"))
def homes_by_day(spark, d):
    usage = cut(corpus.read(spark, homes_of(spark, d)).usage.select("ts", "model", *P.COUNTS))  # asked for its last day, then for its sums
    last = usage.agg(F.max(views.local_day(F.col("ts"))).alias("d")).first()[0]
    return views.by_day(P.with_rates(usage, P.rates(spark)), F.lit(last), 30)


@query("sc33_homes_state", sql("SELECT harness, CASE harness WHEN 'grok' THEN 'absent' WHEN 'pi' THEN 'refused' WHEN 'hermes' THEN CASE WHEN count(DISTINCT session % 4) > 1 THEN 'partial' ELSE 'failed' END WHEN 'copilot' THEN 'failed' ELSE 'read' END AS state, CASE harness WHEN 'hermes' THEN 1 WHEN 'copilot' THEN count(DISTINCT session % 4) ELSE 0 END AS lost, CASE WHEN harness IN ('grok', 'pi', 'copilot') THEN 0 WHEN harness = 'hermes' THEN count(DISTINCT session) FILTER (session % 4 <> (SELECT min(session % 4) FROM usage WHERE harness = 'hermes')) ELSE count(DISTINCT session) END AS sessions FROM usage GROUP BY harness", "usage"))
def homes_state(spark, d):
    """One home is absent, one holds another format, one has lost a store of several, one all of them. What is left counts in full."""
    homes = homes_of(spark, d)
    homes |= {"grok": f"{homes['grok']}/none", "pi": homes["gemini"]}
    kept = {h: [p for p in corpus.stores(h, homes[h]) if os.path.isfile(p)] for h in ("hermes", "copilot")}
    for path in [*kept["hermes"][:1], *kept["copilot"]]:
        with open(path, "r+b") as out:
            out.seek(4096)
            out.write(b"\xff" * 4096)  # the first page of the first table
    found = corpus.read(spark, homes)
    own = found.usage.select("harness", F.regexp_extract("session", r"^\D*(\d+)", 1).cast("long").alias("s")).groupBy("harness").agg(F.count_distinct(F.col("s") % 1_000_000).alias("sessions"))
    return found.state.join(own, "harness", "left").select("harness", "state", "lost", F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"))


def _store(harness: str, session: str, order: str) -> str:
    own = _HOMES + f" WHERE harness = '{harness}'"
    return sql(f"SELECT {session} AS session, model, count(*) AS n, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_creation) AS BIGINT) AS cache_creation, min(ts) AS first_ts FROM ({own}) GROUP BY 1, 2" if order == "event" else f"SELECT session || '-' || model AS session, model, 1::BIGINT AS n, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_creation) AS BIGINT) AS cache_creation, min(ts) AS first_ts FROM ({own}) GROUP BY session, model", "usage")


def _one(spark, d: str, harness: str) -> DataFrame:
    homes = homes_of(spark, d, harness)[harness]
    found = corpus.atoms_of(spark, harness, [homes] if isinstance(homes, str) else homes).usage
    return found.groupBy("session", "model").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in P.COUNTS), F.min("ts").alias("first_ts"))


@query("sc17_hermes_store", _store("hermes", "", "session"))
def hermes_store(spark, d):
    return _one(spark, d, "hermes")


@query("sc18_opencode_store", _store("opencode", "", "session"))
def opencode_store(spark, d):
    return _one(spark, d, "opencode")


@query("sc20_copilot_store", _store("copilot", "CAST(session AS VARCHAR)", "event"))
def copilot_store(spark, d):
    return _one(spark, d, "copilot")


@query("sc9_codex_context", sql("SELECT 'rollout-' || session AS session, CAST(arg_max(input + cache_read, ord) AS BIGINT) AS occupancy, arg_max(model, ord) AS model, 272000::BIGINT AS stated_window FROM usage WHERE harness = 'codex' GROUP BY session", "usage"))
def codex_context(spark, d):
    meta = corpus.atoms_of(spark, "codex", [homes_of(spark, d, "codex")["codex"]]).meta
    return meta.select("session", "context.occupancy", "context.model", "context.stated_window")

"""The JSON log sources: each gives usage rows, activity events and what it could not read.

``usage``: session, ord (path, line), ts, model, four counts, thinking. ``events``: session, ts, is_prompt. ``health``: a row per
record that the format should explain, ``bad`` where it did not. Input counts exclude cached tokens throughout.

Logs are read and parsed once: what is needed of each record is written as a narrow table (``shared.cut``), which all that follows reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.dedup import valid
from ..operators.joins import model_in_force
from ..operators.ordered import carried, cumulative_deltas
from ..shared import cut
from .lines import Home, array, beside, boolean, count, filled, is_object, lines, millis, number, parsed, raw, stem, string

V = "v"


@dataclass
class Atoms:
    usage: DataFrame
    events: DataFrame
    health: DataFrame
    skills: DataFrame | None = None
    meta: DataFrame | None = None
    lost: DataFrame | None = None  # path and reason of what was found but could not be read


def _first_of(*options: Column) -> Column:
    return F.coalesce(*options)


# ---- Claude-style transcripts


def claude(found: DataFrame) -> Atoms:
    """Transcripts of messages with usage, direct or nested in agent progress. A session's subagent files belong to its thread."""
    rows = parsed(lines(found))
    thread = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]+)/subagents/[^/]+(?:/[^/]+)*\.jsonl$", 1), F.lit("")), stem(F.col("path")))
    rows = rows.withColumns({"thread": thread, "is_sub": F.contains("path", F.lit("/subagents/"))})
    nested, direct = is_object(V, "data.message.message.usage"), is_object(V, "message.usage")
    # the record that counts: the one inside agent progress, or the line itself; parsed once for all its fields
    rows = rows.withColumns({"nested": nested, "direct": direct}).withColumn("m", F.when(F.col("nested"), raw(V, "data.message")).otherwise(F.col(V)))
    rows = rows.withColumn("u", F.when(F.col("nested") | F.col("direct"), raw("m", "message.usage")).otherwise(raw(V, "usage")))
    clients = [string("m", k) for k in ("entryPoint", "entrypoint", "client", "clientName")] + [string(V, "entryPoint"), string(V, "entrypoint")]
    thinking = [F.when(F.col("nested") | F.col("direct"), number("u", k)) for k in ("reasoning_output_tokens", "thinking_tokens", "thinking_output_tokens")]
    speed = F.when(F.col("nested") | F.col("direct"), raw("u", "speed"))
    stamp = F.coalesce(string(V, "timestamp"), string(V, "data.message.timestamp"))
    content = array(V, "message.content")
    echo = F.coalesce(F.exists(content, lambda b: F.try_variant_get(b, "$.type", "string") == "tool_result"), F.lit(False))
    prompt = (string(V, "type") == "user") & ~F.coalesce(boolean(V, "isMeta"), F.lit(False)) & ~echo
    told = rows.withColumns({"client": F.coalesce(*clients), "side": boolean("m", "isSidechain")})
    seen = cut(told.select(
        "thread", "is_sub", "path", "line_no",
        (F.col("nested") | F.col("direct") | is_object(V, "usage")).alias("told"), F.isnull(V).alias("bad"), millis(stamp).alias("at"), F.coalesce(prompt, F.lit(False)).alias("is_prompt"),
        filled(V, "cwd").alias("cwd"), filled(V, "sessionId").alias("tool_session_id"),
        millis(string("m", "timestamp")).alias("ts"),
        F.when(~F.col("nested"), string(V, "sessionId")).alias("session_id"),
        F.when(~F.col("nested"), string(V, "version")).alias("version"),
        string("m", "message.id").alias("message_id"),
        string("m", "requestId").alias("request_id"),
        F.coalesce(string("m", "message.model"), string("m", "model")).alias("model"),
        F.col("side").alias("is_sidechain"),
        F.coalesce(number("m", "costUSD"), F.lit(0.0)).alias("cost"),
        F.coalesce(speed.isNotNull() & ~F.is_variant_null(speed), F.lit(False)).alias("has_speed"),
        T.entry_point(F.col("client"), F.col("side")).alias("entry_point"),
        F.coalesce(*thinking, F.lit(0.0)).cast("long").alias("thinking"),
        count("u", "input_tokens").alias("input"), count("u", "output_tokens").alias("output"),
        count("u", "cache_read_input_tokens").alias("cache_read"), count("u", "cache_creation_input_tokens").alias("cache_creation"),
    ))
    usage = seen.where("told").withColumn("ord", F.struct("is_sub", "path", "line_no")).drop("told", "bad", "at", "is_prompt", "cwd", "tool_session_id")
    events = seen.where("at is not null").select(F.col("thread").alias("session"), F.col("at").alias("ts"), "is_prompt")
    return Atoms(usage, events, seen.select("path", "bad"), _claude_skills(rows, content), _claude_meta(seen, usage))


def _claude_meta(seen: DataFrame, usage: DataFrame) -> DataFrame:
    """Per thread, of its own file: the first folder, the first session id, the last model of a row that counts."""
    own = seen.where("not is_sub")
    first = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias(name)
    heads = own.groupBy("thread").agg(first("cwd"), first("tool_session_id"))
    last = usage.where(valid() & ~F.col("is_sub") & (F.col("model") != "")).groupBy("thread").agg(F.max_by("model", "line_no").alias("last_model"))
    return heads.join(last, "thread", "left").withColumnRenamed("thread", "session")


def claude_order(usage: DataFrame) -> DataFrame:
    """``usage`` with the ``ord`` that replays are settled in: threads by their first counted row, then the thread's own file, then its subagents'."""
    starts = usage.where(valid()).groupBy("thread").agg(F.min("ts").alias("first_ts"))
    joined = usage.join(starts, "thread", "left")
    return joined.withColumn("ord", F.struct(F.col("first_ts").isNull().alias("late"), "first_ts", "thread", "is_sub", "path", "line_no")).drop("first_ts")


def _claude_skills(rows: DataFrame, content: Column) -> DataFrame:
    """Invocations: command tags of user lines, skill calls and dispatches of assistant lines, with what tells replays apart."""
    place = F.struct("is_sub", "path", "line_no").alias("ord")
    texts = F.when(string(V, "message.content").isNotNull(), F.array(string(V, "message.content"))).otherwise(F.transform(F.filter(content, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.try_variant_get(b, "$.text", "string")))
    tags = rows.where(string(V, "type") == "user").select("thread", place, filled(V, "uuid").alias("uuid"), F.explode(texts).alias("text")).select("thread", "ord", "uuid", F.explode(T.command_tags(F.col("text"))).alias("raw"))
    commands = tags.select("thread", "ord", F.lit("skill").alias("kind"), T.skill_id(F.col("raw")).alias("id"), "uuid").select("thread", "ord", "kind", "id", F.when(F.col("uuid").isNotNull(), F.concat_ws(":", F.lit("cmd"), "uuid", "id")).alias("key"))
    B = F.col("b")
    blocks = rows.where(string(V, "type") == "assistant").select("thread", place, F.explode(content).alias("b")).where(string(B, "type") == "tool_use")
    name = string(B, "name")
    kind = F.when(name == "Skill", "skill").when(name.isin("Agent", "Task"), "agent")
    given = F.when(name == "Skill", T.skill_id(filled(B, "input.skill"))).otherwise(T.agent_id(filled(B, "input.subagent_type")))
    calls = blocks.select("thread", "ord", kind.alias("kind"), given.alias("id"), F.concat(F.lit("tool:"), filled(B, "id")).alias("key")).where("kind is not null")
    return commands.unionByName(calls).where("id is not null")


# ---- Codex rollouts


def codex(found: DataFrame) -> Atoms:
    """Rollouts with cumulative counters; increments go to the model last named before them. Input includes cached tokens."""
    rows = parsed(lines(found)).withColumn("session", stem(F.col("path")))
    kind, payload = string(V, "type"), string(V, "payload.type")
    seen = cut(rows.select(
        F.isnull(V).alias("bad"), F.when(kind == "session_meta", F.struct(filled(V, "payload.id").alias("id"), filled(V, "payload.cwd").alias("cwd"))).alias("head"),
        "session", "path", F.col("line_no").cast("long").alias("line_no"), millis(string(V, "timestamp")).alias("ts"), kind.alias("kind"), payload.alias("event"),
        F.when(kind == "turn_context", filled(V, "payload.model")).alias("named"),
        is_object(V, "payload.info.total_token_usage").alias("counted"),
        is_object(V, "payload.info").alias("informed"), number(V, "payload.info.last_token_usage.input_tokens").cast("long").alias("occupancy"), number(V, "payload.info.model_context_window").cast("long").alias("stated_window"),
        *(count(V, f"payload.info.total_token_usage.{n}").alias(n) for n in ("total_tokens", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")),
    ))
    known = carried(seen.drop("bad", "head"), "session", "line_no", F.col("named"), "model", width=10_000)
    ticks = cut(known.where("kind = 'event_msg' and event = 'token_count' and (counted or informed)"))
    snaps = ticks.where("counted").withColumn("cached_input_tokens", F.least("cached_input_tokens", "input_tokens"))
    steps = cumulative_deltas(snaps, "session", ["line_no"], "total_tokens", ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"])
    usage = steps.join(snaps.select("session", "line_no", "path", "ts", "model"), ["session", "line_no"]).select(
        "session", F.struct("path", "line_no").alias("ord"), "ts", F.coalesce("model", F.lit("unknown")).alias("model"),
        F.greatest(F.col("input_tokens") - F.col("cached_input_tokens"), F.lit(0)).alias("input"), F.col("output_tokens").alias("output"),
        F.col("cached_input_tokens").alias("cache_read"), F.lit(0).cast("long").alias("cache_creation"), F.col("reasoning_output_tokens").alias("thinking"),
    ).where("input + output + cache_read > 0")
    events = seen.where("ts is not null").select("session", "ts", ((F.col("kind") == "event_msg") & F.coalesce(F.col("event") == "user_message", F.lit(False))).alias("is_prompt"))
    meta = seen.where("head is not null").groupBy("session").agg(F.min_by("head.id", "line_no").alias("tool_session_id"), F.min_by("head.cwd", "line_no").alias("cwd"))
    # of the last report alone: how full the context was, and the window that it states
    final = ticks.where("informed").groupBy("session").agg(F.max_by(F.struct("occupancy", F.coalesce("model", F.lit("unknown")).alias("model"), "stated_window", F.col("ts").alias("at")), "line_no").alias("context"))
    meta = meta.join(final.where("context.occupancy is not null"), "session", "full_outer")
    return Atoms(usage, events, seen.select("path", "bad"), meta=meta)


def codex_limits(found: DataFrame) -> DataFrame:
    """The last rate-limit snapshot of the newest rollout: a row per window; relative resets count from the snapshot."""
    rows = parsed(lines(found, contains="rate_limits")).where(is_object(V, "payload.rate_limits"))
    last = rows.agg(F.max_by(F.struct("v"), F.struct("mtime_ms", "path", "line_no")).alias("x")).select(F.col("x.v").alias("v"))
    base = "payload.rate_limits"
    windows = F.explode(F.array(*(F.struct(F.lit(n).alias("slot"), number(V, f"{base}.{n}.used_percent").alias("percent"), number(V, f"{base}.{n}.window_minutes").alias("minutes"), number(V, f"{base}.{n}.resets_at").alias("resets_at"), number(V, f"{base}.{n}.resets_in_seconds").alias("resets_in")) for n in ("primary", "secondary"))))
    found = last.select(millis(string(V, "timestamp")).alias("ts"), windows.alias("w")).select("ts", "w.*").where("percent is not null and minutes is not null")
    resets = F.coalesce(F.col("resets_at") * 1000, F.col("ts") + F.col("resets_in") * 1000).cast("long")
    return found.select("slot", "percent", F.col("minutes").cast("long").alias("minutes"), resets.alias("resets_at_ms"))


# ---- Grok logs


def grok(unified: DataFrame, turns: DataFrame, summaries: DataFrame) -> Atoms:
    """A shared log of inferences, whose models are those in force in the session's turns (with a small clock skew)."""
    rows = parsed(lines(unified, contains='"shell.turn.inference_done"')).where((string(V, "msg") == "shell.turn.inference_done") | F.isnull(V))
    counts = [number(V, "ctx.prompt_tokens"), number(V, "ctx.completion_tokens")]
    bad = F.isnull(V) | string(V, "sid").isNull() | counts[0].isNull() | counts[1].isNull() | millis(string(V, "ts")).isNull()
    seen = cut(rows.select(
        "path", "line_no", F.coalesce(bad, F.lit(True)).alias("bad"), string(V, "sid").alias("session"), millis(string(V, "ts")).alias("ts"),
        F.greatest(count(V, "ctx.prompt_tokens") - count(V, "ctx.cached_prompt_tokens"), F.lit(0)).alias("input"), count(V, "ctx.completion_tokens").alias("output"),
        count(V, "ctx.cached_prompt_tokens").alias("cache_read"), F.lit(0).cast("long").alias("cache_creation"), count(V, "ctx.reasoning_tokens").alias("thinking"),
    ))
    good = seen.where("not bad").select("session", F.struct("path", "line_no").alias("ord"), "ts", "input", "output", "cache_read", "cache_creation", "thinking")
    sid = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    marks = cut(parsed(lines(turns)).select(sid.alias("session"), millis(string(V, "ts")).alias("ts"), string(V, "type").alias("type"), filled(V, "model_id").alias("model")))
    starts = marks.where("type = 'turn_started'").select("session", "ts", "model")
    meta = cut(parsed(summaries, "value").select(F.coalesce(filled(V, "info.id"), sid).alias("session"), filled(V, "info.cwd").alias("cwd"), filled(V, "current_model_id").alias("own")))
    usage = model_in_force(good.join(meta.select("session", "own").dropDuplicates(["session"]), "session", "left"), starts.where("ts is not null"), fallback=F.col("own"))
    usage = usage.withColumnRenamed("model_in_force", "model").drop("own")
    events = marks.where("type in ('turn_started', 'turn_ended')").select("session", "ts", (F.col("type") == "turn_started").alias("is_prompt"))
    events = events.unionByName(good.select("session", "ts", F.lit(False).alias("is_prompt"))).where("ts is not null")
    return Atoms(usage, events, seen.select("path", "bad"), meta=meta)


def grok_credits(unified: DataFrame) -> DataFrame:
    """The last well-formed billing snapshot: tier, percent used, period."""
    rows = parsed(lines(unified, contains="billing: fetched credits config")).where(string(V, "msg") == "billing: fetched credits config")
    item = F.struct(millis(string(V, "ts")).alias("ts"), string(V, "ctx.subscriptionTier").alias("tier"), number(V, "ctx.config.creditUsagePercent").alias("percent"), string(V, "ctx.config.currentPeriod.type").alias("period"), millis(string(V, "ctx.config.currentPeriod.end")).alias("resets_at_ms"))
    return rows.where(is_object(V, "ctx.config")).agg(F.max_by(item, F.struct("path", "line_no")).alias("x")).where("x is not null").select("x.*")


# ---- pi and OpenClaw sessions

# The entry types that these logs know.
PI_TYPES = ("session", "message", "model_change", "thinking_level_change", "label", "compaction", "branch_summary", "custom", "custom_message", "session_info")
OPENCLAW_TYPES = ("session", "message", "custom_message", "custom", "compaction", "branch_summary")


def _head() -> Column:
    """Of a session line: its id and folder."""
    return F.when(string(V, "type") == "session", F.struct(filled(V, "id").alias("id"), filled(V, "cwd").alias("cwd"))).alias("head")


def _header(seen: DataFrame, name: str) -> DataFrame:
    """Per file: id and folder of its first session line; without an id, the file name."""
    first = seen.groupBy("path").agg(F.min_by("head", F.when(F.col("head").isNotNull(), F.col("line_no"))).alias("h"))
    return first.select("path", F.coalesce("h.id", stem(F.col("path"))).alias(name), F.col("h.cwd").alias("cwd"))


def pi(found: DataFrame) -> Atoms:
    """Session files with net counts; a message's model is the one changed to last (with a small clock skew), else its own."""
    rows = parsed(lines(found))
    kind, role = string(V, "type"), string(V, "message.role")
    stamp = millis(string(V, "timestamp"))
    known = F.coalesce(kind.isin(*PI_TYPES), F.lit(False))
    counted = number(V, "message.usage.input").isNotNull() & number(V, "message.usage.output").isNotNull()
    seen = cut(rows.select(
        "path", "line_no", _head(), known.alias("known"), kind.alias("kind"), role.alias("role"), counted.alias("counted"), stamp.alias("stamp"), string(V, "modelId").alias("changed"),
        F.coalesce(number(V, "message.timestamp").cast("long"), stamp).alias("ts"), filled(V, "message.model").alias("own"),
        count(V, "message.usage.input").alias("input"), count(V, "message.usage.output").alias("output"), count(V, "message.usage.cacheRead").alias("cache_read"),
        count(V, "message.usage.cacheWrite").alias("cache_creation"), count(V, "message.usage.reasoning").alias("thinking"),
    ))
    answer = F.expr("known and kind = 'message' and role = 'assistant'")
    head = _header(seen, "session")
    named = seen.join(head.select("path", "session"), "path")
    good = named.where(answer & F.col("counted")).select("session", F.struct("path", "line_no").alias("ord"), "ts", "own", "input", "output", "cache_read", "cache_creation", "thinking").where("ts is not null")
    changes = named.where("known and kind = 'model_change' and stamp is not null").select("session", F.col("stamp").alias("ts"), F.col("changed").alias("model"))
    usage = model_in_force(good, changes, fallback=F.col("own")).withColumnRenamed("model_in_force", "model").drop("own")
    events = named.where("known and stamp is not null").select("session", F.col("stamp").alias("ts"), F.coalesce((F.col("kind") == "message") & (F.col("role") == "user"), F.lit(False)).alias("is_prompt"))
    return Atoms(usage, events, seen.select("path", (~F.col("known") | F.coalesce(answer & ~F.col("counted"), F.lit(False))).alias("bad")), meta=head)


def openclaw_usage(u: str) -> dict[str, Column]:
    """Counts from the many names that providers use; a cached-tokens name of the including kind is subtracted from input."""

    def first(*names: str) -> Column:
        return F.coalesce(*(number(V, f"{u}.{n}") for n in names))

    read = first("cacheRead", "cache_read", "cache_read_input_tokens", "cached_tokens", "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens")
    given = first("input", "inputTokens", "input_tokens", "promptTokens", "prompt_tokens", "prompt_n", "timings.prompt_n")
    including = F.coalesce(*(raw(V, f"{u}.{n}") for n in ("cached_tokens", "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens"))).isNotNull()
    whole = lambda c: F.greatest(c, F.lit(0.0)).cast("long")
    keep = lambda c: F.when(c.isNotNull(), whole(c))
    return {
        "input": F.when(including & read.isNotNull(), F.greatest(keep(given) - keep(read), F.lit(0))).otherwise(keep(given)),
        "output": keep(first("output", "outputTokens", "output_tokens", "completionTokens", "completion_tokens", "predicted_n", "timings.predicted_n")),
        "cache_read": keep(read),
        "cache_creation": keep(first("cacheWrite", "cache_write", "cache_creation_input_tokens")),
        "thinking": keep(first("reasoningTokens", "reasoning_tokens", "completion_tokens_details.reasoning_tokens", "output_tokens_details.reasoning_tokens")),
    }


def openclaw(found: DataFrame) -> Atoms:
    """Session files of many providers; mirror deliveries are left out; a line without a time has its file's."""
    rows = parsed(lines(found.where(~F.col("path").endswith(".trajectory.jsonl"))))
    kind, role = string(V, "type"), string(V, "message.role")
    known = F.coalesce(kind.isin(*OPENCLAW_TYPES), F.lit(False))
    stamp = F.coalesce(millis(string(V, "timestamp")), number(V, "timestamp").cast("long"), F.col("mtime_ms"))
    provider = F.trim(F.coalesce(string(V, "message.provider"), string(V, "provider"), F.lit("")))
    model = F.trim(F.coalesce(string(V, "message.model"), string(V, "model"), F.lit("")))
    mirror = (provider == "openclaw") & (model == "delivery-mirror")
    inner, outer = openclaw_usage("message.usage"), openclaw_usage("usage")
    has_inner = is_object(V, "message.usage")
    counts = {n: F.when(has_inner, inner[n]).otherwise(outer[n]) for n in inner}
    seen = cut(rows.select(
        "path", "line_no", _head(), known.alias("known"), (known & (kind == "message") & (role == "assistant") & ~mirror).alias("answer"), F.coalesce((kind == "message") & (role == "user"), F.lit(False)).alias("is_prompt"),
        stamp.alias("ts"), F.coalesce(F.nullif(model, F.lit("")), F.nullif(provider, F.lit("")), F.lit("unknown")).alias("model"), *(c.alias(n) for n, c in counts.items()),
    ))
    head = _header(seen, "session")
    named = seen.join(head.select("path", "session"), "path")
    full = named.where("answer and input is not null and output is not null")
    usage = full.select("session", F.struct("path", "line_no").alias("ord"), "ts", "model", "input", "output", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("cache_read", "cache_creation", "thinking")))
    events = named.where("known").select("session", "ts", "is_prompt")
    health = seen.select("path", (~F.col("known")).alias("bad")).unionByName(seen.where("answer and (input is null or output is null)").select("path", F.lit(True).alias("bad")))
    return Atoms(usage, events, health, meta=head)


# ---- Gemini chats


def gemini(found: DataFrame) -> Atoms:
    """One object per file; prompts include the cached part, which is cut to the prompt."""
    rows = parsed(found, "value").withColumn("session", F.coalesce(filled(V, "sessionId"), stem(F.col("path"))))
    messages = rows.select("session", "path", array(V, "messages").isNull().alias("whole"), F.posexplode_outer(array(V, "messages")).alias("line_no", "m"))
    M = F.col("m")
    kind, stamp = string(M, "type"), millis(string(M, "timestamp"))
    prompt, cached = count(M, "tokens.input"), count(M, "tokens.cached")
    counted = number(M, "tokens.input").isNotNull() & number(M, "tokens.output").isNotNull()
    seen = cut(messages.select(
        "session", "path", "line_no", "whole", kind.alias("kind"), stamp.alias("ts"), counted.alias("counted"), F.coalesce(filled(M, "model"), F.lit("unknown")).alias("model"),
        F.greatest(prompt - cached, F.lit(0)).alias("input"), count(M, "tokens.output").alias("output"), F.least(cached, prompt).alias("cache_read"),
        F.lit(0).cast("long").alias("cache_creation"), count(M, "tokens.thoughts").alias("thinking"),
    ))
    answers = seen.where("kind = 'gemini'")
    usage = answers.where("counted and ts is not null").select("session", F.struct("path", "line_no").alias("ord"), "ts", "model", "input", "output", "cache_read", "cache_creation", "thinking")
    events = seen.where("kind is not null and ts is not null").select("session", "ts", (F.col("kind") == "user").alias("is_prompt"))
    whole = seen.where("whole").select("path", F.lit(True).alias("bad"))
    return Atoms(usage, events, answers.select("path", (~F.col("counted")).alias("bad")).unionByName(whole))


# ---- opencode's files


def opencode_files(infos: DataFrame, messages: DataFrame) -> Atoms:
    """Session and message objects in folders; sessions with a parent are left out, user messages only mark time."""
    heads = parsed(infos, "value").where(filled(V, "id").isNotNull() & (raw(V, "parentID").isNull() | F.is_variant_null(raw(V, "parentID"))))
    meta = heads.select(filled(V, "id").alias("session"), filled(V, "directory").alias("cwd"), number(V, "time.created").cast("long").alias("created"))
    sid = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rows = parsed(messages, "value").withColumn("session", sid).join(meta.select("session"), "session", "left_semi").where(F.isnotnull(V))
    model = F.when(filled(V, "modelID").isNotNull(), F.concat_ws("/", filled(V, "providerID"), filled(V, "modelID")))
    stamp = number(V, "time.created").cast("long")
    user = F.coalesce(string(V, "role") == "user", F.lit(False))
    usage = rows.where(~user).select(
        "session", F.struct("path", F.lit(0).alias("line_no")).alias("ord"), stamp.alias("ts"), F.coalesce(model, F.lit("unknown")).alias("model"),
        count(V, "tokens.input").alias("input"), count(V, "tokens.output").alias("output"), count(V, "tokens.cache.read").alias("cache_read"), count(V, "tokens.cache.write").alias("cache_creation"), count(V, "tokens.reasoning").alias("thinking"),
    )
    events = rows.select("session", stamp.alias("ts"), F.lit(False).alias("is_prompt")).where("ts is not null")
    quiet = meta.join(events.select("session").distinct(), "session", "left_anti").where("created > 0").select("session", F.col("created").alias("ts"), F.lit(False).alias("is_prompt"))
    return Atoms(usage, events.unionByName(quiet), rows.select("path", F.lit(False).alias("bad")), meta=meta)


# ---- vendor limits


def vendor_limits(bodies: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lanes of each limits response: its well-formed entries; without any, the two headline windows. ``keep`` goes along."""
    rows = parsed(bodies, column)
    lane = lambda e: F.struct(string(e, "kind").alias("kind"), string(e, "group").alias("lane_group"), number(e, "percent").alias("percent"), string(e, "severity").alias("severity"), string(e, "resets_at").alias("resets_at"), string(e, "scope.model.display_name").alias("scope"))
    stated = F.filter(F.transform(array(V, "limits"), lane), lambda x: x["kind"].isNotNull() & x["lane_group"].isNotNull() & x["percent"].isNotNull() & x["severity"].isNotNull() & x["resets_at"].isNotNull())
    head = lambda at, kind, group: F.struct(F.lit(kind).alias("kind"), F.lit(group).alias("lane_group"), number(V, f"{at}.utilization").alias("percent"), F.lit("normal").alias("severity"), string(V, f"{at}.resets_at").alias("resets_at"), F.lit(None).cast("string").alias("scope"))
    coarse = F.filter(F.array(head("five_hour", "session", "session"), head("seven_day", "weekly_all", "weekly")), lambda x: x["percent"].isNotNull() & x["resets_at"].isNotNull())
    lanes = F.when(F.size(F.coalesce(stated, F.array().cast("array<struct<kind:string,lane_group:string,percent:double,severity:string,resets_at:string,scope:string>>"))) > 0, stated).otherwise(coarse)
    return rows.select(*keep, F.explode(lanes).alias("x")).select(*keep, "x.*")


#: The files of grok, in lines and whole: names are listed together, and told apart by their column.
GROK_LINES, GROK_FILES = "{unified,events}.jsonl", "{summary.json,models_cache.json,config.toml}"


def find(spark: SparkSession, root: str | list[str], harness: str, home: Home | None = None) -> Atoms:
    """The atoms of a harness with JSON logs under its root folder."""
    home = home or Home(spark, root)
    read, read_lines = home.files, home.lines
    if harness == "claude_code":
        return claude(read_lines("*.jsonl"))
    if harness == "codex":
        return codex(read_lines("rollout-*.jsonl"))
    if harness == "grok":
        logged = read_lines(GROK_LINES)
        return grok(logged.where("name = 'unified.jsonl'"), logged.where("name = 'events.jsonl'"), read(GROK_FILES).where("name = 'summary.json'"))
    if harness == "pi":
        return pi(read_lines("*.jsonl"))
    if harness == "openclaw":
        return openclaw(read_lines("*.jsonl"))
    if harness == "gemini":
        found = read("*.json")
        atoms = gemini(found.where(F.col("path").rlike(r"/chats/[^/]+$")))
        return Atoms(atoms.usage, atoms.events, atoms.health, meta=gemini_folders(found))
    if harness == "opencode":
        all_ = read("*.json")
        return opencode_files(all_.where(F.contains("path", F.lit("/session/info/"))), all_.where(F.contains("path", F.lit("/session/message/"))))
    raise ValueError(f"no JSON logs of {harness}: see corpus.atoms_of")


def gemini_folders(found: DataFrame) -> DataFrame:
    """``session, cwd``: a chat's project folder holds a file that names the folder worked in."""
    folder = F.regexp_extract("path", r"^(.*)/chats/[^/]+$", 1)
    rows = parsed(found, "value").select(folder.alias("folder"), F.coalesce(filled(V, "sessionId"), stem(F.col("path"))).alias("session")).where("folder <> ''")
    named = beside(rows.select("folder").distinct(), ".project_root")
    return rows.join(named, "folder").groupBy("session").agg(F.min("value").alias("cwd"))

"""All harnesses as one corpus: from their homes to usage, events, sessions and health.

Each harness has a gate (a mark of its format that must be there before anything is read), a reader, and the names that the rest
of the library uses. A harness whose home is missing, whose gate finds no mark, or that cannot be read gives no rows, and a
row of ``state`` that says so. A store that breaks off while it is read counts for nothing, and ``state`` and ``health`` count it as lost: the
stores are read for that once, before anything else.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import COUNTS
from ..functions.text import base_name
from ..operators import views
from ..operators.activity import GAP_MS
from ..operators.dedup import deduplicate, valid
from ..operators.sessions import fold
from . import logs, sqlite
from .discovery import opencode_stores, unique_transcripts
from .lines import Home, array, filled, millis, number, parsed, string, text_lines

V = "v"
_USAGE = ("session", "ts", "model", *COUNTS, "thinking")
#: Columns that a store must have (fixed values of the formats).
STORES = {
    "hermes": ("sessions", ("id", "source", "model", "started_at", "ended_at", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "cwd")),
    "opencode": ("session", ("id", "directory", "model", "tokens_input", "tokens_output", "tokens_reasoning", "tokens_cache_read", "tokens_cache_write", "time_created", "time_updated")),
    "copilot": ("assistant_usage_events", ("session_id", "turn_index", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "created_at")),
}


@dataclass
class Corpus:
    """``usage``: harness, session, ts, model, counts, thinking, project. ``events``: harness, session, ts, is_prompt.
    ``sessions``: a row per session. ``health``: harness, unknown, total, drift. ``state``: harness, state (read, partial, absent, refused,
    failed), lost (stores that could not be read). ``lost``: harness, path, reason."""

    usage: DataFrame
    events: DataFrame
    health: DataFrame
    state: DataFrame
    lost: DataFrame
    folded: Callable[[], DataFrame]

    @cached_property
    def sessions(self) -> DataFrame:
        return self.folded()


def _any(rows: DataFrame, condition: Column) -> bool:
    return not rows.where(condition).limit(1).isEmpty()


def _has_columns(path: str, table: str, columns: tuple[str, ...]) -> bool:
    """Whether a store has a table with all the columns: a look at its schema alone."""
    if not os.path.isfile(path):
        return False
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        return set(columns) <= {row[1] for row in db.execute(f'PRAGMA table_info("{table}")')}
    except sqlite3.DatabaseError:
        return False
    finally:
        db.close()


def stores(harness: str, roots: list[str]) -> list[str]:
    """The databases of a harness under its homes."""
    if harness == "opencode":
        return [p for r in roots for p in opencode_stores(r)]
    name = {"hermes": "state.db", "copilot": "session-store.db"}[harness]
    return [os.path.join(r, name) for r in roots]


def _opencode_infos(home: Home) -> DataFrame:
    """The session objects of opencode's file store."""
    return parsed(home.files("*.json").where(F.contains("path", F.lit("/session/info/"))), "value")


def gate(spark: SparkSession, harness: str, roots: list[str], home: Home | None = None) -> bool:
    """Whether there is a mark that the harness wrote what is under its homes."""
    home = home or Home(spark, roots)
    first_line = lambda: parsed(home.lines("*.jsonl"))
    header = (string(V, "type") == "session") & filled(V, "id").isNotNull()
    if harness in ("claude_code", "codex"):
        return True
    if harness in STORES:
        table, columns = STORES[harness]
        found = stores(harness, roots)
        return any(_has_columns(p, table, columns) for p in found) or (harness == "opencode" and _any(_opencode_infos(home), filled(V, "id").isNotNull()))
    if harness == "grok":
        logged = _any(home.lines(logs.GROK_LINES), F.col("name") == "unified.jsonl")
        # The hosts and the marketplace that the official client names in its own files.
        cached = F.col("value").rlike(r"cli-chat-proxy\.grok\.com|api\.x\.ai")
        own = home.files(logs.GROK_FILES)
        return logged and (_any(own, (F.col("name") == "models_cache.json") & cached) or _any(own, (F.col("name") == "config.toml") & F.col("value").contains("xai-org/plugin-marketplace")))
    if harness == "pi":
        return _any(first_line(), header & number(V, "version").isNotNull() & millis(string(V, "timestamp")).isNotNull())
    if harness == "openclaw":
        return _any(first_line(), header)
    if harness == "gemini":
        return _any(parsed(home.files("*.json"), "value"), string(V, "sessionId").isNotNull() & array(V, "messages").isNotNull() & F.col("path").rlike(r"/chats/[^/]+$"))
    raise ValueError(f"unknown harness {harness}")


def atoms_of(spark: SparkSession, harness: str, roots: list[str], home: Home | None = None) -> logs.Atoms:
    """The atoms of a harness under its homes, whatever it keeps them in; Claude-style transcripts with replays removed."""
    if harness == "claude_code":
        return _claude(spark, roots)
    if harness == "hermes":
        return sqlite.hermes(spark, stores(harness, roots))
    if harness == "copilot":
        return sqlite.copilot(spark, [os.path.join(r, "traces.db") for r in roots], stores(harness, roots))
    if harness == "opencode":
        return sqlite.opencode_overlaid(logs.find(spark, roots, harness, home), sqlite.opencode(spark, stores(harness, roots)))
    return logs.find(spark, roots, harness, home)


def _claude(spark: SparkSession, roots: list[str]) -> logs.Atoms:
    found = text_lines(spark, roots, "*.jsonl")
    if len(roots) > 1:  # one transcript under several roots counts once
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(roots).select("path", F.col("length").alias("size"), F.col("_metadata.file_name").alias("name"))
        chosen = unique_transcripts(listing).select(F.regexp_replace("path", "^file:/+", "/").alias("_plain"))
        found = found.join(chosen, F.regexp_replace(found["path"], "^file:/+", "/") == chosen["_plain"], "left_semi")
    atoms = logs.claude(found)
    counted = logs.claude_order(atoms.usage.where(valid())).select("ord", "thread", "ts", "model", "message_id", "request_id", "is_sidechain", "cost", "has_speed", *COUNTS, "thinking")
    kept = deduplicate(counted).withColumn("session", F.col("owner"))
    return logs.Atoms(kept.withColumn("model", F.coalesce("model", F.lit("unknown"))), atoms.events, atoms.health, atoms.skills, atoms.meta)


def _empty(spark: SparkSession) -> logs.Atoms:
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "thinking"))
    frame = lambda schema: spark.createDataFrame([], schema)
    return logs.Atoms(frame(f"session string, ts long, model string, {counts}"), frame("session string, ts long, is_prompt boolean"), frame("path string, bad boolean"), meta=frame("session string, cwd string"))


def read(spark: SparkSession, homes: Mapping[str, str | list[str]], gap_ms: int = GAP_MS) -> Corpus:
    """The corpus of all harnesses of ``homes`` (harness: its folder, or several)."""
    parts: dict[str, logs.Atoms] = {}
    state, files_of = [], {}
    for harness, given in homes.items():
        roots = [r for r in ([given] if isinstance(given, str) else given) if os.path.exists(r) or "://" in r]
        try:
            if not roots:
                state.append((harness, "absent"))
                continue
            home = Home(spark, roots)
            if not gate(spark, harness, roots, home):
                state.append((harness, "refused"))
                continue
            atoms = atoms_of(spark, harness, roots, home)
            _ = [f.schema for f in (atoms.usage, atoms.events, atoms.health)]
            parts[harness] = atoms
            state.append((harness, "read"))
            if atoms.lost is not None:
                files_of[harness] = _kept(harness, roots, atoms, home)
        except (PySparkException, OSError, sqlite3.Error):  # one harness must never take a view from the others
            state.append((harness, "failed"))
    found = parts or {"none": _empty(spark)}
    tag = lambda df, name: df.withColumn("harness", F.lit(name))
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    usage = union(tag(_with_project(a).select(*_USAGE, "project"), h) for h, a in found.items())
    events = union(tag(a.events.select("session", "ts", "is_prompt"), h) for h, a in found.items())
    folded = lambda: union(fold(a.usage.select(*_USAGE), a.events, h, gap_ms) for h, a in found.items())  # noqa: E731  a large plan, made where it is asked for
    health = views.health(union(tag(a.health.select("bad"), h) for h, a in found.items()), "harness", F.col("bad"))
    broken = [tag(a.lost, h).select("harness", "path", "reason") for h, a in found.items() if a.lost is not None]
    lost = union(broken) if broken else spark.createDataFrame([], "harness string, path string, reason string")
    return Corpus(usage, events, health, _states(spark, state, files_of, lost), lost, folded)


def _kept(harness: str, roots: list[str], atoms: logs.Atoms, home: Home) -> int:
    """How many stores a harness has under its homes; its file store counts as one that is never lost as a whole."""
    if harness == "copilot":
        traces = [p for p in (os.path.join(r, "traces.db") for r in roots) if os.path.isfile(p)]
        return len(traces) or sum(map(os.path.isfile, stores(harness, roots)))
    own = sum(map(os.path.isfile, stores(harness, roots)))
    return own + (harness == "opencode" and _any(_opencode_infos(home), filled(V, "id").isNotNull()))


def _states(spark: SparkSession, state: list[tuple[str, str]], files_of: dict[str, int], lost: DataFrame) -> DataFrame:
    base = spark.createDataFrame([(h, s, files_of.get(h)) for h, s in state], "harness string, state string, files long")
    counted = base.join(lost.groupBy("harness").agg(F.count("*").alias("lost")), "harness", "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
    now = F.when(F.col("lost") == 0, F.col("state")).when(F.col("lost") >= F.col("files"), "failed").otherwise("partial")
    return counted.select("harness", now.alias("state"), "lost")


def _with_project(atoms: logs.Atoms) -> DataFrame:
    if atoms.meta is None:
        return atoms.usage.withColumn("project", F.lit("(unknown)"))
    folders = atoms.meta.groupBy("session").agg(F.min("cwd").alias("cwd"))
    joined = atoms.usage.join(folders, "session", "left")
    return joined.withColumn("project", F.coalesce(base_name(F.col("cwd")), F.lit("(unknown)")))

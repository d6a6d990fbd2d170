"""Where logs are: homes, roots, marks of a format, and the registry of harnesses."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import largest_copies

#: harness: (folder under the home, file pattern, where its tokens are counted)
REGISTRY = {
    "claude_code": (".claude/projects", "*.jsonl", "message"),
    "codex": (".codex/sessions", "rollout-*.jsonl", "event"),
    "grok": (".grok", "unified.jsonl", "inference"),
    "pi": (".pi/agent/sessions", "*.jsonl", "message"),
    "openclaw": (".openclaw/agents", "*.jsonl", "message"),
    "opencode": (".local/share/opencode", "opencode*.db", "session"),
    "hermes": (".hermes", "state.db", "session"),
    "copilot": (".copilot", "session-store.db", "event"),
    "gemini": (".gemini/tmp", "*.json", "message"),
}


def home(harness: str, env: Mapping[str, str], override: str, vendor: str | None = None) -> str:
    """The folder of a harness: our override, then the vendor's own variable, then the usual place."""
    for name in (override, vendor):
        if name and env.get(name):
            return env[name]
    return os.path.join(env.get("HOME", "/"), REGISTRY[harness][0])


def roots(env: Mapping[str, str], override: str = "LEDGER_CLAUDE_DIR", vendor: str = "CLAUDE_CONFIG_DIR", exists=os.path.exists) -> list[str]:
    """Transcript roots that exist, without repeats: the override alone, else the configured folders and the usual ones."""
    if env.get(override):
        return [p for p in [env[override]] if exists(p)]
    given = [os.path.join(p.strip(), "projects") for p in env.get(vendor, "").split(",") if p.strip()]
    base = env.get("HOME", "/")
    usual = [os.path.join(env.get("XDG_CONFIG_HOME", os.path.join(base, ".config")), "claude", "projects")]
    if env.get("APPDATA"):
        usual.append(os.path.join(env["APPDATA"], "claude", "projects"))
    usual.append(os.path.join(base, ".claude", "projects"))
    return [p for p in dict.fromkeys([*given, *usual]) if exists(p)]


def opencode_stores(root: str) -> list[str]:
    """The databases of a home: the main one, then those of channels by name."""
    names = sorted(os.listdir(root)) if os.path.isdir(root) else []
    main = [n for n in names if n == "opencode.db"]
    return [os.path.join(root, n) for n in [*main, *(n for n in names if n not in main and re.fullmatch(r"opencode-[a-zA-Z0-9._-]+\.db", n))]]


def unique_transcripts(found: DataFrame) -> DataFrame:
    """Files under several roots by the same name: the largest copy; subagent files are never merged by name."""
    sub = F.contains("path", F.lit("/subagents/"))
    placed = found.withColumn("ord", F.col("path"))
    own = largest_copies(placed.where(~sub).select("name", "size", "ord", "path")).select("path")
    return found.join(own.unionByName(found.where(sub).select("path")), "path", "left_semi")


def has_mark(found: DataFrame, mark: str) -> bool:
    """Whether any file says that it is of the format, by a text in it; without it nothing of that harness is read."""
    return bool(found.where(F.contains("value", F.lit(mark))).limit(1).count())


def legacy_counts(listing: DataFrame) -> DataFrame:
    """Files of formats that are counted but never parsed: JSON objects up to one folder deep, old transcripts."""
    path = F.col("path")
    kind = F.when(path.rlike(r"/opencode/(project|session)/([^/]+/)?[^/]+\.json$"), "opencode").when(path.rlike(r"/\.hermes/sessions/[^/]+\.jsonl$"), "hermes")
    return listing.select(kind.alias("harness")).where("harness is not null").groupBy("harness").agg(F.count("*").alias("files"))


def preferred_store(paths: list[str], exists=os.path.isfile) -> str | None:
    """The first store that is there; stores of one harness are never merged."""
    return next((p for p in paths if exists(p)), None)

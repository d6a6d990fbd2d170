"""What leaves the engine: wire rows, digests, rate snapshots, and the state of past uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that may leave; anything else, paths and contexts first of all, stays.
WIRE_FIELDS = (
    "session", "tool", "harness", "model", "models", "input", "output", "cache_read", "cache_creation", "messages", "turns", "longest_loop_ms",
    "started_at", "ended_at", "active_ms", "idle_ms", "wall_ms", "entry_point", "thinking_tokens", "skills", "agents", "days", "mue", "org_repo", "outcomes", "parser_epoch",
)


def wire(sessions: DataFrame) -> DataFrame:
    """``session, payload``: absent fields are dropped, but ``repo_hash`` is stated even when it is null."""
    kept = [c for c in WIRE_FIELDS if c in sessions.columns]
    payload = F.to_json(F.struct(*kept))
    if "repo_hash" in sessions.columns:
        said = F.coalesce(F.to_json(F.struct("repo_hash"), {"ignoreNullFields": "false"}), F.lit("{}"))
        payload = F.concat(F.regexp_replace(payload, r"\}$", ""), F.when(payload == "{}", "").otherwise(","), F.substr(said, F.lit(2)))
    return sessions.select("session", payload.alias("payload"))


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.sha2("payload", 256))


def write_view(view: DataFrame, path: str, costs: bool = False) -> None:
    """A view as JSON lines; cost columns only on request."""
    hidden = () if costs else ("cost_usd", "partial")
    view.drop(*hidden).write.mode("overwrite").json(path)


def write_rates(snapshot: DataFrame, path: str) -> None:
    """A day's rates into the history, partitioned by ``day``; writing a day again replaces that day alone."""
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

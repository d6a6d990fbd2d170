"""SQLite stores as DataFrames, and the harnesses that keep them.

``SqliteSource`` is a Python data source: a partition for every ``RANGE`` row numbers of a table, opened read-only, with the columns named in the
schema and no others. A missing file, or one without the asked columns, gives no rows rather than an error. A range that cannot be read to its
end fails the query. A store counts whole or not at all: ``whole_stores`` reads all of them for their errors first, leaves out those that have any,
and says which ones those are. Files must be on a path that every executor sees.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import model_of_json
from ..operators.joins import overlay
from .lines import millis, parsed
from .logs import Atoms

V = "v"


#: Row numbers of a partition.
RANGE = 200_000


class _Range(InputPartition):
    def __init__(self, path: str, first: int | None = None, end: int | None = None):
        self.path, self.first, self.end = path, first, end


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.names
        self.table = options["table"]
        self.range = int(options.get("range", RANGE))
        self.errors = options.get("errors") == "only"  # rows for what cannot be read, and no others
        self.paths = [p for p in options["paths"].split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        return [r for p in self.paths for r in self._ranges(p)] or [_Range("")]

    def _ranges(self, path: str) -> list[_Range]:
        """Ranges of row numbers; the whole table where it has none, or where they cannot be asked for."""
        if not os.path.isfile(path):
            return []
        db = _opened(path)
        try:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        except sqlite3.DatabaseError:
            return [_Range(path)]
        finally:
            db.close()
        if not isinstance(low, int) or not isinstance(high, int):
            return [_Range(path)]
        return [_Range(path, at, at + self.range) for at in range(low, high + 1, self.range)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not os.path.isfile(partition.path):
            return
        db = _opened(partition.path)
        asked = [c for c in self.columns if c not in ("db_path", "db_error")]
        try:
            have = {row[1] for row in db.execute(f'PRAGMA table_info("{self.table}")')}
            if not set(asked) <= have:
                return
            chosen = ", ".join(f'CAST("{c}" AS TEXT), typeof("{c}")' for c in asked)
            where, given = ("", ()) if partition.first is None else (" WHERE rowid >= ? AND rowid < ?", (partition.first, partition.end))
            for row in db.execute(f'SELECT {chosen} FROM "{self.table}"{where}', given):
                if not self.errors:
                    yield self._typed(row, partition.path)
        except sqlite3.DatabaseError as e:
            if not self.errors:
                raise
            yield tuple({"db_path": partition.path, "db_error": str(e)}.get(c) for c in self.columns)
        finally:
            db.close()

    def _typed(self, row: tuple, path: str) -> tuple:
        """Values with their storage class, so that a text is never taken for a number."""
        out, at = [], 0
        for c in self.columns:
            if c in ("db_path", "db_error"):
                out.append(path if c == "db_path" else None)
            else:
                out.append({"text": row[at], "kind": row[at + 1]})
                at += 2
        return tuple(out)


class SqliteSource(DataSource):
    """``format("sqlite_table")`` with options ``table`` and ``paths`` (one a line)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("state the columns to read with .schema()")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_table(spark: SparkSession, paths: list[str], table: str, columns: list[str], errors: bool = False) -> DataFrame:
    """``db_path`` and the columns, each as a struct of its text and storage class; with ``errors`` a row for what cannot be read, with ``db_error``."""
    spark.dataSource.register(SqliteSource)
    schema = "db_path string, db_error string, " + ", ".join(f"`{c}` struct<text:string,kind:string>" for c in columns)
    found = spark.read.format("sqlite_table").schema(schema).option("table", table).option("paths", "\n".join(paths))
    return found.option("errors", "only").load() if errors else found.load().drop("db_error")


def whole_stores(spark: SparkSession, paths: list[str], tables: dict[str, list[str]]) -> tuple[list[DataFrame], DataFrame]:
    """The tables of those stores that can be read to their end, and the ``path`` and ``reason`` of the others, at most a row a store."""
    errors = reduce(lambda a, b: a.unionByName(b), (read_table(spark, paths, t, c, True).select("db_path", "db_error") for t, c in tables.items()))
    lost = {r["db_path"]: r["db_error"] for r in errors.collect()}
    good = [p for p in paths if p not in lost]
    return [read_table(spark, good, t, c) for t, c in tables.items()], spark.createDataFrame(sorted(lost.items()), "path string, reason string")


def _health(rows: DataFrame, good: Column, lost: DataFrame) -> DataFrame:
    """Rows that cannot be used, and a bad one for every store that cannot be read."""
    return rows.select(F.col("db_path").alias("path"), (~good).alias("bad")).unionByName(lost.select("path", F.lit(True).alias("bad")))


def real(c: str):
    """A stored number; null for texts and blobs."""
    return F.when(F.col(f"{c}.kind").isin("integer", "real"), F.col(f"{c}.text").cast("double"))


def whole(c: str):
    return F.greatest(F.coalesce(real(c), F.lit(0.0)), F.lit(0.0)).cast("long")


def words(c: str):
    return F.when(F.col(f"{c}.kind") == "text", F.nullif(F.col(f"{c}.text"), F.lit("")))


def hermes(spark: SparkSession, paths: list[str]) -> Atoms:
    """Tokens per session; times in seconds; messages give activity, without them start and end do."""
    columns = ["id", "source", "model", "started_at", "ended_at", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "cwd"]
    (rows, messages), lost = whole_stores(spark, paths, {"sessions": columns, "messages": ["session_id", "role", "timestamp"]})
    good = words("id").isNotNull() & real("started_at").isNotNull() & real("input_tokens").isNotNull() & real("output_tokens").isNotNull()
    start, end = (real("started_at") * 1000).cast("long"), (real("ended_at") * 1000).cast("long")
    usage = rows.where(good).select(
        words("id").alias("session"), F.struct(F.col("db_path").alias("path"), words("id").alias("line_no")).alias("ord"), start.alias("ts"), F.coalesce(words("model"), F.lit("unknown")).alias("model"),
        whole("input_tokens").alias("input"), whole("output_tokens").alias("output"), whole("cache_read_tokens").alias("cache_read"), whole("cache_write_tokens").alias("cache_creation"), whole("reasoning_tokens").alias("thinking"),
    )
    meta = rows.where(good).select(words("id").alias("session"), words("cwd").alias("cwd"), words("source").alias("source"), start.alias("started_at"), end.alias("ended_at"))
    told = messages.select(words("session_id").alias("session"), (real("timestamp") * 1000).cast("long").alias("ts"), F.coalesce(words("role") == "user", F.lit(False)).alias("is_prompt")).where("session is not null and ts is not null")
    silent = meta.join(told.select("session").distinct(), "session", "left_anti").select("session", F.explode(F.array_distinct(F.array_compact(F.array("started_at", "ended_at")))).alias("ts"), F.lit(False).alias("is_prompt"))
    return Atoms(usage, told.unionByName(silent), _health(rows, good, lost), meta=meta, lost=lost)


def opencode(spark: SparkSession, paths: list[str]) -> Atoms:
    """Tokens per session over any number of databases; the model is a small JSON object; sessions without tokens go."""
    counts = ["tokens_input", "tokens_output", "tokens_reasoning", "tokens_cache_read", "tokens_cache_write"]
    (rows, messages), lost = whole_stores(spark, paths, {"session": ["id", "directory", "model", *counts, "time_created", "time_updated"], "message": ["session_id", "time_created"]})
    good = words("id").isNotNull()
    for c in counts:
        good = good & real(c).isNotNull()
    model = F.coalesce(model_of_json(words("model")), F.lit("unknown"))
    usage = rows.where(good).select(
        words("id").alias("session"), F.struct(F.col("db_path").alias("path"), words("id").alias("line_no")).alias("ord"), real("time_created").cast("long").alias("ts"), model.alias("model"),
        whole("tokens_input").alias("input"), whole("tokens_output").alias("output"), whole("tokens_cache_read").alias("cache_read"), whole("tokens_cache_write").alias("cache_creation"), whole("tokens_reasoning").alias("thinking"),
    ).where("input + output + cache_read + cache_creation + thinking > 0")
    meta = rows.where(good).select(words("id").alias("session"), words("directory").alias("cwd"), real("time_created").cast("long").alias("created"))
    told = messages.select(words("session_id").alias("session"), real("time_created").cast("long").alias("ts"), F.lit(False).alias("is_prompt")).where("session is not null and ts is not null")
    silent = meta.join(told.select("session").distinct(), "session", "left_anti").where("created is not null").select("session", F.col("created").alias("ts"), F.lit(False).alias("is_prompt"))
    return Atoms(usage, told.unionByName(silent), _health(rows, good, lost), meta=meta, lost=lost)


def opencode_overlaid(files: Atoms, stored: Atoms) -> Atoms:
    """Both stores of one harness: a session kept as files replaces the one of that id in the database."""
    own = files.usage.select("session").distinct()
    keep = lambda a, b: a.unionByName(b.join(own, "session", "left_anti"), allowMissingColumns=True)
    usage = keep(files.usage.withColumn("ord", F.to_json("ord")), stored.usage.withColumn("ord", F.to_json("ord")))
    return Atoms(usage, keep(files.events, stored.events), files.health.unionByName(stored.health), meta=overlay(stored.meta.select("session", "cwd"), files.meta.select("session", "cwd").dropDuplicates(["session"]), "session"), lost=stored.lost)


def copilot_store(spark: SparkSession, paths: list[str]) -> Atoms:
    """Usage events with ISO times."""
    columns = ["session_id", "turn_index", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "created_at"]
    (rows, heads), lost = whole_stores(spark, paths, {"assistant_usage_events": columns, "sessions": ["id", "cwd"]})
    stamp = millis(words("created_at"))
    good = F.coalesce(words("session_id").isNotNull() & stamp.isNotNull() & real("input_tokens").isNotNull() & real("output_tokens").isNotNull(), F.lit(False))
    usage = rows.where(good).select(
        words("session_id").alias("session"), F.struct(F.col("db_path").alias("path"), real("turn_index").cast("long").alias("line_no")).alias("ord"), stamp.alias("ts"), F.coalesce(words("model"), F.lit("unknown")).alias("model"),
        whole("input_tokens").alias("input"), whole("output_tokens").alias("output"), whole("cache_read_tokens").alias("cache_read"), whole("cache_write_tokens").alias("cache_creation"), whole("reasoning_tokens").alias("thinking"),
    )
    meta = heads.select(words("id").alias("session"), words("cwd").alias("cwd")).where("session is not null and cwd is not null")
    return Atoms(usage, usage.select("session", "ts", F.lit(False).alias("is_prompt")), _health(rows, good, lost), meta=meta, lost=lost)


def copilot_traces(spark: SparkSession, paths: list[str]) -> Atoms:
    """Spans with nanosecond times; counts are attributes; the session is a column, else an attribute."""
    (spans,), lost = whole_stores(spark, paths, {"spans": ["session_id", "start_time_unix_nano", "attributes"]})
    rows = parsed(spans.withColumn("text", F.col("attributes.text")), "text")
    attr = lambda kind, name: _attr(kind, V, name)
    session = F.coalesce(words("session_id"), attr("text", "copilot.session.id"))
    nanos = F.when(F.col("start_time_unix_nano.kind") == "integer", F.col("start_time_unix_nano.text").cast("long"))
    stamp = F.call_function("div", nanos, F.lit(1_000_000).cast("long"))  # a quotient of doubles would be off by a millisecond
    given, made = attr("number", "gen_ai.usage.input_tokens"), attr("number", "gen_ai.usage.output_tokens")
    good = F.coalesce(session.isNotNull() & stamp.isNotNull() & given.isNotNull() & made.isNotNull(), F.lit(False))
    n = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)).cast("long")
    model = F.coalesce(attr("text", "gen_ai.request.model"), F.lit("unknown"))
    usage = rows.where(good).select(
        session.alias("session"), F.struct(F.col("db_path").alias("path"), stamp.alias("line_no")).alias("ord"), stamp.alias("ts"), model.alias("model"), n(given).alias("input"), n(made).alias("output"),
        n(attr("number", "gen_ai.usage.cache_read_tokens")).alias("cache_read"), n(attr("number", "gen_ai.usage.cache_write_tokens")).alias("cache_creation"), n(attr("number", "gen_ai.usage.reasoning_tokens")).alias("thinking"),
    )
    return Atoms(usage, usage.select("session", "ts", F.lit(False).alias("is_prompt")), _health(rows, good, lost), lost=lost)


def _attr(kind: str, v, name: str):
    """An attribute whose name holds dots."""
    path = f"$['{name}']"
    held = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    if kind == "number":
        return F.when(held.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, "double"))
    return F.when(held == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def copilot(spark: SparkSession, traces: list[str], stores: list[str]) -> Atoms:
    """Traces if there is such a store, else the session store; never both."""
    return copilot_traces(spark, traces) if any(os.path.isfile(p) for p in traces) else copilot_store(spark, stores)

"""Queries that run a stream over the events table to its end and return what came out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder
from ..streaming import incremental, stateful
from . import bindings
from .bindings import sql
from .session_plans import ORACLE as SESSION_ORACLE

QUERIES: dict = {}
ORACLE: dict = {}
_WINDOW = 5 * 3600 * 1000


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a file stream, projected as usage."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return bindings.project(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def finished(spark: SparkSession, stream: DataFrame, mode: str, schema: str) -> DataFrame:
    """All rows that a stream puts out until its input is used up."""
    root = folder(spark)
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out").drop("batch")


@query("t12_block_stream", SESSION_ORACLE["w8_current_block"])
def block_stream(spark, d):
    total = sum((F.col(c) for c in ("output", "cache_read", "cache_creation")), F.col("input"))
    stream = stateful.block_stream(event_stream(spark, d).select("session", "ts", total.alias("total")), "session", _WINDOW)
    return finished(spark, stream, "update", stream.schema)


@query("t2_sync_stream", sql("SELECT CAST(session AS VARCHAR) AS session, CAST(CAST(sum(input + output) AS BIGINT) AS VARCHAR) AS payload FROM usage GROUP BY session", "usage"))
def sync_stream(spark, d):
    """The events in four batches, with sessions across all of them; of what was sent the last of each session counts."""
    root = folder(spark)
    rows = bindings.usage(spark, d).select(F.col("session").cast("string").alias("session"), (F.col("input") + F.col("output")).alias("n"), "ord")
    each = spark.sparkContext.defaultParallelism  # files of a batch, so that no batch is one task's
    rows.repartitionByRange(4 * each, "ord").write.option("maxRecordsPerFile", 0).parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{root}/in")
    atoms = incremental.StateTable(spark, f"{root}/state", "atoms", "session string, n long", history=True)
    digests = incremental.StateTable(spark, f"{root}/state", "digests", "session string, digest string")
    fold = lambda b: b.groupBy("session").agg(F.sum("n").cast("string").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    send = lambda rows, n: rows.select("session", "payload").write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    incremental.sync_stream(stream, atoms, digests, fold, send, f"{root}/checkpoint").awaitTermination()
    sent = spark.read.schema("session string, payload string, batch long").parquet(f"{root}/out")
    return sent.groupBy("session").agg(F.max_by("payload", "batch").alias("payload"))


@query("t3_watermark", sql("SELECT harness AS store, max(ts) AS ts FROM usage GROUP BY harness", "usage"))
def watermark(spark, d):
    table = incremental.StateTable(spark, folder(spark), "watermarks", "store string, ts long")
    rows = bindings.usage(spark, d).select(F.col("harness").alias("store"), "ts")
    for late in (rows, rows.where("ts % 2 = 0")):
        incremental.advance_watermark(table, late)
    return table.read()

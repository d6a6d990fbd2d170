"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` excludes it.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows``: Spark bounds what comes at once by bytes, this the Python objects made of it."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: The folder of tables that go together, of each thread its own.
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside by this thread go at the end, but for those that are ``kept``."""
    before = _SCOPE.set(f"{_SCOPE.get()}{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        discard(spark, f"{shared_dir(spark)}/{_SCOPE.get()}")
        _SCOPE.reset(before)


def cut(df: DataFrame, kept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends and lost executors lose nothing.

    The shuffle files of that write go with it, since what comes after reads the table.
    """
    return cut_to(df, kept)[0]


def cut_to(df: DataFrame, kept: bool = False) -> tuple[DataFrame, str]:
    """``cut``, and where the table is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{'' if kept else _SCOPE.get()}{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def word_count(text: Column) -> Column:
    """Number of words of a text column (null: 0), as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the columns ``names`` of two frames."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def running_totals(df: DataFrame, group: list[str], order: list, shard: str, values: dict[str, str], facts: DataFrame | None = None) -> DataFrame:
    """``df`` with, for each new column of ``values``, the sum of a column over the rows of its group that come before.

    Rows of a group are ordered by ``shard``, then ``order``; ``shard`` is a column that deals the rows of even one
    large group over many values. Sums per shard, at most groups times shards of them, are added up first, so that
    no task ever holds a group. ``facts`` (a row per group) adds its columns on the way. ``df`` is read twice: cut it
    before if it is costly.
    """
    own = [*group, shard]
    sums = df.groupBy(*own).agg(*(F.sum(v).alias(n) for n, v in values.items()))
    before = W.partitionBy(*group).orderBy(shard).rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(*own, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in values))
    more = [c for c in facts.columns if c not in group] if facts is not None else []
    if facts is not None:
        bases = bases.join(facts, same(bases, facts, group)).select(bases["*"], *(facts[c] for c in more))
    joined = df.join(bases, same(df, bases, own)).select(df["*"], *(bases[c] for c in [*(f"_{n}" for n in values), *more]))
    inside = W.partitionBy(*own).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = joined.select("*", *((F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_{n}")).alias(n) for n, v in values.items()))
    return found.drop(*(f"_{n}" for n in values))


def map_columns(df: DataFrame, fn: Callable[..., dict], schema) -> DataFrame:
    """Apply ``fn`` to the columns of each Arrow batch (as Python lists); it returns the output columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = fn(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b`` (longs), ``root`` being the least node that it reaches.

    Rounds of two steps, large stars and small stars, each an aggregate and a join; every round is cut. Stars grow
    until a round changes nothing; a hot centre is only ever aggregated in part first or split by a skew join.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = held = None
    while True:
        edges, path = cut_to(edges)
        if held:
            discard(edges.sparkSession, held)  # the round before
        held = path
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        seen = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()

"""Log files as rows, and typed access to their JSON.

Files of lines are read in splits of any size: a line's number is its split's place in the file and its place in the split, which is
their order in the file. Files that are one object come in whole; such a file must fit a task. Unreadable files give no rows.
Paths may be anything that Spark reads. JSON is parsed to ``variant``: a field of another type than asked for is null,
never converted.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _reader(spark: SparkSession, glob: str | None, since: str | None):
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.option("modifiedAfter", since) if since else reader


def text_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None, since: str | None = None) -> DataFrame:
    """``path, name, size, mtime_ms, line_no, line`` of the lines of the files under ``paths``, blank ones included."""
    df = _reader(spark, glob, since).text(paths, lineSep="\n")
    m = F.col("_metadata")
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # rises in a split
    place = F.shiftleft(F.shiftright(m["file_block_start"], 20), 33).bitwiseOR(inside)  # splits are 4 MB apart at least
    return df.select(m["file_path"].alias("path"), m["file_name"].alias("name"), m["file_size"].alias("size"), F.unix_millis(m["file_modification_time"]).alias("mtime_ms"), place.alias("line_no"), F.col("value").alias("line"))


def files(spark: SparkSession, paths: str | list[str], glob: str | None = None, since: str | None = None) -> DataFrame:
    """``path, name, size, mtime_ms, value`` of the files under ``paths``; ``since`` leaves files unread that have not changed after it."""
    df = _reader(spark, glob, since).text(paths, wholetext=True)
    m = F.col("_metadata")
    return df.select(m["file_path"].alias("path"), m["file_name"].alias("name"), m["file_size"].alias("size"), F.unix_millis(m["file_modification_time"]).alias("mtime_ms"), "value")


class Home:
    """The files under a harness's homes: each set of names is listed once, for its gate and for all of its readers (a listing is a task a folder)."""

    def __init__(self, spark: SparkSession, roots: str | list[str]):
        self.spark, self.roots = spark, roots
        self.held: dict[tuple, DataFrame] = {}

    def _once(self, read: Callable, glob: str) -> DataFrame:
        if (read, glob) not in self.held:
            self.held[read, glob] = read(self.spark, self.roots, glob)
        return self.held[read, glob]

    def lines(self, glob: str) -> DataFrame:
        """``text_lines`` of the files of such names."""
        return self._once(text_lines, glob)

    def files(self, glob: str) -> DataFrame:
        """``files`` of such names."""
        return self._once(files, glob)


def lines(found: DataFrame, contains: str | None = None) -> DataFrame:
    """``path, name, mtime_ms, line_no, line`` of the non-blank lines of ``files`` or ``text_lines``; ``contains`` drops lines before they are parsed."""
    if "line" in found.columns:
        rows = found.select("path", "name", "mtime_ms", "line_no", "line")
    else:
        rows = found.select("path", "name", "mtime_ms", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\n\x0b\f\r"))).where("line <> ''")  # a pattern would look at every character of a line, three times
    return rows.where(F.contains("line", F.lit(contains))) if contains else rows


def parsed(rows: DataFrame, column: str = "line") -> DataFrame:
    """``rows`` with ``v``: the parsed JSON, null where it is none."""
    return rows.withColumn("v", F.try_parse_json(column))


def raw(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def number(v: Column, path: str) -> Column:
    """A JSON number as double; null for anything else, numeric strings included.

    As a function over an array of one: Spark then compiles a projection of many fields in parts. As one method it would be too large for the JVM, which
    interprets such methods, at ten times the cost.
    """
    kept = lambda x: F.when(F.schema_of_variant(x).rlike(_NUMBER), F.try_variant_get(x, "$", "double"))
    return F.get(F.transform(F.array(raw(v, path)), kept), F.lit(0))


def count(v: Column, path: str) -> Column:
    """A non-negative whole count; 0 where there is no number."""
    return F.greatest(F.coalesce(number(v, path), F.lit(0.0)), F.lit(0.0)).cast("long")


def string(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(raw(v, path)) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))


def filled(v: Column, path: str) -> Column:
    """A non-empty string, or null."""
    return F.nullif(string(v, path), F.lit(""))


def boolean(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(raw(v, path)) == "BOOLEAN", F.try_variant_get(v, f"$.{path}", "boolean"))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(raw(v, path)), F.lit("OBJECT")), F.lit(False))


def array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "array<variant>")


def millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO time, null if it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def stem(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def beside(folders: DataFrame, name: str) -> DataFrame:
    """``folder, value``: the trimmed text of the small file ``name`` in each folder (``folder``), null without one.

    Hidden files are none to Spark's readers; each task opens them itself, so folders must be where every executor sees them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for folder in b.column(0).to_pylist():
                path = os.path.join(unquote(urlsplit(folder).path) if folder.startswith("file:") else folder, name)
                try:
                    with open(path, encoding="utf-8", errors="replace") as f:
                        found.append(f.read().strip() or None)
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["folder", "value"])

    return folders.select("folder").mapInArrow(run, "folder string, value string")

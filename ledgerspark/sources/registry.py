"""The sources by harness, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts under one schema, each row tagged with its ``harness``."""
    tagged = [df.withColumn("harness", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

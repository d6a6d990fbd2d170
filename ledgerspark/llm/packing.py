"""Packing: optimal length buckets and token-budget batches.

A document becomes sequences of at most ``max_len`` words, the model's context: all whole but the last, nothing dropped.
A global histogram counts the sequences of each length; it has at most ``max_len`` entries, whatever the corpus, so
the driver can choose from it, by dynamic programming, the ``buckets`` boundaries with the least padding. A sequence is
padded to the smallest boundary that holds it. Inside a bucket the sequences, in a pseudo-random order, fill
batches of ``budget // boundary`` (at least one) sequences each, so that a batch never has more than ``budget`` tokens
where one sequence fits.

Ranks inside a bucket are running totals over shards, so a bucket that holds a third of all sequences is no one task's.

Defined cases: a null text and a text without words make one sequence of length 0, in no bucket and no batch. Fewer distinct
lengths than buckets: a bucket for each length. Equal doc_ids, nulls included, are ordered by piece and length; rows
that agree in all of that may change slots. Of several optimal boundary sets the one with the smallest last differing
boundary is taken. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, running_totals, table, word_count

MAX_LEN, BUCKETS, BUDGET = 2048, 8, 65536
SHARD_DIGITS = 3  # hexadecimal: 4096 shards a bucket


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries, taken from the lengths, that minimise the padding of the histogram."""
    if not lengths:
        return []
    order = np.argsort(lengths)
    size = np.array(lengths, np.int64)[order]
    upto = np.concatenate(([0], np.cumsum(np.array(counts, np.int64)[order])))
    n = len(size)
    # cost[i, j]: padded tokens of the lengths i to j in one bucket, whose boundary is length j
    cost = size[None, :] * (upto[None, 1:] - upto[:n, None])
    cost = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], cost, np.iinfo(np.int64).max // 4)
    best, cuts = cost[0], []
    for _ in range(min(buckets, n) - 1):
        total = np.concatenate(([0], best[:-1]))[:, None] + cost
        total[0] = cost[0]
        cuts.append(total.argmin(0))
        best = total.min(0)
    found, j = [], n - 1
    for first in reversed(cuts):
        found.append(j)
        if first[j] == 0:
            return [int(size[k]) for k in reversed(found)]
        j = int(first[j]) - 1
    return [int(size[k]) for k in reversed([*found, j])]


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, size: Callable[[Column], Column] = word_count) -> DataFrame:
    """``doc_id, piece, start, length, bucket, batch, slot`` for each sequence; ``start`` counts words of the document."""
    sized = cut(docs.select("doc_id", size(F.col("text")).alias("size")))
    last = F.greatest(F.ceil(F.col("size") / max_len), F.lit(1)) - 1
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")))
    pieces = (
        sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * max_len).alias("start"), F.least(F.col("size") - F.col("piece") * max_len, F.lit(max_len)).alias("length"))
        .select("*", digest.alias("digest"), F.lit(1).cast("long").alias("one"))
        .withColumn("shard", F.substring("digest", 1, SHARD_DIGITS))
    )
    histogram = pieces.where("length > 0").groupBy("length").count().collect()  # at most max_len rows
    bounds = best_boundaries([r["length"] for r in histogram], [r["count"] for r in histogram], buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("length") <= b, F.lit(b).cast("long")).otherwise(bucket)
    dealt = pieces.withColumn("bucket", F.when(F.col("length") > 0, bucket))
    ranked = running_totals(dealt, ["bucket"], ["digest", F.col("doc_id").asc_nulls_last(), "piece", "length"], "shard", {"rank": "one"})
    per = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    return ranked.select(
        "doc_id", "piece", "start", "length", "bucket",
        F.when(F.col("bucket").isNotNull(), F.floor(F.col("rank") / per)).alias("batch"),
        F.when(F.col("bucket").isNotNull(), F.col("rank") % per).alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences in batches."""
    return pack(table(spark, sf_dir, "documents"))


def _levels() -> str:
    """The dynamic programme as one table expression per bucket, and the way back through them."""
    out = ["d0 AS (SELECT j, length * upto AS c, 1::BIGINT AS i FROM h)"]
    for k in range(1, BUCKETS):
        out.append(
            f"""d{k} AS (SELECT j, best.c AS c, best.i AS i FROM (
  SELECT b.j, min(struct_pack(c := coalesce(p.c, 0) + b.length * (b.upto - coalesce(a.upto, 0)), i := s.j)) AS best
  FROM h b JOIN h s ON s.j <= b.j LEFT JOIN h a ON a.j = s.j - 1 LEFT JOIN d{k - 1} p ON p.j = s.j - 1 GROUP BY b.j))"""
        )
    out.append(f"p{BUCKETS - 1} AS (SELECT j, i FROM d{BUCKETS - 1} WHERE j = (SELECT max(j) FROM h))")
    out += [f"p{k} AS (SELECT d.j, d.i FROM d{k} d JOIN p{k + 1} q ON d.j = q.i - 1 WHERE q.i > 1)" for k in range(BUCKETS - 2, -1, -1)]
    return ",\n".join(out)


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
pieces AS (
  SELECT doc_id, piece, piece * {MAX_LEN} AS start, least(size - piece * {MAX_LEN}, {MAX_LEN}) AS length,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || piece) AS digest
  FROM (SELECT doc_id, size, unnest(range(greatest((size + {MAX_LEN - 1}) // {MAX_LEN}, 1))) AS piece FROM sized)),
h AS (
  SELECT length, row_number() OVER (ORDER BY length) AS j, CAST(sum(n) OVER (ORDER BY length) AS BIGINT) AS upto
  FROM (SELECT length, count(*) AS n FROM pieces WHERE length > 0 GROUP BY length)),
{_levels()},
bounds AS (SELECT h.length AS bound FROM h JOIN ({' UNION ALL '.join(f'SELECT j FROM p{k}' for k in range(BUCKETS))}) USING (j)),
dealt AS (
  SELECT *, CASE WHEN length > 0 THEN (SELECT min(bound) FROM bounds WHERE bound >= length) END AS bucket FROM pieces),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY digest, doc_id NULLS LAST, piece, length) - 1 AS rank,
         greatest({BUDGET} // bucket, 1) AS per
  FROM dealt)
SELECT doc_id, piece, start, length, bucket,
       CASE WHEN bucket IS NOT NULL THEN rank // per END AS batch, CASE WHEN bucket IS NOT NULL THEN rank % per END AS slot
FROM ranked
"""

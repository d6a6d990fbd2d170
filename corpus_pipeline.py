"""From raw documents to training batches: filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; what it returns is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``:

1. quality: documents that the discriminant scores under 0.5 go.
2. near_duplicates: of each group of linked fingerprints the document with the least doc_id stays.
3. repeats: byte strings of 100 or more that also start earlier are cut out of the texts.
4. mixture: a row for each time a document is taken, in training order.
5. batches: sequences with their bucket, batch and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import mixing, packing, quality, simhash, suffix_dedup
from ledgerspark.llm.common import shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixture", mix_sources),
    ("batches", pack_batches),
]

#: Shingle digests, content-defined suffixes and the choice of boundaries have no SQL form here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

"""Corpus pipeline over ``documents``: quality filter, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes the documents that the one before it kept, as a Parquet table, and all but the last
return the columns of ``documents``:

1. ``quality``: documents that the factorisation machine scores below 0.5 go.
2. ``near_duplicates``: of each class of texts with a Jaccard similarity of 0.8 or more, on runs of five
   words, the document of the least doc_id stays.
3. ``decontamination``: documents in which a benchmark item is found go.
4. ``mixing``: documents become what the mix takes of them, a row for each epoch that takes any; sources
   approach their targets. Documents of which the mix takes nothing go.
5. ``sharding``: every row, with its text, gets a shard, a slot in it, and its digest columns.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns are handled as
the operators document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transitloom.llm import decontamination as benchmark
from transitloom.llm import jaccard_join
from transitloom.llm import mixing as mixes
from transitloom.llm import quality as classifier
from transitloom.llm import sharding as shards
from transitloom.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.accepted(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixes.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the digest columns, and the other columns of the documents that are not named like those."""
    added = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in docs.columns if c.lower() not in (*added, "law", "grown_shard")]
    placed = shards.shard(docs.select(*kept), added=added)
    return shards.digest(placed, *(c for c in kept if c.lower() != "doc_id"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier and MinHash classes cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 of the normalised text. New data
is grouped by digest (combined before the shuffle), what the index does not yet hold is found by a
sort-merge anti-join and appended, and the rows then look their digest up. An index has as many buckets as it
needs for the rows that are expected, and ``compact`` writes it anew, a sorted file a bucket, when batches have made more files or
outgrown the buckets. A batch that failed is added again under its name. One writer at a time: two that add at once could both append a digest.

Texts are equal when identical after lower-casing A-Z only. A null text counts as empty, and empty
texts are equal to each other. Of equal texts within one batch the row with the largest doc_id
stays (a null doc_id is smaller than any); of rows that tie on that, exactly one. A digest that an
earlier batch has brought makes every row of a later batch a copy of the row kept then. Any other
columns of the input are ignored, whatever their names. An empty batch gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, new_path, table, written

#: Fewest buckets, and digests in one that are enough for another.
BUCKETS, BUCKET_ROWS = 32, 4_000_000


def buckets_for(rows: int) -> int:
    """The next power of two that keeps buckets below ``BUCKET_ROWS``."""
    return max(BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())


def normalised_digest(text: str = "text"):
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).cast("binary"), 256))


class DigestIndex:
    """``digest binary, keep_id long, batch string``, bucketed and sorted by digest, at ``location``.

    Opening a location that already holds an index continues it; ``name`` is its table name.
    """

    def __init__(self, spark: SparkSession, location: str, name: str | None = None, buckets: int | None = None, expected_rows: int = 0):
        buckets = buckets or buckets_for(expected_rows)
        self.spark, self.location, self.buckets = spark, location, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def entries(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        (
            fresh.select("digest", "keep_id", "batch")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .option("path", self.location)
            .saveAsTable(self.name)
        )

    def compact(self, location: str) -> DigestIndex:
        """The same index at another location, one sorted file a bucket and buckets by its rows; this one stays until its owner clears it."""
        entries = self.entries()
        whole = DigestIndex(self.spark, location, expected_rows=entries.count())
        whole.append(entries)
        return whole

    def close(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicates ``docs(doc_id, text)`` against the index and within itself, appends what is new.

        batch names these rows. Adding a batch again, as after a failure at any point, appends what its first
        run did not and gives the answer that it gave or would have given; another batch must have another name. Without a
        name every call is a batch of its own.

        Returns one row per input row: doc_id, keep_id, group_size (equal rows in this batch), kept,
        digest.
        """
        batch = batch or uuid.uuid4().hex
        rows = written(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                normalised_digest().alias("digest"),
                F.monotonically_increasing_id().alias("row_no"),
            ),
            "digests",
        )
        groups = written(
            rows.groupBy("digest").agg(
                F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), "doc_id", "row_no")).alias("top"),
                F.count("*").alias("group_size"),
            ),
            "digest-groups",
        )
        fresh = written(
            groups.join(self.entries().hint("merge"), "digest", "left_anti").select(
                "digest", F.col("top.doc_id").alias("keep_id"), F.lit(batch).alias("batch")
            ),
            "digest-fresh",
        )
        self.append(fresh)
        settled = groups.join(self.entries().hint("merge"), "digest").select(
            "digest",
            "keep_id",
            "group_size",
            F.when(F.col("batch") == batch, F.col("top.row_no")).alias("keep_row"),
        )
        settled = written(settled, "digest-settled")
        return rows.join(settled.hint("merge"), "digest").select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"), "digest"
        )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = DigestIndex(spark, new_path(spark, "digest-index"), expected_rows=docs.count())
    found = index.add(docs, "documents")
    index.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE_SQL = {
    "op2_exact_dedup": f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept,
       h AS text_sha256
FROM d
"""
}

"""Merkle fixity audit of WARC replicas.

An archive is a run of records at ascending offsets. A record's leaf hashes its offset, length and
content digest; ``FANOUT`` neighbouring nodes make one node of the next level, over the range of offsets
they cover, up to one root per archive. Two replicas are compared from the roots down: at each level
only children of nodes that differ are joined, and only leaves below them are looked at, so intact
archives cost their root and a damaged record one path. All of it is DataFrame work, and the trees
are tables that can be kept: ``audit`` takes trees, not records.

Findings: ``altered`` (the record is at its place with another content), ``moved`` (same content, another
offset), ``missing`` and ``extra`` (in one replica only). Records are told apart by archive, record id and,
where an id repeats in an archive, its number there; records that agree in id and content are
interchangeable. Null contents count as empty, null ids as an id of their own. Replicas without
records have no trees and nothing to find. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

FANOUT = 16
#: Pages in one archive of the query.
PER_ARCHIVE = 1000


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def warc_record(uri: Column, body: Column) -> Column:
    """A WARC 1.1 response record of the body, as text."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "))
    return F.concat(head, F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """From ``(archive, record_id, content)``: records in the order of ids, with offsets, digests and leaf hashes.

    Only ids, lengths and digests are sorted, never contents.
    """
    content = F.coalesce(F.col("content"), F.lit("")).cast("binary")
    digests = records.select("archive", "record_id", F.octet_length(content).cast("long").alias("length"), _sha(content).alias("digest"))
    order = Window.partitionBy("archive").orderBy("record_id", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = digests.withColumns(
        {
            "offset": F.sum("length").over(before) - F.col("length"),
            "node": (F.row_number().over(order) - 1).cast("long"),
            "copy": F.row_number().over(Window.partitionBy("archive", "record_id").orderBy("digest")),
        }
    )
    return placed.withColumn("hash", _sha(F.concat_ws(":", "offset", "length", F.hex("digest")).cast("binary")))


@dataclass
class Tree:
    """levels[0] has the leaves, the last one a root for each archive: as many as the largest archive needs."""

    levels: list[DataFrame]

    def raised(self, height: int) -> Tree:
        """With levels above the roots, up to a height."""
        levels = list(self.levels)
        while len(levels) < height:
            levels.append(written(_above(levels[-1]), f"tree-{len(levels)}"))
        return Tree(levels)


def _above(level: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", F.hex("hash").alias("hash")))), lambda x: x["hash"])  # ``FANOUT`` at most
    up = level.groupBy("archive", F.expr(f"node div {FANOUT}").alias("parent")).agg(_sha(F.array_join(ordered, "").cast("binary")).alias("hash"))
    return up.withColumnRenamed("parent", "node")


def build_tree(records: DataFrame, label: str = "replica") -> Tree:
    levels = [written(leaves(records), f"{label}-0")]
    last = levels[0].agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]
    while last:
        levels.append(written(_above(levels[-1]), f"{label}-{len(levels)}"))
        last //= FANOUT
    return Tree(levels)


def audit(reference: Tree, replica: Tree) -> DataFrame:
    """archive, record_id, status, expected and found offset, length and digest of every record that differs."""
    height = max(len(reference.levels), len(replica.levels))
    reference, replica = reference.raised(height), replica.raised(height)

    def differing(level: int, within: DataFrame | None) -> DataFrame:
        sides = []
        for tree in (reference, replica):
            nodes = tree.levels[level].select("archive", "node", "hash")
            if within is not None:
                nodes = nodes.withColumn("parent", F.expr(f"node div {FANOUT}")).join(within, ["archive", "parent"], "left_semi")
            sides.append(nodes.select("archive", "node", "hash"))
        both = sides[0].alias("a").join(sides[1].alias("b"), ["archive", "node"], "full")
        return both.where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select("archive", "node")

    wrong = None
    for level in range(height - 1, -1, -1):
        wrong = written(differing(level, wrong and wrong.withColumnRenamed("node", "parent")), f"differs-{level}")
    columns = ["offset", "length", "digest"]
    sides = []
    for tree, prefix in ((reference, "expected"), (replica, "found")):
        own = tree.levels[0].join(wrong, ["archive", "node"], "left_semi")
        id_key = F.coalesce(F.col("record_id").cast("string"), F.lit("\0"))
        sides.append(own.select("archive", "record_id", "copy", id_key.alias("id_key"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns]))
    keys = ["archive", "id_key", "copy"]
    both = sides[0].join(sides[1].withColumnRenamed("record_id", "found_id"), keys, "full")
    status = (
        F.when(F.col("found_offset").isNull(), "missing")
        .when(F.col("expected_offset").isNull(), "extra")
        .when(F.col("expected_digest") != F.col("found_digest"), "altered")
        .otherwise("moved")
    )
    return both.select(
        "archive",
        F.coalesce("record_id", "found_id").alias("record_id"),
        status.alias("status"),
        *[
            (F.lower(F.hex(f"{p}_{c}")) if c == "digest" else F.col(f"{p}_{c}")).alias(f"{p}_{c}")
            for p in ("expected", "found")
            for c in columns
        ],
    )


def _replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages as WARC records, and a copy of them as a worn store would return it.

    In the copy, by the MD5 of the page's id, about one record in 256 has its last byte changed, and
    about one in 4096 is gone, so that the records behind it in its archive have moved.
    """
    fate = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    record = warc_record(F.col("url"), F.col("html"))
    base = pages.select(F.expr(f"page_id div {PER_ARCHIVE}").alias("archive"), F.col("page_id").cast("long").alias("record_id"), record.alias("content"), fate.alias("fate"))
    base = base.withColumn("archive", F.coalesce("archive", F.lit(-1)))
    worn = base.where(~F.col("fate").startswith("0aa")).withColumn(
        "content", F.when(F.col("fate").startswith("07"), F.concat(F.expr("left(content, length(content) - 1)"), F.lit("\0"))).otherwise(F.col("content"))
    )
    return base, worn


def op9_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, worn = _replicas(table(spark, sf_dir, "pages"))
    return audit(build_tree(base, "reference"), build_tree(worn, "copy"))


QUERIES = {"op9_merkle_audit": op9_merkle_audit}
ORACLE_SQL = {
    "op9_merkle_audit": f"""
WITH base AS (
  SELECT coalesce(page_id // {PER_ARCHIVE}, -1) AS archive, page_id AS record_id,
         md5(coalesce(CAST(page_id AS VARCHAR), '')) AS fate,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(CAST(encode(coalesce(html, '')) AS BLOB)) AS VARCHAR)
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS content
  FROM pages
), sides AS (
  SELECT 0 AS side, archive, record_id, encode(content) AS raw FROM base
  UNION ALL
  SELECT 1, archive, record_id,
         CASE WHEN starts_with(fate, '07') THEN encode(left(content, length(content) - 1)) || '\\x00'::BLOB ELSE encode(content) END
  FROM base WHERE NOT starts_with(fate, '0aa')
), digests AS (
  SELECT side, archive, record_id, octet_length(raw) AS length, sha256(raw) AS digest FROM sides
), placed AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY side, archive ORDER BY record_id, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset",
         row_number() OVER (PARTITION BY side, archive, record_id ORDER BY digest) AS copy
  FROM digests
)
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a.record_id, b.record_id) AS record_id,
       CASE WHEN b.side IS NULL THEN 'missing' WHEN a.side IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'altered' ELSE 'moved' END AS status,
       a."offset" AS expected_offset, a.length AS expected_length, a.digest AS expected_digest,
       b."offset" AS found_offset, b.length AS found_length, b.digest AS found_digest
FROM (SELECT * FROM placed WHERE side = 0) a
FULL JOIN (SELECT * FROM placed WHERE side = 1) b
  ON a.archive = b.archive AND a.record_id IS NOT DISTINCT FROM b.record_id AND a.copy = b.copy
WHERE a.side IS NULL OR b.side IS NULL OR a.digest <> b.digest OR a."offset" <> b."offset"
"""
}

"""Merkle manifest of a dataset, reduced in superblocks, with an inclusion proof for every row.

A leaf hashes a row's fields. The leaves of a source, in the order of doc_id, are a tree: as long as
several nodes remain, every ``FANOUT`` neighbours become one node, the last run as it is. What remains
is the source's subroot, and the subroots, in the order of sources, are a tree of their own.

1. Leaves are computed by columns and exchanged once by ranges of (source, doc_id, leaf), so a source
   with a third of all rows spans many ranges; a leaf's place is the number of its source's rows in
   the ranges before plus its place in its own.
2. Superblocks: places are bucketed by ``FANOUT ** LEVELS``. A bucket is one group of ``applyInPandas``,
   which collapses its levels to one root and gives each of its nodes the siblings on the way
   there. The bucket roots are reduced in the same way until every tree has one node; a lower and an upper
   path, joined by tree and bucket, are concatenated. No group is larger than a bucket, whatever a
   source holds, and each round leaves a table.
3. A proof is the list of siblings left and right of the way from a leaf to the root; folding a
   leaf into it gives the root if and only if the row is as it was.

A null field is hashed as ``-``, any other as its UTF-8 byte count, ``:`` and itself, so null and empty
texts differ. A null source is a source of its own, the first; rows without a doc_id are the first of their source. Rows
that agree in doc_id are ordered by leaf; rows that agree in all have equal leaves and are interchangeable.
Texts of any length are hashed whole. An empty table gives an empty manifest. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import numbered
from .common import table, written

FANOUT = 3
#: Levels of one superblock: its nodes are ``FANOUT ** LEVELS`` at most.
LEVELS = 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row of documents, with some of its fields replaced."""
    return h(*(_field(changed.get(c, F.col(c))) for c in FIELDS))


def _collapse(group: pd.DataFrame, levels: int) -> pd.DataFrame:
    group = group.sort_values("place")
    nodes = group["hash"].tolist()
    lefts: list[list[str]] = [[] for _ in nodes]
    rights: list[list[str]] = [[] for _ in nodes]
    total, at = int(group["total"].iloc[0]), list(range(len(nodes)))
    for _ in range(levels):
        if total == 1:
            break
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        for i, node in enumerate(at):
            run, k = runs[node // FANOUT], node % FANOUT
            lefts[i].append("".join(run[:k]))
            rights[i].append("".join(run[k + 1 :]))
        at = [node // FANOUT for node in at]
        nodes = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
        total = -(-total // FANOUT)
    return group[["tree", "bucket", "place"]].assign(lefts=lefts, rights=rights, root=nodes[0])


def superblock_paths(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """From ``tree long, place long, total long, hash string``: tree, place, lefts, rights, root of every node.

    Places run from 0 to total - 1 in each tree. lefts and rights are the siblings on either side, concatenated, from
    the lowest level up; a tree of one node has none and is its own root.
    """
    width = FANOUT**levels
    keyed = nodes.select("tree", "place", "total", "hash", F.expr(f"place div {width}").alias("bucket"))
    schema = "tree long, bucket long, place long, lefts array<string>, rights array<string>, root string"
    low = written(keyed.groupBy("tree", "bucket").applyInPandas(lambda g: _collapse(g, levels), schema), "superblocks")
    largest = nodes.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    if largest <= width:
        return low.drop("bucket")
    counts = low.groupBy("tree").agg((F.max("bucket") + 1).alias("total"))  # a row a tree
    roots = low.where(f"place % {width} = 0").select("tree", F.col("bucket").alias("place"), F.col("root").alias("hash"))
    roots = written(roots.join(counts, "tree").select("tree", "place", "total", "hash"), "superblock-roots")
    high = superblock_paths(roots, levels).select(
        "tree", F.col("place").alias("bucket"), F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"), F.col("root").alias("top")
    )
    return low.join(high, ["tree", "bucket"]).select(
        "tree", "place", F.concat("lefts", "up_lefts").alias("lefts"), F.concat("rights", "up_rights").alias("rights"), F.col("top").alias("root")
    )


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda node, s: h(s["l"], node, s["r"]))


def proof_hash(lefts: Column, rights: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return h(F.array_join(F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")), lambda s: F.concat(s["l"], s["r"])), ""))


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` with tree (the number of the source in their order), place and total."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row_no")]
    ranges = written(leaves.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "manifest-ranges")
    counts = written(ranges.groupBy("source", "range").agg(F.count("*").alias("n")), "manifest-counts")
    whole = Window.partitionBy("source")
    first = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("source", "range", first.alias("first"), F.sum("n").over(whole).alias("total"))
    sources = numbered(counts.select("source").distinct(), "tree", F.col("source").asc_nulls_first())
    counts = counts.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.*", "tree")
    within = Window.partitionBy("range", "source").orderBy(*order[1:])
    rows = ranges.withColumn("within", F.row_number().over(within)).alias("r")
    same = (F.col("r.range") == F.col("c.range")) & F.col("r.source").eqNullSafe(F.col("c.source"))
    joined = rows.join(counts.alias("c"), same)
    return joined.select("r.*", "tree", (F.col("first") + F.col("within") - 1).alias("place"), "total").drop("range", "within")


def manifest(docs: DataFrame, *carried: Column, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root, lefts and rights (its inclusion proof), and what is carried.

    carried: named columns of ``docs`` that come along with their row, such as another state's leaf.
    """
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_hash().alias("leaf"), *carried)
    leaves = written(leaves.withColumn("row_no", F.monotonically_increasing_id()), "manifest-leaves")
    placed = written(_placed(leaves), "manifest-places")
    low = superblock_paths(placed.select("tree", "place", "total", F.col("leaf").alias("hash")), levels)
    low = low.withColumnRenamed("root", "subroot")
    subroots = written(low.where("place = 0").select("tree", "subroot"), "manifest-subroots")
    n = subroots.count()
    top = superblock_paths(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("place"), F.lit(n).cast("long").alias("total"), F.col("subroot").alias("hash")), levels)
    top = top.select((F.col("place") + 1).alias("tree"), F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"), "root")
    # a path above the subroot is the same for a whole source: it is joined to the buckets' width, not to a source's rows
    salt = F.expr(f"place div {FANOUT**levels}")
    widths = placed.groupBy("tree").agg(F.max(salt).alias("last"))
    top = top.join(widths, "tree").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).drop("last")
    rows = placed.join(low, ["tree", "place"]).withColumn("salt", salt).join(top, ["tree", "salt"])
    kept = [c for c in leaves.columns if c != "row_no"]
    return rows.select(*kept, "subroot", "root", F.concat("lefts", "up_lefts").alias("lefts"), F.concat("rights", "up_rights").alias("rights"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(touched, leaf_hash(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    rows = manifest(docs, tampered.alias("tampered"))
    sides = F.col("lefts"), F.col("rights")
    rows = rows.withColumns({"proof_sha256": proof_hash(*sides), "folded_root": folded(F.coalesce("tampered", "leaf"), *sides)})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# DuckDB has no CRC-32 function: the register is shifted over the bits of the id's digits by the reflected polynomial 0xEDB88320
QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE_SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE crc(v, digits, i, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT v, digits, i + 1,
         CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN CAST(ascii(digits[i // 8 + 1]) AS BIGINT) ELSE 0 END) % 2 = 1
              THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN CAST(ascii(digits[i // 8 + 1]) AS BIGINT) ELSE 0 END) >> 1, CAST(3988292384 AS BIGINT))
              ELSE xor(c, CASE WHEN i % 8 = 0 THEN CAST(ascii(digits[i // 8 + 1]) AS BIGINT) ELSE 0 END) >> 1 END
  FROM crc WHERE i < 8 * length(digits)
), touched AS (
  SELECT v FROM crc WHERE i = 8 * length(digits) AND xor(c, CAST(4294967295 AS BIGINT)) % 2 = 0
), leaves AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
         CASE WHEN doc_id IN (SELECT v FROM touched) THEN {_sql_leaf("replace(text, chr(10), '')")} END AS tampered
  FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS total
  FROM leaves
), low(level, tree, place, total, hash) AS (
  SELECT 0, tree, place, total, leaf FROM placed
  UNION ALL
  SELECT level + 1, tree, place // {FANOUT}, (total + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(hash, '' ORDER BY place))
  FROM low WHERE total > 1 GROUP BY level, tree, place // {FANOUT}, total
), subroots AS (
  SELECT tree, level AS height, hash AS subroot FROM low WHERE total = 1
), high(level, place, total, hash) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots
  UNION ALL
  SELECT level + 1, place // {FANOUT}, (total + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(hash, '' ORDER BY place))
  FROM high WHERE total > 1 GROUP BY level, place // {FANOUT}, total
), siblings AS (
  SELECT a.level, a.tree, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
         coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM low a JOIN low b ON a.level = b.level AND a.tree = b.tree AND a.place // {FANOUT} = b.place // {FANOUT}
  WHERE a.total > 1 GROUP BY a.level, a.tree, a.place
), high_siblings AS (
  SELECT a.level, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
         coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM high a JOIN high b ON a.level = b.level AND a.place // {FANOUT} = b.place // {FANOUT}
  WHERE a.total > 1 GROUP BY a.level, a.place
), steps AS (
  SELECT p.tree, p.place, s.level AS step, s.l, s.r
  FROM placed p JOIN siblings s ON s.tree = p.tree AND s.place = p.place // CAST(pow({FANOUT}, s.level) AS BIGINT)
  UNION ALL
  SELECT p.tree, p.place, t.height + s.level, s.l, s.r
  FROM placed p JOIN subroots t ON p.tree = t.tree JOIN high_siblings s ON s.place = p.tree // CAST(pow({FANOUT}, s.level) AS BIGINT)
), proofs AS (
  SELECT tree, place, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY tree, place
), folds(tree, place, step, node) AS (
  SELECT tree, place, 0, coalesce(tampered, leaf) FROM placed
  UNION ALL
  SELECT f.tree, f.place, f.step + 1, sha256(s.l || f.node || s.r)
  FROM folds f JOIN steps s ON s.tree = f.tree AND s.place = f.place AND s.step = f.step
), ends AS (
  SELECT tree, place, max_by(node, step) AS folded_root FROM folds GROUP BY tree, place
)
SELECT p.doc_id, p.leaf, t.subroot, (SELECT hash FROM high WHERE total = 1) AS root,
       coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = (SELECT hash FROM high WHERE total = 1) AS verified
FROM placed p JOIN subroots t ON p.tree = t.tree
LEFT JOIN proofs q ON p.tree = q.tree AND p.place = q.place
JOIN ends e ON p.tree = e.tree AND p.place = e.place
"""
}

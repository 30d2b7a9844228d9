"""N-gram Jaccard join of near-duplicate texts by MinHash banding.

A text is the set of its runs of five words (a text of one to four words has one run, of them
all; words are runs of ASCII letters, digits and non-ASCII characters, lower-cased). Two texts are
linked when the Jaccard similarity of their whole sets is 0.8 or more.

1. One Arrow pass gives each text a 128-bit digest of its set and one hash per band; the numbers of
   bands and rows come from the recall wanted at the threshold. Texts with equal sets form one
   member (a grouped minimum), however many copies there are.
2. Members are shuffled on their band hashes; each bucket contributes one edge per member, to its
   smallest member, and the components of these edges are the candidate clusters: every pair that
   shares a band lies in one.
3. The full sets of members in clusters are fetched once. A cluster of over ``BLOCK`` members, or ``BLOCK_BYTES`` bytes, is cut
   into blocks, and each pair of blocks is one work item, so no task holds a cluster whole. Inside
   an item all pairs are verified exactly; what leaves it is one link count and one tree edge per
   member, never the pairs.
4. Components of the tree edges are the classes; counts add up to each document's number of links.

Texts without words have equal (empty) sets: they form one class and link to each other. A null
text counts as empty. Rows that repeat are documents of their own. Null doc_ids are kept. Empty
input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import components, free_name, table, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Members in a block of a large cluster and bytes of their sets, at most on average, and columns of a block's matrix held at once.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 1 << 25, 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, permutations: int = 256) -> tuple[int, int]:
    """``(bands, rows)``: the most rows a band whose bands still reach the recall within the permutations."""
    best = (permutations, 1)
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= permutations:
            best = (bands, rows)
    return best


def _order(doc_id: str):
    """doc_id, a null last: an order and a join key without nulls."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))


def _text_hash():
    return F.xxhash64(F.coalesce(F.lower("text"), F.lit("")))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, hashes, offsets)``: the sorted distinct shingles of consecutive rows."""
    for at, raw, offsets in words.chunks(texts):
        hashes, rows, _, _ = words.word_hashes(raw, offsets)
        s, r = words.shingles(hashes, rows, n)
        yield at, *words.distinct_by_row(s, r, len(offsets) - 1)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketcher(n: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row_no", pa.int64()), ("text_hash", pa.int64()), ("key", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(bands * rows)
        for batch in batches:
            for at, s, offsets in _sets(batch.column("text"), n):
                count = len(offsets) - 1
                full = np.flatnonzero(np.diff(offsets))
                band = np.zeros((len(full), bands), np.uint64)
                if len(full):
                    starts = offsets[:-1][full]
                    with np.errstate(over="ignore"):
                        for b in range(bands):
                            h = np.full(len(full), b, np.uint64)
                            for m in multipliers[b * rows : (b + 1) * rows]:
                                h = words.mix(h + np.minimum.reduceat(s * m, starts))
                            band[:, b] = h
                lengths = np.zeros(count, np.int64)
                lengths[full] = bands
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(at, count),
                        batch.column("row_no").slice(at, count),
                        batch.column("text_hash").slice(at, count),
                        pa.array([_key(s[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(band.view(np.int64).ravel())),
                    ],
                    schema=schema,
                )

    return run, "doc_id long, row_no long, text_hash long, key binary, size long, bands array<long>"


def _set_maker(n: int):
    schema = pa.schema([("member", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # a task's members
        for batch in batches:
            new = [i for i, m in enumerate(batch.column("member").to_pylist()) if m not in done and not done.add(m)]
            batch = batch.take(pa.array(new, pa.int64()))
            keys = batch.column("key").to_pylist()
            for at, s, offsets in _sets(batch.column("text"), n):
                sets = [s[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                right = [i for i, x in enumerate(sets) if _key(x) == keys[at + i]]
                yield pa.record_batch(
                    [batch.column("member").slice(at, len(sets)).take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())],
                    schema=schema,
                )

    return run, "member long, shingles binary"


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    both = left + right
    of = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values, at, seen = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    place = np.cumsum(seen > 1) - 1
    use = seen[at] > 1
    of, column = of[use], place[at[use]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (c, c + COLUMNS))
        m = np.zeros((len(both), min(COLUMNS, int(column[-1]) + 1 - c)), np.float32)
        m[of[a:b], column[a:b] - c] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _verify(one: bool, sides: np.ndarray, members: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float):
    """Of one work item: each member's linked documents, and a tree edge to a member it is connected with.

    one: the item is one block against itself; else sides tells the first block (0) from the second (1).
    """
    li = np.flatnonzero(sides == 0)
    ri = li if one else np.flatnonzero(sides)
    size = np.array([len(x) for x in sets])
    share = _overlaps([sets[i] for i in li], [sets[i] for i in ri])
    # integers below 2**24 are exact in float32; the bound is compared without division
    linked = share.astype(np.float64) >= threshold * (size[li][:, None] + size[ri][None, :] - share) - 1e-9
    linked &= members[li][:, None] != members[ri][None, :]
    links = np.zeros(len(sets), np.int64)
    links[li] += linked @ copies[ri]
    if not one:
        links[ri] += linked.T @ copies[li]
    root = members.copy()
    while True:  # the least member of each component, by propagation over the block's matrix
        low = np.where(linked, root[ri][None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        new = root.copy()
        new[li] = np.minimum(new[li], low)
        if not one:
            low = np.where(linked, new[li][:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max)
            new[ri] = np.minimum(new[ri], low)
        if (new == root).all():
            return links, root
        root = new


def _verifier(threshold: float):
    schema = pa.schema([("member", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        at = None

        def done():
            if len(held) < 2:
                return None
            rows = list(held.values())
            sides = np.array([r[0] for r in rows])
            members, copies = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
            links, root = _verify(at[1] == at[2], sides, members, copies, [np.frombuffer(r[3], np.uint64) for r in rows], threshold)
            some = links > 0
            return pa.record_batch([pa.array(x[some]) for x in (members, links, root)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "first", "second", "side", "member", "copies", "shingles")]
            for cluster, first, second, *row in zip(*columns, strict=True):
                if at != (cluster, first, second):
                    if (out := done()) is not None:
                        yield out
                    held.clear()
                    at = (cluster, first, second)
                held[row[1]] = tuple(row)
        if (out := done()) is not None:
            yield out

    return run, "member long, links long, root long"


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), links, class_size, kept, row_no, text_hash.

    links counts the other documents whose sets reach the threshold, copies included; kept is true
    for one document of each class, that of the least doc_id. row_no tells rows of equal doc_id apart.
    """
    bands, rows = choose_bands(threshold, recall)
    sketch, schema = _sketcher(n, bands, rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), _text_hash().alias("text_hash"))
    seen = written(text.withColumn("row_no", F.monotonically_increasing_id()).mapInArrow(sketch, schema), "sketches")
    members = written(
        seen.groupBy("key")
        .agg(F.min(F.struct(_order("doc_id").alias("order"), "row_no", "doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"), F.min(F.struct("row_no", "bands", "size")).alias("b"))
        .select("key", "copies", "b.size", F.col("first.row_no").alias("member"), "first.doc_id", "first.text_hash", F.col("b.bands").alias("bands")),
        "members",
    )

    by_band = members.select(F.explode("bands").alias("h"), "member")
    buckets = by_band.groupBy("h").agg(F.min("member").alias("least"), F.count("*").alias("n")).where("n > 1")
    edges = by_band.join(buckets.hint("merge"), "h").where("member <> least").select(F.col("member").alias("a"), F.col("least").alias("b"))
    near = written(components(edges, "candidate-edges"), "candidate-clusters").withColumnsRenamed({"node": "member", "comp": "cluster"})

    near = near.join(members.select("member", "doc_id", "text_hash", "key", "copies", "size").hint("merge"), "member")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(8 * F.sum("size") / BLOCK_BYTES)).cast("int")
    sizes = written(near.groupBy("cluster").agg(blocks.alias("blocks")), "cluster-sizes")
    placed = written(near.join(sizes.hint("merge"), "cluster").drop("size"), "clustered")
    make, made = _set_maker(n)
    # a member's text comes from the rows of its doc_id and text; rows that agree in both bring the same set, of which one is held
    wanted = placed.select("member", "key", _order("doc_id").alias("of"), "text_hash")
    sets = text.select(_order("doc_id").alias("of"), "text_hash", "text").join(wanted.hint("shuffle_hash"), ["of", "text_hash"]).select("member", "key", "text")
    sets = sets.mapInArrow(make, made)

    own = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    items = (
        placed.select("member", "cluster", "copies", "blocks", own.alias("own"))
        .join(sets, "member")
        .select("member", "cluster", "copies", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            "cluster",
            F.least("own", "other").alias("first"),
            F.greatest("own", "other").alias("second"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "member",
            "copies",
            "shingles",
        )
    )
    verify, verified = _verifier(threshold)
    found = written(
        items.repartition("cluster", "first", "second").sortWithinPartitions("cluster", "first", "second").mapInArrow(verify, verified), "links"
    )
    classes = components(found.select(F.col("member").alias("a"), F.col("root").alias("b")), "class-edges").withColumnsRenamed({"node": "member"})
    totals = found.groupBy("member").agg(F.sum("links").alias("links"))
    least = F.min(F.struct(_order("doc_id").alias("order"), F.col("member").alias("row"), "doc_id"))
    settled = (
        members.join(totals.hint("merge"), "member", "left")
        .join(classes.hint("merge"), "member", "left")
        .withColumn("comp", F.coalesce("comp", "member"))
    )
    settled = written(settled.select("key", "member", "doc_id", "copies", "links", "comp"), "settled")
    top = settled.groupBy("comp").agg(least.alias("top"), F.sum("copies").alias("class_size"))
    by_key = settled.join(top.hint("merge"), "comp").select(
        "key", "top", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    return seen.select("doc_id", "row_no", "text_hash", "key").join(by_key.hint("merge"), "key").select(
        "doc_id",
        F.col("top.doc_id").alias("class_id"),
        "links",
        "class_size",
        (F.col("row_no") == F.col("top.row")).alias("kept"),
        "row_no",
        "text_hash",
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``jaccard_join`` does not keep.

    A row goes by its doc_id and whole lower-cased text; of rows that agree in both, one is kept at most.
    """
    of, digest, turn = (free_name(docs, c) for c in ("of", "digest", "turn"))
    kept = jaccard_join(docs, **options).where("kept").select(_order("doc_id").alias(of), F.col("text_hash").alias(digest))
    keyed = docs.withColumns({of: _order("doc_id"), digest: _text_hash()})
    again = Window.partitionBy(of, digest).orderBy(of)
    return keyed.join(kept, [of, digest], "left_semi").withColumn(turn, F.row_number().over(again)).where(F.col(turn) == 1).select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links", "class_size", "kept")


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE_SQL: dict[str, str] = {}

"""Mixing sources to target weights by fixed-length blocks.

The words of each source, its documents in a fixed pseudorandom order, form one stream that is cut
into blocks of ``BLOCK_WORDS`` words (the last may be shorter). A source's target decides how many
block slots it gets, of the last of which only as many words count as are missing to the target; a slot's number runs through the
source's blocks in a pseudorandom order of its own per epoch, so a block is used again only when all others have been used as often.

Each source's slots are dealt to output shards by a multinomial draw over the shards, so that sources meet their
targets at every size and shards come out nearly equal: halving the range of shards again and again, a half's
count of a source is drawn binomially from its parent's with a seed of that node, so any task can compute its
shards' counts alone and a rerun draws the same, by one law for all sizes. The slots then join the blocks by (source, block).

Sizes are numbers of ``[^\\x20\\x09-\\x0D]+`` in the text; a null text has none. A null source is a source of
its own, ranked last. Documents without words take part with nothing taken. Documents that agree in
doc_id, source and text are told apart by a running number. Empty input gives an empty mix. Extra
columns are ignored by ``mix`` and carried by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import free_name, table, written

WEIGHTS, REPEATS = (5, 2, 1), 3
BLOCK_WORDS, SHARD_SLOTS, LEAST_SHARDS, SEED = 128, 1 << 16, 16, 20240917
#: Parts of each source's stream whose offsets are summed first, at least, and rows for which there is one more.
PARTS, PART_ROWS = 1024, 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size)`` with one row a source, plus rank, weight and target.

    Targets share the total by weight; none exceeds ``repeats`` times its source's size, and what
    is above goes to the others by weight. With the sources in order of cap over weight, those
    before the first that fits the level ``rest / weights of the rest`` are at their caps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.get(cycle, F.col("rank") % len(weights))).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", rest / F.sum("weight").over(after)).withColumn("nth", F.row_number().over(order))
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))).over(every)
    return level.select("source", "source_size", "rank", "weight", F.least("cap", F.coalesce(fits["level"], F.lit(0.0)) * F.col("weight")).alias("target"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for at, raw, offsets in words.chunks(batch.column("text")):
            starts, _ = words.spaced_words(raw, offsets)
            sizes[at : at + len(offsets) - 1] = np.diff(np.searchsorted(starts, offsets))
        kept = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes)], [*kept.schema.names, "size"])


def _permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 to n - 1: a Feistel network on the next even number of bits, walked until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = words.mix(np.arange(1, 7, dtype=np.uint64) + np.uint64(key & (2**63 - 1)) * np.uint64(8))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        with np.errstate(over="ignore"):
            for k in keys:
                left, right = right, left ^ (words.mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _place_of(value: int, n: int, key: int) -> int:
    """Where ``_permute`` puts a value: the network backwards, walked in the same way."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    keys = words.mix(np.arange(1, 7, dtype=np.uint64) + np.uint64(key & (2**63 - 1)) * np.uint64(8))
    while True:
        left, right = value >> half, value & mask
        with np.errstate(over="ignore"):
            for k in keys[::-1]:
                left, right = right ^ (int(words.mix(np.array([left], np.uint64) + k)[0]) & mask), left
        value = (left << half) | right
        if value < n:
            return value


def quota(size: int, target: int, block_words: int, order_key) -> tuple[int, int | None]:
    """How many slots of blocks of a source of ``size`` words have ``target`` words, and how many words of the last one count (None: all).

    order_key: the key of an epoch's permutation of the blocks, which tells when the short last block comes.
    """
    if not size or target <= 0:
        return 0, None
    blocks = -(-size // block_words)
    epochs, rest = divmod(target, size)
    if not rest:
        return epochs * blocks, None
    short = blocks * block_words - size
    behind = rest > _place_of(blocks - 1, blocks, order_key(epochs)) * block_words
    taken = -(-(rest + (short if behind else 0)) // block_words)
    over = taken * block_words - (short if behind else 0) - rest
    own = block_words - (short if int(_permute(np.array([taken - 1]), blocks, order_key(epochs))[0]) == blocks - 1 else 0)
    return epochs * blocks + taken, own - over if over else None


def shard_counts(shard: int, shards: int, quotas: list[int], seed: int = SEED) -> tuple[list[int], list[int]]:
    """How many slots of each source the shard gets, and how many the shards before it got."""
    lo, hi, counts, before = 0, shards, list(quotas), [0] * len(quotas)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = [int(rng.binomial(c, (mid - lo) / (hi - lo))) for c in counts]
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, before = mid, [c - x for c, x in zip(counts, left, strict=True)], [b + x for b, x in zip(before, left, strict=True)]
    return counts, before


@dataclass
class Mix:
    """targets: a row a source. documents: a row a document with its place in its source's stream.

    slots: the mix itself, (shard, slot, rank, epoch, block, limit); limit is null, or how many words of the block count in this slot. pieces: the
    documents' shares of blocks, (rank, block, row_no, start, words, inner); a block's words are its pieces', inner those before a piece.
    """

    targets: DataFrame
    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """``(row_no, epoch, start, words)``: every piece of a document that the mix takes, once for each time."""
        own = F.when(F.col("limit").isNull(), F.col("words")).otherwise(F.least("words", F.col("limit") - F.col("inner")))
        met = self.slots.select("rank", "block", "epoch", "limit").hint("merge").join(self.pieces, ["rank", "block"])
        return met.select("row_no", "epoch", "start", own.alias("words")).where("words > 0")


def _key_columns() -> dict:
    return {
        "id_order": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)),
        "text_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        "source_hash": F.xxhash64(F.col("source"), F.col("source").isNull()),
    }


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Mix:
    spark = docs.sparkSession
    keys = _key_columns()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *[c.alias(n) for n, c in keys.items()], "text")
    schema = "doc_id long, source string, id_order long, text_hash long, source_hash long, size long"
    sized = written(base.mapInArrow(_count_words, schema), "sizes")
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "targets")

    part = F.pmod(F.xxhash64("id_order", F.lit(seed)), F.lit(max(PARTS, sized.count() // PART_ROWS))).cast("int")
    sized = sized.withColumn("part", part)
    parts = sized.groupBy("source_hash", "part").agg(F.sum("size").alias("words"))
    sums = Window.partitionBy("source_hash").orderBy("part")
    parts = parts.withColumn("base", F.sum("words").over(sums) - F.col("words")).drop("words")
    order = Window.partitionBy("source_hash", "part").orderBy("id_order", "text_hash")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = targets.select(F.xxhash64(F.col("source"), F.col("source").isNull()).alias("source_hash"), "rank", "source_size", "target")
    placed = (
        sized.withColumn("within", F.sum("size").over(running) - F.col("size"))
        .withColumn("copy", F.row_number().over(Window.partitionBy("source_hash", "part", "id_order", "text_hash").orderBy("id_order")))
        .join(parts, ["source_hash", "part"])
        .join(names, "source_hash")
        .select("doc_id", "id_order", "text_hash", "source_hash", "copy", "size", "source_size", "rank", "target", (F.col("base") + F.col("within")).alias("at"))
        .withColumn("row_no", F.monotonically_increasing_id())
    )
    placed = written(placed, "placed")

    # one row a source: what the mix's configuration is made of
    plan = [(r.rank, r.source_size, r.target) for r in targets.orderBy("rank").collect()]
    blocks = [-(-size // block_words) for _, size, _ in plan]
    order_key = lambda rank, epoch: seed * 1000003 + rank * 1009 + epoch
    asked = [quota(size, min(repeats * size, round(target)), block_words, lambda e, rank=rank: order_key(rank, e)) for rank, size, target in plan]
    quotas, limits = [n for n, _ in asked], [limit for _, limit in asked]
    shards = max(min(LEAST_SHARDS, sum(quotas)), 1, -(-sum(quotas) // SHARD_SLOTS))
    slot_schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("rank", pa.int32()), ("epoch", pa.int32()), ("block", pa.int64()), ("limit", pa.int64())])

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                counts, before = shard_counts(shard, shards, quotas, seed)
                place, total = 0, sum(counts)
                for rank, (count, first) in enumerate(zip(counts, before, strict=True)):
                    if not count:
                        continue
                    n = np.arange(first, first + count)
                    epoch = n // blocks[rank]
                    block = np.zeros(count, np.int64)
                    for e in np.unique(epoch):
                        at = epoch == e
                        block[at] = _permute(n[at] % blocks[rank], blocks[rank], order_key(rank, int(e)))
                    slot = _permute(np.arange(place, place + count), total, seed + shard)
                    place += count
                    limit = pa.array([limits[rank] if k == quotas[rank] - 1 else None for k in n.tolist()], pa.int64()) if first + count == quotas[rank] else pa.nulls(count, pa.int64())
                    yield pa.record_batch(
                        [pa.array(np.full(count, shard)), pa.array(slot), pa.array(np.full(count, rank, np.int32)), pa.array(epoch.astype(np.int32)), pa.array(block), limit],
                        schema=slot_schema,
                    )

    slots = spark.range(0, shards, numPartitions=min(shards, 4096)).mapInArrow(slots_of, "shard long, slot long, rank int, epoch int, block long, limit long")
    width = F.lit(block_words)
    last = F.expr(f"(at + size - 1) div {block_words}")
    pieces = (
        placed.where("size > 0")
        .select("row_no", "rank", "at", "size", F.explode(F.sequence(F.expr(f"at div {block_words}"), last)).alias("block"))
        .select(
            "rank",
            "block",
            "row_no",
            F.greatest(F.col("block") * width - F.col("at"), F.lit(0)).alias("start"),
            (F.least((F.col("block") + 1) * width, F.col("at") + F.col("size")) - F.greatest(F.col("block") * width, "at")).alias("words"),
            F.greatest(F.col("at") - F.col("block") * width, F.lit(0)).alias("inner"),
        )
    )
    return Mix(targets, placed, slots, pieces)


def _slice(columns: list[str], text: str, plan: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = batch.column(plan).to_pylist()
            for at, raw, offsets in words.chunks(batch.column(text)):
                starts, ends = words.spaced_words(raw, offsets)
                data, first = raw.tobytes(), np.searchsorted(starts, offsets)
                rows, texts = [], []
                for i in range(len(offsets) - 1):
                    by_epoch: dict[int, list] = {}
                    for piece in plans[at + i]:
                        by_epoch.setdefault(piece["epoch"], []).append((piece["start"], piece["words"]))
                    for _, runs in sorted(by_epoch.items()):
                        joined: list[list[int]] = []
                        for start, n in sorted(runs):
                            if joined and joined[-1][1] == start:
                                joined[-1][1] = start + n
                            else:
                                joined.append([start, start + n])
                        rows.append(at + i)
                        texts.append("\n".join(data[starts[first[i] + a] : ends[first[i] + b - 1]].decode() for a, b in joined))
                out = batch.select(columns).take(pa.array(rows, pa.int64()))
                out = out.set_column(columns.index(text), schema.field(text), pa.array(texts, schema.field(text).type))
                if "n_chars" in columns:
                    kind = schema.field("n_chars")
                    out = out.set_column(columns.index("n_chars"), kind, pa.array([len(t) for t in texts], kind.type))
                yield pa.RecordBatch.from_arrays(out.columns, schema=schema)

    return run


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for every epoch that takes words of a document, a row with those words.

    Columns are those of ``docs``; text holds the words taken, in order, runs that are not adjacent
    on lines of their own, and n_chars (where there is one) its length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = mix(docs, **options)
    plan = made.taken().groupBy("row_no").agg(F.collect_list(F.struct("epoch", "start", "words")).alias("plan"))
    keys = ["id_order", "text_hash", "source_hash", "copy"]
    plan = made.documents.select("row_no", *keys).join(plan, "row_no")
    names = {k: free_name(docs, k) for k in [*keys, "plan"]}
    plan = plan.select(*[F.col(k).alias(n) for k, n in names.items()])
    own = docs.withColumns({names[k]: c for k, c in _key_columns().items()})
    three = [names[k] for k in keys[:3]]
    own = own.withColumn(names["copy"], F.row_number().over(Window.partitionBy(*three).orderBy(names["id_order"])))
    joined = own.join(plan.hint("merge"), [names[k] for k in keys]).select(*docs.columns, names["plan"])
    schema = to_arrow_schema(docs.schema)
    return joined.mapInArrow(_slice(docs.columns, "text", names["plan"], schema), docs.schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each text: rank, block, start within the block, words."""
    for batch in batches:
        plans = batch.column("plan").to_pylist()
        for at, raw, offsets in words.chunks(batch.column("text")):
            starts, ends = words.spaced_words(raw, offsets)
            data, first = raw.tobytes(), np.searchsorted(starts, offsets)
            rows = [
                (x["rank"], x["block"], x["inner"], " ".join(data[starts[k] : ends[k]].decode() for k in range(first[i] + x["start"], first[i] + x["start"] + x["words"])))
                for i in range(len(offsets) - 1)
                for x in plans[at + i]
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rank", "block", "inner", "words"])


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix as it is written out: shard, slot, rank, epoch, block and the block's words, joined by spaces.

    The slots of a shard are numbered from 0 without gaps. A block has ``block_words`` words, a source's last one, and its last slot, may have fewer.
    """
    made = mix(docs, block_words=block_words, **options)
    keys = ["id_order", "text_hash", "source_hash", "copy"]
    pieces = made.pieces.join(made.documents.select("row_no", *keys), "row_no")
    plan = pieces.groupBy(*keys).agg(F.collect_list(F.struct("rank", "block", "inner", "start", "words")).alias("plan"))  # a document's own pieces
    own = docs.select("text", *[c.alias(n) for n, c in _key_columns().items()])
    own = own.withColumn("copy", F.row_number().over(Window.partitionBy(*keys[:3]).orderBy("id_order")))
    cut = own.join(plan.hint("merge"), keys).select("text", "plan").mapInArrow(_cut, "rank int, block long, inner long, words string")
    whole = cut.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("inner", "words"))).alias("parts"))  # at most block_words pieces
    whole = whole.select("rank", "block", F.array_join(F.col("parts.words"), " ").alias("words"))
    own = F.when(F.col("limit").isNull(), F.col("words")).otherwise(F.array_join(F.slice(F.split("words", " "), F.lit(1), F.col("limit").cast("int")), " "))
    return made.slots.join(whole.hint("merge"), ["rank", "block"]).select("shard", "slot", "rank", "epoch", "block", own.alias("words"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(table(spark, sf_dir, "documents"))
    took = made.taken().groupBy("row_no").agg(F.sum("words").alias("taken"))
    return made.documents.join(took, "row_no", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL: dict[str, str] = {}

"""Sharding by histogram sort: exact byte counts refine the splitters, then one exchange.

Rows are ordered by (hash of the text, doc_id, running number), so equal texts lie side by side, and written with this key. For 39 splitters of
40 shards, each round counts the bytes below some probes exactly, in every partition, and adds them
up; the probe interval that holds a splitter's target becomes its next bracket, narrowed to the
least and greatest key in it. A splitter is settled when a boundary lies within ``TOLERANCE`` of
its target, or when its bracket is a single key and the nearer side of it is taken. In the same rounds, with
a looser tolerance, each shard is cut into ranges of near equal bytes, as many as its bytes need (one for ``RANGE_BYTES``,
``RANGES`` at least), so that a large group of equal texts is spread like any other rows. The driver
holds probes and counts only: their number depends on the shards and ranges, not on the rows.

The rows, all columns, are then exchanged once, by range in the order of ranges, and numbered within it.

Law: ``bytes``. A row weighs the UTF-8 bytes of its text (a null text: none) plus 16. No two rows share a key: rows that
repeat are told apart by the running number, so that a border can lie among them; a null doc_id is ordered last. With fewer rows than
shards some shards are empty. Empty input gives an empty result. Extra columns are ignored by
``shard_keys`` and carried by ``shard``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, table, written

SHARDS, PROBES, TOLERANCE, OVERHEAD = 40, 64, 0.001, 16
#: Ranges of a shard that are numbered apart, at least, and the bytes for which there is one more; how unequal they may be.
RANGES, RANGE_BYTES, RANGE_TOLERANCE = 8, 1 << 29, 0.25


_KEY = ("text_hash", "id_order", "row_no")
_WIDTH = 8 * len(_KEY)
_KIND = f"S{_WIDTH}"


def _keys(*columns: np.ndarray) -> np.ndarray:
    """``_WIDTH`` bytes a row that compare as the key's columns do."""
    out = np.empty((len(columns[0]), len(columns)), ">u8")
    for i, column in enumerate(columns):
        out[:, i] = column.view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(_KIND).ravel()


def _bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(_WIDTH, "big") for k in keys], _KIND)


def count_below(keyed: DataFrame, bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """For each interval between ascending bounds: rows, bytes, least and greatest key (0 where empty)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _bytes(bounds)
        rows, size = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        least, most = np.full(len(bounds) + 1, b"\xff" * _WIDTH, _KIND), np.full(len(bounds) + 1, b"", _KIND)
        for batch in batches:
            keys = _keys(*(batch.column(c).to_numpy() for c in _KEY))
            order = np.argsort(keys, kind="stable")
            keys, of = keys[order], batch.column("size").to_numpy()[order]
            cut = np.r_[0, np.searchsorted(keys, edges, "left"), len(keys)]
            total = np.r_[0, np.cumsum(of)]
            n = np.diff(cut)
            some = np.flatnonzero(n)
            rows += n
            size += total[cut[1:]] - total[cut[:-1]]
            for i in some:
                least[i], most[i] = min(least[i], keys[cut[i]]), max(most[i], keys[cut[i + 1] - 1])
        some = np.flatnonzero(rows)
        pad = lambda x: [k.ljust(_WIDTH, b"\0") for k in x[some].tolist()]
        yield pa.record_batch(
            [pa.array(some.astype(np.int32)), pa.array(rows[some]), pa.array(size[some]), pa.array(pad(least), pa.binary()), pa.array(pad(most), pa.binary())],
            names=["at", "n", "bytes", "least", "most"],
        )

    counts = keyed.select(*_KEY, "size").mapInArrow(count, "at int, n long, bytes long, least binary, most binary")
    got = counts.groupBy("at").agg(F.sum("n"), F.sum("bytes"), F.min("least"), F.max("most")).collect()
    out = [(0, 0, 0, 0)] * (len(bounds) + 1)
    for at, n, size, least, most in got:
        out[at] = (n, size, int.from_bytes(least, "big"), int.from_bytes(most, "big"))
    return out


def splitters(keyed: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """Ascending keys: shard s takes the keys from splitter s - 1 on and below splitter s. Also those between ranges."""
    top = 1 << (8 * _WIDTH)
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per = max(RANGES, -(-total // (shards * RANGE_BYTES)))
    parts = shards * per
    goal = {i: total * i / parts for i in range(1, parts)}
    slack = {i: (RANGE_TOLERANCE if i % per else tolerance * per) * total / parts for i in goal}
    cells = max(shards * PROBES, 4 * parts)
    bounds = [top * i // cells for i in range(1, cells)]
    settled: dict[int, int] = {}
    while total:
        counts = count_below(keyed, bounds)
        below = np.r_[0, np.cumsum([c[1] for c in counts])]
        edges = [0, *bounds, top]
        brackets = set()
        for i, want in goal.items():
            if i in settled:
                continue
            at = int(np.searchsorted(below[1:], want))
            near = min((at, at + 1), key=lambda k: abs(int(below[k]) - want))
            least, most = counts[at][2], counts[at][3]
            if abs(int(below[near]) - want) <= slack[i]:
                settled[i] = edges[near]
            elif least == most:
                settled[i] = least if near == at else most + 1
            else:
                brackets.add((least, most + 1))
        if not brackets:
            break
        bounds = sorted({lo + (hi - lo) * k // PROBES for lo, hi in brackets for k in range(PROBES + 1)})
    own = sorted(settled.get(i, top - 1) for i in range(per, parts, per))
    return own, sorted({*own, *settled.values()})


def _own(docs: DataFrame):
    """The key, size and checksum of a row; the running number holds once it is written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id_order"),
        F.monotonically_increasing_id().alias("row_no"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def _placed(docs: DataFrame, columns: list[str], shards: int, tolerance: float) -> tuple[DataFrame, str]:
    """``columns`` of the rows exchanged by range, with a struct of size, text_crc32, shard and slot, and its name."""
    name, place, part = (free_name(docs, c) for c in ("own", "place", "range"))
    rows = written(docs.select(*columns, _own(docs).alias(name)), "shard-rows")
    keyed = rows.select(*(f"{name}.{c}" for c in (*_KEY, "size")))
    split, bounds = splitters(keyed, shards, tolerance)
    edges = _bytes(bounds)
    shard = np.searchsorted(_bytes(split), _bytes([0, *bounds]), "right").astype(np.int32)
    first = np.r_[0, np.cumsum([c[0] for c in count_below(keyed, bounds)])][:-1]
    first = first - first[np.searchsorted(shard, shard)]  # rows of the same shard in the ranges before

    @F.arrow_udf("struct<range: int, shard: int, first: long>")
    def place_of(text_hash: pa.Array, id_order: pa.Array, row_no: pa.Array) -> pa.Array:
        at = np.searchsorted(edges, _keys(*(c.to_numpy() for c in (text_hash, id_order, row_no))), "right").astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(at), pa.array(shard[at]), pa.array(first[at])], ["range", "shard", "first"])

    placed = rows.withColumn(place, place_of(*(F.col(f"{name}.{c}") for c in _KEY))).withColumn(part, F.col(place)["range"])
    # a partition a range, in their order: the window below takes the rows as they lie
    placed = placed.repartitionByRange(len(bounds) + 1, part)
    order = Window.partitionBy(part).orderBy(*(F.col(name)[c] for c in _KEY))
    slot = F.col(place)["first"] + F.row_number().over(order) - 1
    found = F.struct(f"{name}.size", f"{name}.text_crc32", F.col(place)["shard"].alias("shard"), slot.alias("slot"))
    return placed.select(*columns, found.alias(place)), place


def shard_keys(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard); other columns are not moved."""
    placed, place = _placed(docs, ["doc_id"], shards, tolerance)
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), *(f"{place}.{c}" for c in ("size", "text_crc32", "shard", "slot")))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, added: tuple[str, ...] = ("shard", "slot")) -> DataFrame:
    """The rows of ``docs``, all columns, exchanged once by range of keys, with their shard and slot.

    added may name size and text_crc32 as well; what is added has a ``_`` before its name if there is such a column.
    """
    placed, place = _placed(docs, docs.columns, shards, tolerance)
    return placed.select(*docs.columns, *(F.col(place)[c].alias(free_name(docs, c)) for c in added))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(shard_keys(table(spark, sf_dir, "documents")))


def digest(placed: DataFrame, *more: str) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *more)


QUERIES = {"op8_sharding": op8_sharding}
ORACLE_SQL: dict[str, str] = {}

"""Quality classifier: a factorisation machine.

Features of a text are its distinct words, hashed into 2**18 slots and of equal weight (their squares
add up to 1), and one slot for each structure statistic's bin: shares of punctuation, capitals,
digits, marks that repeat and words that repeat the word before, kinds of words per word, words
per line, word length, length, and the row's n_chars. All pairs of features interact through
``FACTORS`` numbers each; the sum over pairs is half the square of the sums less the sum of squares,
so a text is scored in time linear in its words.

The model is fitted on a bounded sample of labelled rows outside the held-out fold (``PER_CLASS`` a
class, by a hash of doc_id; broadcast by that bound), their features collected; every text is
scored in an Arrow pass. Labels, lang, source and doc_id are not inputs of a score.

A null text counts as empty and is scored by its statistics; a null n_chars has a bin of its own, as
has a table without the column. Without labels of both classes every score is the share of good
labels (1 without any). Repeated rows are scored each. Empty input gives an empty result. Extra
columns are ignored by ``score`` and carried by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import free_name, table
from .labelled import fold, sample

FOLDS, HELD_OUT, CUT = 3, 1, 0.5
PER_CLASS, BITS, FACTORS, BINS = 4096, 18, 6, 12
EPOCHS, BATCH, RATE, RIDGE = 12, 256, 0.1, 1e-4

_kind = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 punctuation
for _b in range(33, 127):
    _kind[_b] = 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 0 if 97 <= _b <= 122 else 3


@dataclass
class Features:
    """Words' slots by row (row i has those from offsets[i] to offsets[i + 1]) and statistics, a row each."""

    slots: np.ndarray
    offsets: np.ndarray
    stats: np.ndarray


def features(text: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[int, Features]]:
    for at, raw, offsets in words.chunks(text):
        h, rows, starts, ends = words.word_hashes(raw, offsets)
        n_rows = len(offsets) - 1
        slots, first = words.distinct_by_row(h >> np.uint64(64 - BITS), rows, n_rows)
        n = np.bincount(rows, minlength=n_rows).astype(float)
        size = np.diff(offsets).astype(float)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        kind = _kind[raw]
        twice = np.zeros(len(raw), bool)
        twice[1:] = (kind[1:] == 3) & (raw[1:] == raw[:-1])
        per = np.maximum(size, 1)
        stats = [words.row_sums(kind == k, offsets) / per for k in (3, 1, 2)]
        stats += [
            words.row_sums(twice, offsets) / per,
            np.bincount(rows, again, n_rows) / np.maximum(n, 1),
            np.diff(first) / np.maximum(n, 1),
            n / (1 + words.row_sums(raw == 10, offsets)),
            np.bincount(rows, ends - starts, n_rows) / np.maximum(n, 1),
            np.log1p(size),
            n_chars[at : at + n_rows],
        ]
        yield at, Features(slots.astype(np.int64), first, np.stack(stats, 1))


@dataclass
class FactorisationMachine:
    edges: list[np.ndarray]
    constant: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(slots, values, offsets)`` with the statistics' bins behind each row's words."""
        n, k = f.stats.shape
        bins = np.stack([np.where(np.isnan(f.stats[:, j]), BINS, np.searchsorted(e, f.stats[:, j], "right")) for j, e in enumerate(self.edges)], 1)
        bins = bins + (1 << BITS) + np.arange(k) * (BINS + 1)
        count = np.diff(f.offsets)
        place = np.repeat(f.offsets[1:], k)
        slots = np.insert(f.slots, place, bins.ravel())
        values = np.insert(np.repeat(1 / np.sqrt(np.maximum(count, 1)), count), place, 1 / np.sqrt(k))
        return slots, values, f.offsets + k * np.arange(n + 1)

    def margins(self, slots: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the score before the logistic function, and its sums of factors."""
        starts = offsets[:-1]
        weighted = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(weighted, starts, 0)
        squares = np.add.reduceat((weighted * weighted).sum(1), starts)
        linear = np.add.reduceat(self.linear[slots] * values, starts)
        return self.constant + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, f: Features) -> np.ndarray:
        if not len(f.stats):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.rows(f))[0], -30, 30)))


def fit_machine(f: Features, y: np.ndarray, weight: np.ndarray, seed: int = 1) -> FactorisationMachine:
    """Logistic loss, AdaGrad steps on small batches."""
    rng = np.random.default_rng(seed)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(c[~np.isnan(c)], cuts)) if (~np.isnan(c)).any() else np.zeros(0) for c in f.stats.T]
    size = (1 << BITS) + f.stats.shape[1] * (BINS + 1)
    fm = FactorisationMachine(edges, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    slots, values, offsets = fm.rows(f)
    seen_w, seen_v, seen_0 = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, max(1, len(order) // BATCH)):
            count = np.diff(offsets)[rows]
            at = np.repeat(offsets[rows] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            s, x = slots[at], values[at]
            z, sums = fm.margins(s, x, np.r_[0, np.cumsum(count)])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            error = (p - y[rows]) * weight[rows] / len(rows)
            row = np.repeat(np.arange(len(rows)), count)
            used, back = np.unique(s, return_inverse=True)
            g = error[row] * x
            g_w = np.bincount(back, g, len(used)) + RIDGE * fm.linear[used]
            wide = g[:, None] * (sums[row] - fm.factors[s] * x[:, None])
            g_v = np.stack([np.bincount(back, wide[:, k], len(used)) for k in range(FACTORS)], 1) + RIDGE * fm.factors[used]
            seen_w[used] += g_w**2
            seen_v[used] += g_v**2
            seen_0 += error.sum() ** 2
            fm.linear[used] -= RATE * g_w / np.sqrt(seen_w[used])
            fm.factors[used] -= RATE * g_v / np.sqrt(seen_v[used])
            fm.constant -= RATE * error.sum() / np.sqrt(seen_0)
    return fm


def _inputs(docs: DataFrame) -> list:
    metadata = F.log1p(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0))) if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.coalesce(F.col("text"), F.lit("")).alias("text"), metadata.alias("metadata")]


def _metadata(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("metadata").cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, f in features(batch.column("text"), _metadata(batch)):
            n = len(f.stats)
            lists = pa.ListArray.from_arrays(pa.array(f.offsets, pa.int32()), pa.array(f.slots, pa.int64()))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * f.stats.shape[1], pa.int32()), pa.array(f.stats.ravel()))
            yield pa.record_batch([batch.column("label").slice(at, n), lists, stats], names=["label", "slots", "stats"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """The machine, or where a class is missing the share of good labels."""
    picked, sizes = sample(labels, "quality", FOLDS, HELD_OUT, per_class)
    if len(sizes) < 2:
        return 1.0 if not sizes else float(sizes.get(1, 0) > 0)
    # at most 2 * per_class rows: bounded by the parameter
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs)).join(F.broadcast(picked), "doc_id")
    rows = own.select("label", "text", "metadata").mapInArrow(_extract, "label int, slots array<long>, stats array<double>").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return sizes[1] / (sizes[0] + sizes[1])
    slots, stats = rows.column("slots").combine_chunks(), rows.column("stats").combine_chunks()
    stats = stats.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    # the order of rows must not depend on how tasks ended
    count = slots.value_lengths().to_numpy()
    f = Features(slots.flatten().to_numpy(), np.r_[0, np.cumsum(count)], stats)
    order = np.lexsort((y, count, *np.nan_to_num(stats).T))
    f = Features(np.concatenate([f.slots[f.offsets[i] : f.offsets[i + 1]] for i in order]), np.r_[0, np.cumsum(count[order])], stats[order])
    y = y[order]
    share = np.array([sizes[c] / max(1, (y == c).sum()) for c in (0, 1)])
    weight = share[y.astype(int)]
    return fit_machine(f, y, weight / weight.mean())


def scored(docs: DataFrame, model, name: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score, a double named ``name``."""
    if isinstance(model, float):
        return docs.select(*keep).withColumn(name, F.lit(model))
    from pyspark.sql.types import DoubleType, StructField, StructType

    model = docs.sparkSession.sparkContext.broadcast(model)
    text, metadata = _inputs(docs)
    text_name, metadata_name = free_name(docs, f"{name}_text"), free_name(docs, f"{name}_metadata")
    inputs = docs.select(*keep, text.alias(text_name), metadata.alias(metadata_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = model.value
        for batch in batches:
            known = batch.column(metadata_name).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
            found = np.zeros(batch.num_rows)
            for at, f in features(batch.column(text_name), known):
                found[at : at + len(f.stats)] = fm.scores(f)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], [*keep, name])

    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())])
    return inputs.mapInArrow(run, schema)


def score(docs: DataFrame, model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(docs, model, "score", ["doc_id"])
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``cut`` or more."""
    name = free_name(docs, "score")
    return scored(docs, model, name, docs.columns).where(F.col(name) >= cut).select(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}

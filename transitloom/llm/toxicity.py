"""Toxicity by class-conditional Kneser-Ney models.

Two models of word bigrams, of toxic and of ordinary text, score every text: the difference of
their log-likelihoods per word decides. Each is interpolated in steps with an absolute discount:

    bigram in the class > distinct left contexts of the word in the class > those of its first letters
    in the class, ``LEVELS`` bytes of them > shared distinct left contexts over all documents

Every count gives ``DISCOUNT`` (or all that it has) to the next step, so a rare expression, or a rare form of a known one,
is smoothed by what the class knows of the words with its beginning, and those by the shared counts; what a class has never seen falls
back on the same shared counts in both models and tells nothing. Near copies of a
text are no evidence of their own: a bigram counts once per class of near copies, as found by
``jaccard_join``. A word's log-ratio counts up to ``CLIP`` either way, and one that repeats the word
before counts nothing. ``DISCOUNT``, ``LEVELS`` and ``SHARES`` were chosen by cross-validation over classes of near
copies inside the training folds; the held-out fold had no part in it.

The shared counts are exact and by word, of the distinct (word before, word) pairs of every document (a left context
is told by 32 bits of its hash): a table that grows with the documents. A task hands on the distinct contexts of a word as one list; those of
the ``COMMON`` words that are most frequent in a 64th of the documents as 8 lists by 3 more bits of the context, so that each is counted in as many tasks.
Which words these are does not change a count. The shared distribution is over the words of the sample, with these counts. Class counts come from a bounded sample of labelled
rows outside the held-out fold (``PER_CLASS`` a class, by a hash of doc_id), and so the model is small enough to
broadcast by that bound. A quarter of the sample's classes of near copies, of each label, is kept
from counting and calibrates the score: a logistic regression on the text's mean log-ratio, its largest
over ``WINDOW`` words, and the shares of words with a log-ratio above each of ``SHARES``. Labels, lang, source and
doc_id are not inputs.

A null text counts as empty; a text without words gets the score of the neutral ratio. Without
labels of both classes every score is the share of toxic labels (0 without any). A label with a single class of near copies
calibrates only. Repeated rows are scored each. Empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import table, written
from .jaccard_join import jaccard_join
from .labelled import fold, logistic, sample

FOLDS, HELD_OUT, CUT = 4, 2, 0.3
PER_CLASS, WINDOW, CLIP = 4096, 24, 6.0
DISCOUNT, LEVELS, SHARES = 3, (8, 5), (2.0, 3.0, 4.0, 5.0)
FEATURES = 2 + len(SHARES)
#: Pairs that a task holds before it hands on the distinct ones; words whose contexts are counted in 8 parts.
PAIRS, COMMON = 8_000_000, 1024


def _tokens(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """``(first row, offsets of words, word, its beginnings, word before)`` as hashes; before the first word stands 0."""
    for at, raw, offsets in words.chunks(text):
        h, rows, starts, ends = words.word_hashes(raw, offsets)
        first = np.searchsorted(rows, np.arange(len(offsets)))
        before = np.r_[np.zeros(min(1, len(h)), np.uint64), h[:-1]]
        before[first[:-1][first[:-1] < first[1:]]] = 0
        yield at, first, h, [words.mix(words.span_hashes(raw, starts, np.minimum(ends, starts + n)) + np.uint64(n)) for n in LEVELS], before


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, word, _, _ in _tokens(batch.column("text")):
            word, n = np.unique(word, return_counts=True)
            yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def common_words(docs: DataFrame) -> np.ndarray:
    """At most ``COMMON`` words, sorted: the most frequent in the texts with one in 64 hashes."""
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(64)) == 0)
    counted = some.mapInArrow(_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "word").limit(COMMON).select("word").toArrow()
    return np.sort(found.column("word").to_numpy().view(np.uint64))


def _contexts(common: np.ndarray):
    """word, part, xs: lists of the distinct left contexts of a word."""

    def lists(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for eighth in range(8):  # of the words: sorting takes little beside what is held
            chosen = [(columns, (columns[0] >> np.uint64(61)) == eighth) for columns in held]
            word, part, x = (np.concatenate([columns[k][own] for columns, own in chosen]) for k in range(3))
            if not len(word):
                continue
            order = np.lexsort((x, part, word))
            word, part, x = word[order], part[order], x[order]
            new = _changes(word, part, x)
            word, part, x = word[new], part[new], x[new]
            rows = np.flatnonzero(_changes(word, part))
            xs = pa.ListArray.from_arrays(pa.array(np.r_[rows, len(x)].astype(np.int32)), pa.array(x.view(np.int32)))
            yield pa.record_batch([pa.array(word[rows].view(np.int64)), pa.array(part[rows].astype(np.int32)), xs], names=["word", "part", "xs"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, word, _, before in _tokens(batch.column("text")):
                if not len(word):
                    continue
                split = _place(word, common) < len(common)
                part = np.where(split, before >> np.uint64(61), np.uint64(0)).astype(np.int8)
                held.append((word, part, ((before >> np.uint64(29)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
                n += len(word)
                if n >= PAIRS:
                    yield from lists(held)
                    n = 0
        if held:
            yield from lists(held)

    return run


def context_counts(docs: DataFrame) -> DataFrame:
    """word, part, n: every word of the documents, and how many distinct words or text starts of each part stand before it."""
    # common_words bounds what goes with the function
    found = docs.select("text").mapInArrow(_contexts(common_words(docs)), "word long, part int, xs array<int>").repartition("word", "part")
    pairs = found.select("word", "part", F.explode("xs").alias("x")).distinct()  # within the partitions that it is in
    return pairs.groupBy("word", "part").agg(F.count("*").alias("n"))


def shared_counts(docs: DataFrame) -> DataFrame:
    """word, n: every word of the documents, and how many distinct words or text starts stand before it."""
    return context_counts(docs).groupBy("word").agg(F.sum("n").alias("n"))


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (word before, word) pairs of each label and class, of texts in the order of their classes."""
    names = ["label", "class_id", "u", "w"]
    none = [np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))]
    held = none
    for batch in batches:
        label, of = batch.column("label").to_numpy().astype(np.int32), batch.column("class_id").to_numpy()
        found = [held]
        for at, first, word, _, before in _tokens(batch.column("text")):
            row = at + np.repeat(np.arange(len(first) - 1), np.diff(first))
            found.append([label[row], of[row], before.view(np.int64), word.view(np.int64)])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        if not len(order):
            continue
        new = _changes(*columns)
        columns = [c[new] for c in columns]
        last = columns[1] == of[-1]  # that class may go on
        held = [c[last] for c in columns]
        yield pa.record_batch([pa.array(c[~last]) for c in columns], names=names)
    yield pa.record_batch([pa.array(c) for c in held], names=names)


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of some texts with their beginnings."""
    for batch in batches:
        for _, _, word, starts, _ in _tokens(batch.column("text")):
            word, one = np.unique(word, return_index=True)
            yield pa.record_batch([pa.array(x.view(np.int64)) for x in (word, *(s[one] for s in starts))], names=["w", "a", "b"])


def _place(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of hashes among sorted keys, one behind the last for those that are not there."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.searchsorted(keys, h)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == h, at, len(keys))


@dataclass
class Step:
    """Words or beginnings of one length: sorted hashes, of each class what they keep and what all leave, and their share of the next step's shared counts.

    The arrays have one place more than there are keys, for all others.
    """

    keys: np.ndarray
    kept: np.ndarray
    rest: np.ndarray
    share: np.ndarray


@dataclass
class KneserNey:
    """steps: words, then beginnings from the longest. bigram, left: of each class what a bigram keeps and what is left after a word,
    by place among (word before, word) and among the words before."""

    steps: list[Step]
    pairs: np.ndarray
    bigram: np.ndarray
    before: np.ndarray
    left: np.ndarray

    def ratios(self, word: np.ndarray, starts: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        """log P(word | before, toxic) - log P(word | before, ordinary) of each word, within the clip."""
        at = [_place(h, step.keys) for h, step in zip([word, *starts], self.steps, strict=True)]
        u, b = _place(before, self.before), _place(_pair(before, word), self.pairs)
        out = []
        for c in (0, 1):
            p: np.ndarray | float = 1.0
            for step, k in zip(reversed(self.steps), reversed(at), strict=True):
                p = step.kept[c][k] + step.rest[c] * step.share[k] * p
            out.append(np.log(self.bigram[c][b] + self.left[c][u] * p))
        return np.where(word == before, 0.0, np.clip(out[1] - out[0], -CLIP, CLIP))


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mix(words.mix(u + np.uint64(1)) + w)


def _step(keys: np.ndarray, counts: np.ndarray, shared: np.ndarray, under: np.ndarray) -> Step:
    """keys with the classes' counts, shared counts, and those of the beginning they come under."""
    all_of = np.maximum(counts.sum(1, keepdims=True), 1)
    kept = np.maximum(counts - DISCOUNT, 0) / all_of
    return Step(keys, np.c_[kept, np.zeros(2)], 1 - kept.sum(1), np.r_[shared / under, 1.0])  # what both classes lack cancels


def kneser_ney(known: pa.Table, bigrams: pa.Table, contexts: pa.Table) -> KneserNey:
    """known: w, a, b (its beginnings), n (shared), n0, n1 (contexts in the classes); bigrams: label, u, w, n above the discount;
    contexts: label, u, n (of all its bigrams), kept (above the discount)."""
    column = lambda t, k: t.column(k).to_numpy()
    order = np.argsort(column(known, "w").view(np.uint64))
    keys = [column(known, k).view(np.uint64)[order] for k in ("w", "a", "b")]
    shared, counts = column(known, "n")[order].astype(float), np.stack([column(known, k)[order] for k in ("n0", "n1")]).astype(float)
    steps = []
    for k in range(3):
        if k == 2:
            under = np.full(len(shared), max(shared.sum(), 1.0))
        else:
            found, place = np.unique(keys[k + 1], return_inverse=True)
            up = np.bincount(place, shared, len(found))
            under = up[place]
        steps.append(_step(keys[k], counts, shared, under))
        if k < 2:
            one = np.unique(place, return_index=True)[1]
            keys = [x[one] for x in keys]
            counts, shared = np.stack([np.bincount(place, c, len(found)) for c in counts]), up

    before = np.unique(column(contexts, "u").view(np.uint64))
    left = np.ones((2, len(before) + 1))
    at = np.searchsorted(before, column(contexts, "u").view(np.uint64))
    left[column(contexts, "label"), at] = 1 - column(contexts, "kept") / column(contexts, "n")
    total = np.ones((2, len(before) + 1))
    total[column(contexts, "label"), at] = column(contexts, "n")
    u, w = (column(bigrams, k).view(np.uint64) for k in "uw")
    pairs, at = np.unique(_pair(u, w), return_inverse=True)
    bigram = np.zeros((2, len(pairs) + 1))
    label = column(bigrams, "label")
    bigram[label, at] = (column(bigrams, "n") - DISCOUNT) / total[label, np.searchsorted(before, u)]
    return KneserNey(steps, pairs, bigram, before, left)


def class_tables(own: DataFrame, counts: DataFrame) -> tuple[pa.Table, pa.Table, pa.Table]:
    """What ``kneser_ney`` takes, from texts (label, class_id, text) and shared counts (word, n), which add up; bounded by the texts' words."""
    by_class = own.select("label", "class_id", "text").repartition("class_id").sortWithinPartitions("class_id")
    types = by_class.mapInArrow(_bigrams, "label int, class_id long, u long, w long")
    types = written(types.groupBy("label", "u", "w").agg(F.count("*").alias("n")), "bigrams")
    over = F.greatest(F.col("n") - DISCOUNT, F.lit(0))
    contexts = types.groupBy("label", "u").agg(F.sum("n").alias("n"), F.sum(over).alias("kept")).where("kept > 0")
    by_word = types.groupBy("w").agg(*(F.count_if(F.col("label") == c).alias(f"n{c}") for c in (0, 1)))
    starts = own.select("text").mapInArrow(_beginnings, "w long, a long, b long").distinct()
    # the texts' words bound the model that is broadcast, and these
    shared = counts.withColumnRenamed("word", "w").join(F.broadcast(by_word.select("w")), "w").groupBy("w").agg(F.sum("n").alias("n"))
    known = by_word.join(starts, "w").join(shared, "w")
    return known.select("w", "a", "b", "n", "n0", "n1").toArrow(), types.where(f"n > {DISCOUNT}").toArrow(), contexts.toArrow()


def _features(ratio: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: mean ratio, largest mean of a window, shares of words above ``SHARES``, all 0 without words."""
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES))
    some = n > 0
    out[some, 0] = words.row_sums(ratio, first)[some] / n[some]
    out[:, 1] = out[:, 0]
    for k, above in enumerate(SHARES):
        out[some, 2 + k] = words.row_sums((ratio > above).astype(float), first)[some] / n[some]
    long = np.flatnonzero(n > WINDOW)
    if len(long):
        total = np.r_[0.0, np.cumsum(ratio)]
        mean = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
        ends = np.stack([first[long], first[long + 1] - WINDOW + 1], 1).ravel()
        out[long, 1] = np.maximum.reduceat(np.r_[mean, -np.inf], ends)[::2]
    return out


def _scorer(model, finish):
    """finish: features of a batch's rows, and the batch, to a record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kn = model.value
        for batch in batches:
            found = np.zeros((batch.num_rows, FEATURES))
            for at, first, word, starts, before in _tokens(batch.column("text")):
                found[at : at + len(first) - 1] = _features(kn.ratios(word, starts, before), first)
            yield finish(found, batch)

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """``(model or None, calibration or share)`` from all documents and a bounded sample of labels."""
    picked, sizes = sample(labels, "toxic", FOLDS, HELD_OUT, per_class)
    if len(sizes) < 2:
        return None, float(sizes.get(1, 0) > 0)
    # at most 2 * per_class rows: bounded by the parameter
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    own = written(own.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")), "labelled-texts")
    classes = jaccard_join(own).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    own = own.join(classes, "doc_id")
    ranked = own.groupBy("class_id").agg(F.max("label").alias("of"))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("class_id", F.lit(5)), "class_id"))
    own = written(own.join(ranked.select("class_id", (rank % 4 == 1).alias("calibrates")), "class_id"), "labelled-classes")
    counts = written(context_counts(docs), "shared-counts")
    model = docs.sparkSession.sparkContext.broadcast(kneser_ney(*class_tables(own.where("not calibrates"), counts)))
    names = [f"f{k}" for k in range(FEATURES)]

    def features(found: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("label"), *(pa.array(x) for x in found.T)], names=["label", *names])

    schema = "label int, " + ", ".join(f"{x} double" for x in names)
    rows = own.where("calibrates").select("label", "text").mapInArrow(_scorer(model, features), schema).toArrow()
    x = np.stack([rows.column(k).to_numpy() for k in names], 1)
    y = rows.column("label").to_numpy()
    if len(set(y.tolist())) < 2:  # the documents hold texts of one label only
        return None, sizes[1] / (sizes[0] + sizes[1])
    share = np.array([sizes[c] / max(1, (y == c).sum()) for c in (0, 1)])
    scale = np.maximum(x.std(0), 1e-9)
    weights = logistic(x / scale, y, share[y] / share[y].mean())
    return model, (weights, scale)


def score(docs: DataFrame, model, calibration, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    if model is None:
        scored = own.select("doc_id", "held_out", F.lit(float(calibration)).alias("score"))
    else:
        weights, scale = calibration

        def finish(found: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
            z = np.clip((found / scale) @ weights[:-1] + weights[-1], -30, 30)
            return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "held_out", "score"])

        scored = own.mapInArrow(_scorer(model, finish), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}

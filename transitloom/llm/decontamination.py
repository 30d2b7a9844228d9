"""Benchmark decontamination: BM25 over test items with block-max pruning, then question and answer overlap.

The test items, cut evenly into parts of at most ``STRIDE`` words, are the indexed collection; every passage of every document
is a query. A passage is ``2 * STRIDE`` words, one begins every ``STRIDE`` words, and so a part that stands in
a text stands whole in one of its passages. A BM25 score counts each distinct word of the passage
once and is divided by the part's score for its own text, so 1 is a full match.

All parts at or above ``THRESHOLD`` are retrieved, exactly. As in WAND, a part's most common words that
together cannot exceed ``TAIL`` are left out at first; the lists of the rest are held in blocks of ``BLOCK``
parts with the greatest impact of each. A passage adds up the block maxima of its words; only
blocks that with their greatest tail could reach the threshold have their postings added up, and
only parts that could reach it with their own tail are scored in full. An item's score is the sum over its parts of the best
score retrieved in a stretch of passages as long as the item, weighed by the parts' scores for their own texts;
it must reach ``THRESHOLD``, too. So an item is found at any length; one of up to ``STRIDE`` words is a single part.

Retrieved pairs are verified on word order: of the question's runs of three words, and of the
answer's, at least ``OVERLAP`` must stand in the stretch (with a margin of ``STRIDE`` words around it). An item
is split at an "answer:" or "a:" marker, else behind its last question mark, else before its last
sentence of three words or more, else at three quarters of its words; parts of one or two words are compared as they are.

The index is built by Spark and broadcast while it has at most ``POSTINGS`` postings; a larger set of
items is cut into slices by a hash, each within the bound. The documents meet slice after slice: a slice is sent and what it
finds written before the next one is made.

Null and empty texts match nothing, as do items without words. Repeated items count once; an item_id with several texts, or null, is
reported with each text; repeated documents are reported each. Of stretches with equal scores that pass, the first is reported. Texts and
items of any length are taken whole. Empty tables give no hits. Extra columns are ignored by ``contaminated``
and carried by ``decontaminated``.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import table, written

K1, B = 1.2, 0.75
THRESHOLD, TAIL, OVERLAP = 0.5, 0.25, 0.5
STRIDE, BLOCK, POSTINGS = 64, 8, 2_000_000
_ANSWER = re.compile(r"(?is)(?:^|\s)(?:answer|a)\s*:\s+(?!.*(?:^|\s)(?:answer|a)\s*:\s)")


def split_item(text: str) -> tuple[str, str]:
    """``(question, answer)``."""
    if m := _ANSWER.search(text):
        return text[: m.start()], text[m.end() :]
    at = text.rstrip().rfind("?") + 1
    if 0 < at < len(text.rstrip()):
        return text[:at], text[at:]
    ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.rstrip())]
    for end in reversed(ends):
        if len(_words_of(text[end:])) >= 3 and len(_words_of(text[:end])):
            return text[:end], text[end:]
    parts = re.split(r"(\s+)", text.strip())
    cut = (len(parts) + 1) // 2 * 3 // 4 * 2
    return "".join(parts[:cut]), "".join(parts[cut:])


def _words_of(text: str) -> np.ndarray:
    return next((words.word_hashes(raw, offsets)[0] for _, raw, offsets in words.chunks(pa.array([text]))), np.zeros(0, np.uint64))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            parts = [_words_of(x) for x in split_item(text)]
            every = np.concatenate(parts)
            if len(every):
                yield pa.record_batch(
                    [pa.array([item_id], pa.int64()), *(pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in parts)], names=["item_id", "question", "answer"]
                )


def build_index(items: DataFrame) -> DataFrame:
    """One row an item: item_id, question and answer as word hashes, and its parts with their terms and normalised impacts."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text")).distinct()
    parsed = written(texts.mapInArrow(_postings, "item_id long, question array<long>, answer array<long>"), "items")
    parsed = parsed.withColumn("item", F.monotonically_increasing_id())
    size = F.size("question") + F.size("answer")
    length = F.ceil(size / F.ceil(size / STRIDE))
    places = parsed.select("item", size.alias("size"), length.alias("length"), F.posexplode(F.concat("question", "answer")).alias("place", "term"))
    part = F.floor(F.col("place") / F.col("length"))
    places = places.select("item", part.alias("part"), F.least("length", F.col("size") - part * F.col("length")).alias("size"), "term")
    terms = written(places.groupBy("item", "part", "size", "term").agg(F.count("*").alias("tf")), "item-terms")
    n, mean = terms.select("item", "part", "size").distinct().agg(F.count("*"), F.avg("size")).first()
    frequency = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
    weighted = terms.join(frequency, "term").select("item", "part", F.struct(impact.alias("weight"), "term").alias("t"))
    lists = weighted.groupBy("item", "part").agg(F.sort_array(F.collect_list("t"), False).alias("t"))  # a part's own words
    total = F.aggregate("t", F.lit(0.0), lambda s, x: s + x["weight"])
    one = F.struct("part", total.alias("total"), F.col("t.term").alias("terms"), F.transform("t", lambda x: x["weight"] / total).alias("weights"))
    lists = lists.groupBy("item").agg(F.sort_array(F.collect_list(one)).alias("parts"))  # an item's own parts
    return written(parsed.join(lists, "item"), "index")


@dataclass
class Index:
    """A slice of the items, in memory: flat lists by term and by block, and the items themselves."""

    ids: pa.Array
    #: question and answer of each item
    texts: list[tuple[np.ndarray, np.ndarray]]
    #: of each part: its item, its share of the item's score, its terms and their weights
    item_of: np.ndarray
    share: np.ndarray
    own: list[tuple[np.ndarray, np.ndarray]]
    tail: np.ndarray = field(init=False)
    terms: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.n_parts = np.bincount(self.item_of, minlength=len(self.ids))
        self.tail = np.zeros(len(self.own))
        term, part, weight = [], [], []
        for i, (t, w) in enumerate(self.own):  # weights descend: the tail is at the end
            rest = np.cumsum(w[::-1])[::-1]
            first = int(np.argmax(rest <= TAIL)) if (rest <= TAIL).any() else len(w)
            self.tail[i] = rest[first] if first < len(w) else 0.0
            term.append(t[:first]), weight.append(w[:first]), part.append(np.full(first, i))
        term, part, weight = (np.concatenate(x) for x in (term, part, weight))
        order = np.lexsort((part, term))
        self.term_of, self.part, self.weight = term[order], part[order], weight[order]
        self.terms, self.first = np.unique(self.term_of, return_index=True)
        self.first = np.r_[self.first, len(self.term_of)]
        # a list's blocks: where the term or the block of parts changes
        block = self.part // BLOCK
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (self.term_of[1:] != self.term_of[:-1])
        at = np.flatnonzero(new)
        self.block_at, self.block = np.r_[at, len(block)], block[at]
        self.block_max = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.block_first = np.searchsorted(at, self.first)
        self.block_tail = np.maximum.reduceat(self.tail, np.arange(0, len(self.tail), BLOCK)) if len(self.tail) else np.zeros(0)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges first to last - 1, end to end, and which range each is of."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()), of


def _runs(h: np.ndarray) -> np.ndarray:
    return words.shingles(h, np.zeros(len(h), np.int64), 3)[0]


def _share(part: np.ndarray, passage: np.ndarray) -> float:
    if len(part) == 0:
        return 1.0
    if len(part) < 3:
        k = len(part)
        return float(any((passage[i : i + k] == part).all() for i in range(len(passage) - k + 1)))
    return float(np.isin(_runs(part), _runs(passage)).mean()) if len(passage) >= 3 else 0.0


def search(index: Index, h: np.ndarray, rows: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
    """``(row, item, score, question, answer, first word, last word)`` of a chunk's words ``h`` in their rows."""
    if not len(h) or not len(index.terms):
        return []
    change = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    begin = np.repeat(change, np.diff(np.r_[change, len(rows)]))
    at = np.searchsorted(index.terms, h)
    hit = np.flatnonzero(index.terms[np.minimum(at, len(index.terms) - 1)] == h)
    if not len(hit):
        return []
    # segments are numbered through; passage p of a text is its segments p and p + 1
    segments = np.r_[0, np.cumsum((np.diff(np.r_[change, len(rows)]) - 1) // STRIDE + 1)]
    text = np.searchsorted(change, hit, "right") - 1
    within = (hit - begin[hit]) // STRIDE
    passage = np.r_[segments[text] + within, (segments[text] + within - 1)[within > 0]]
    term = np.r_[at[hit], at[hit][within > 0]]
    key = np.unique(passage * len(index.terms) + term)
    passage, term = key // len(index.terms), key % len(index.terms)

    b, of = _spread(index.block_first[term], index.block_first[term + 1])
    n_blocks = len(index.block_tail)
    pair, back = np.unique(passage[of] * n_blocks + index.block[b], return_inverse=True)
    bound = np.bincount(back, index.block_max[b]) + index.block_tail[pair % n_blocks]
    live = bound[back] >= threshold - 1e-9
    p, of_block = _spread(index.block_at[b[live]], index.block_at[b[live] + 1])
    n_parts = len(index.own)
    pair, back = np.unique(passage[of[live]][of_block] * n_parts + index.part[p], return_inverse=True)
    bound = np.bincount(back, index.weight[p], len(pair)) + index.tail[pair % n_parts]
    hits: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for k in pair[bound >= threshold - 1e-9].tolist():
        place, part = divmod(k, n_parts)
        i = int(np.searchsorted(segments, place, "right")) - 1
        hi = int(change[i + 1]) if i + 1 < len(change) else len(rows)
        at_segment = place - int(segments[i])
        first = int(change[i]) + at_segment * STRIDE
        terms, weights = index.own[part]
        score = float(weights[np.isin(terms, h[first : min(hi, first + 2 * STRIDE)])].sum())
        if score >= threshold:
            hits.setdefault((i, int(index.item_of[part])), []).append((at_segment, part, score))
    out = []
    for (i, item), found in sorted(hits.items()):
        lo, hi = int(change[i]), int(change[i + 1]) if i + 1 < len(change) else len(rows)
        for score, segment, last in _stretches(found, int(index.n_parts[item]), index.share):
            if score < threshold:
                break
            first, end = lo + segment * STRIDE, min(hi, lo + (last + 2) * STRIDE)
            wide = h[max(lo, first - STRIDE) : min(hi, end + STRIDE)]
            shares = tuple(_share(part, wide) for part in index.texts[item])
            if min(shares) >= overlap:
                out.append((int(rows[lo]), item, score, *shares, first - lo, end - lo))
                break
    return out


def _stretches(hits: list[tuple[int, int, float]], n_parts: int, share: np.ndarray) -> list[tuple[float, int, int]]:
    """``(score, first, last segment)`` of the stretches from each hit ``(segment, part, score)`` on, best first."""
    hits.sort()
    wide = n_parts + 1 if n_parts > 1 else 0
    out = []
    # of each part, the segments of its hits within the stretch with scores that descend: the first is the best
    best: dict[int, deque] = {}
    end = 0
    for k, (segment, part, _) in enumerate(hits):
        while end < len(hits) and hits[end][0] <= segment + wide:
            held = best.setdefault(hits[end][1], deque())
            while held and held[-1][1] < hits[end][2]:
                held.pop()
            held.append((hits[end][0], hits[end][2]))
            end += 1
        for held in best.values():
            while held and held[0][0] < segment:
                held.popleft()
        if k and hits[k - 1][0] == segment:
            continue
        out.append((min(1.0, float(sum(share[p] * held[0][1] for p, held in best.items() if held))), segment, hits[end - 1][0]))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def slices(items: DataFrame, postings: int = POSTINGS) -> Iterator:
    """``(broadcast index, whether it is the last)``, each of at most about ``postings`` postings (one item at least) and freed when the next is asked for."""
    context = items.sparkSession.sparkContext
    index = build_index(items)
    size = F.aggregate("parts", F.lit(0), lambda n, x: n + F.size(x["terms"]))
    total = index.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    many = max(1, -(-total // postings))
    for k in range(many):
        part = index if many == 1 else index.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(many)) == k)
        rows = part.orderBy("item_id", "item").select("item_id", "question", "answer", "parts").toArrow()
        if not rows.num_rows:
            continue
        hashes = lambda x: np.array(x, np.int64).view(np.uint64)
        texts = [tuple(map(hashes, x)) for x in zip(*(rows.column(c).to_pylist() for c in ("question", "answer")), strict=True)]
        item_of, share, own = [], [], []
        for i, parts in enumerate(rows.column("parts").to_pylist()):
            whole = sum(x["total"] for x in parts)
            for x in parts:
                item_of.append(i), share.append(x["total"] / whole), own.append((hashes(x["terms"]), np.array(x["weights"])))
        made = context.broadcast(Index(rows.column("item_id").combine_chunks(), texts, np.array(item_of), np.array(share), own))
        yield made, k == many - 1
        made.unpersist()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, postings: int = POSTINGS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, score, question_overlap, answer_overlap, first_word, last_word."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, last_word long"
    names = [c.split()[0] for c in schema.split(", ")]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index, last in slices(items, postings):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, raw, offsets in words.chunks(batch.column("text")):
                    h, rows, _, _ = words.word_hashes(raw, offsets)
                    hits = search(index.value, h, rows, threshold, overlap)
                    if hits:
                        row, item, *rest = zip(*hits, strict=True)
                        ids = batch.column("doc_id").take(pa.array([at + r for r in row]))
                        yield pa.record_batch([ids, index.value.ids.take(pa.array(item)), *(pa.array(x) for x in rest)], names=names)

        found = own.mapInArrow(run, schema)
        out = out.unionAll(found if last else written(found, "hits"))
    return out


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, postings: int = POSTINGS) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item is found; what is left of one slice is written before the next."""
    out = docs
    names = docs.columns
    for index, last in slices(items, postings):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, raw, offsets in words.chunks(batch.column(len(names))):
                    h, rows, _, _ = words.word_hashes(raw, offsets)
                    keep[[at + x[0] for x in search(index.value, h, rows, threshold, overlap)]] = False
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(keep))

        lowered = "".join(sorted(names, key=len)[-1:]) + "_lower"
        left = out.select(*names, F.lower("text").alias(lowered)).mapInArrow(run, docs.schema)
        out = left if last else written(left, "clean")
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL: dict[str, str] = {}

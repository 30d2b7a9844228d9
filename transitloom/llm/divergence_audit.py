"""Source divergence audit: how the words of each source differ from its language's and from other sources', ranked.

A language keeps the terms that are in ``MIN_DOCS`` of its documents or more. With c occurrences of a kept term in
a group (a source within a language, or a whole language), N of all V kept terms, its smoothed
probability in billionths is p = 1 + floor(10**9 (c + 1) / (N + V)); the divergence of a p from a q in one term is
f(p, q) = floor((p - q)**2 / q). All arithmetic is on integers.

1. One Arrow pass counts the terms of every text, combined within a task; one exchange by (lang, term) adds them up, with
   the documents that hold a term.
2. Pairs of sources: f summed over all kept terms. A term that neither source holds contributes the same
   baseline each time, so only cells with occurrences are looked at: a cell's effect against the other source's
   baseline goes by (source, count), of which there are few, and what remains where both sources hold a
   term is added up in blocks of terms, inside a task, which emits sums and no pairs of cells.
3. Over-used terms: of a group's terms whose p exceeds its language's, the ``TOP`` with the largest f. They are found by radix
   selection: histograms over 16 bits of the values at a time narrow each group's k-th value down, and where more
   terms share that value than have room, histograms over two UTF-8 bytes at a time find the last term that has. Only what is selected is
   sorted.

Terms are runs of ASCII letters and characters beyond ASCII; only A-Z are lower-cased. Null text, lang and source count
as empty. Every group that occurs is audited, one without terms too; a language without kept terms has V = 0, pairs of value
0 and no terms. Repeated rows are documents of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import LOWER, UPPER, table, written

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Rows of counts a task holds before it hands them on, cells of a block of terms, and parts of a join that a group's cells are dealt over.
HELD, BLOCK_CELLS, SALTS = 300_000, 50_000, 16

_letter = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _letter[_b] = _b + 32 if 65 <= _b <= 90 else _b
_letter.setflags(write=False)

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.large_string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a chunk of texts, dictionary-encoded, and the row of each."""
    folded = _letter[raw]
    inside = folded != 0
    starts, ends = words._bounds(inside, offsets)
    bounds = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(folded[inside])))
    return terms.dictionary_encode(), np.searchsorted(offsets, starts, "right") - 1


def _added(parts: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of a task's texts."""
    parts: list[pa.Table] = []
    rows = 0
    for batch in batches:
        langs, sources = batch.column("lang").cast(pa.string()), batch.column("source").cast(pa.string())
        for at, raw, offsets in words.chunks(batch.column("text")):
            encoded, row = _terms(raw, offsets)
            size = len(encoded.dictionary)
            if not size:
                continue
            count = len(offsets) - 1
            pairs = pa.table({"l": langs.slice(at, count), "s": sources.slice(at, count), "i": np.arange(count)})
            kinds = pairs.group_by(["l", "s"]).aggregate([("i", "min"), ("i", "list")])
            group = np.zeros(count, np.int64)
            for g, members in enumerate(kinds["i_list"].to_pylist()):
                group[members] = g
            cells, n = np.unique(row * size + encoded.indices.to_numpy(), return_counts=True)
            keys, of = np.unique(group[cells // size] * size + cells % size, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, of, n)
            first = pa.array(kinds["i_min"].to_numpy()[keys // size] + at)
            term = encoded.dictionary.take(pa.array(keys % size))
            parts.append(pa.table([langs.take(first), sources.take(first), term, pa.array(total), pa.array(np.bincount(of, minlength=len(keys)))], schema=_COUNTS))
            rows += len(keys)
        if rows > HELD:
            parts = [_added(parts)]
            rows = parts[0].num_rows
            if 2 * rows > HELD:
                yield from parts[0].combine_chunks().to_batches(max_chunksize=100_000)
                parts, rows = [], 0
    if parts:
        yield from _added(parts).combine_chunks().to_batches(max_chunksize=100_000)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, source, n, and the whole language's lang_n, of every kept term and source that holds it; lead is 1 in one row of a term."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    cells = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    cells = cells.withColumns(
        {
            "lang_n": F.sum("n").over(whole),
            "lang_docs": F.sum("docs").over(whole),
            "lead": (F.row_number().over(whole.orderBy("source")) == 1).cast("long"),
        }
    )
    return cells.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n", "lead")


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 1) / (total + terms)) in whole numbers; 1 where there are no terms."""
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))
    return F.when(terms > 0, share + 1).otherwise(F.lit(1).cast("long"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _joined(cells: DataFrame, few: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """Cells with the row of ``few`` that their key names; a key's cells are dealt over ``SALTS`` tasks where Spark does not broadcast."""
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cells.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(few, [*on, "salt"]).drop("salt")


def _groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, total (N), terms (V), lang_total, base (p of a term without occurrences) of every group that occurs."""
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("lead").alias("terms"))
    rows = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    return rows.withColumn("base", _p(F.lit(0), F.col("total"), F.col("terms")))


def _whole_f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _shared(cells: pd.DataFrame) -> pd.DataFrame:
    """Of a block of terms: for each two sources, what terms that both hold add to the effects of each against the other's baseline."""
    cells = cells.sort_values(["term", "source"])
    names, source = np.unique(cells["source"].to_numpy(object), return_inverse=True)
    term = np.unique(cells["term"].to_numpy(object), return_inverse=True)[1]
    p, base = cells["p"].to_numpy(np.int64), cells["base"].to_numpy(np.int64)
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for apart in range(1, len(cells)):
        near = np.flatnonzero(term[:-apart] == term[apart:])
        if not len(near):
            break
        for a, b in ((near, near + apart), (near + apart, near)):
            more = _whole_f(p[a], p[b]) - _whole_f(p[a], base[b]) - _whole_f(base[a], p[b]) + _whole_f(base[a], base[b])
            keys, of = np.unique(np.r_[keys, source[a] * len(names) + source[b]], return_inverse=True)
            added = np.zeros(len(keys), np.int64)
            np.add.at(added, of, np.r_[sums, more])
            sums = added
    return pd.DataFrame({"lang": cells["lang"].iloc[0], "source": names[keys // len(names)], "item": names[keys % len(names)], "value": sums})


def pair_divergence(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: f of a source's p from another's (the item's) q, summed over all kept terms of the language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    own = groups.select("lang", "source", "base", "terms")
    of_pair = F.col("source") != F.col("item")
    baseline = _joined(own, other, ["lang"], F.col("source")).where(of_pair)
    baseline = baseline.select("lang", "source", "item", (F.col("terms") * _f(F.col("base"), F.col("item_base"))).alias("value"))

    kinds = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("alike"))
    kinds = _joined(kinds, groups.select("lang", "source", "total", "terms", "base"), ["lang", "source"], F.col("n"))
    kinds = kinds.withColumn("p", _p(F.col("n"), F.col("total"), F.col("terms")))
    against = _joined(kinds, other, ["lang"], F.struct("source", "n")).where(of_pair)
    p, base, q = F.col("p"), F.col("base"), F.col("item_base")
    sums = against.groupBy("lang", "source", "item").agg(
        F.sum(F.col("alike") * (_f(p, q) - _f(base, q))).alias("as_p"), F.sum(F.col("alike") * (_f(q, p) - _f(q, base))).alias("as_q")
    )
    alone = sums.select(
        "lang", F.explode(F.array(F.struct("source", "item", F.col("as_p").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("as_q").alias("value")))).alias("e")
    ).select("lang", "e.*")

    sizes = counts.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_CELLS).cast("long").alias("blocks"))
    few = groups.select("lang", "source", "total", "terms", "base").join(sizes, "lang")
    cells = _joined(counts, few, ["lang", "source"], F.col("term"))
    cells = cells.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", _p(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "base")
    both = cells.groupBy("lang", "block").applyInPandas(_shared, "lang string, source string, item string, value long")
    return baseline.union(alone).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _narrowed(hist: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of each group's histogram (digit, n) and its room: the digit in which the room ends, n rows of which have the room that is left."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(order))
    hist = hist.withColumn("before", upto - F.col("n"))
    return hist.where((F.col("before") < F.col("room")) & (F.col("before") + F.col("n") >= F.col("room"))).withColumn("room", F.col("room") - F.col("before"))


def top_rows(rows: DataFrame, keys: list[str], value: str, item: str, k: int) -> DataFrame:
    """The k rows of each group with the largest values (whole numbers from 0 on); of equals the first items by their UTF-8 bytes.

    Items are distinct within a group. Nothing is sorted: each round is a histogram, combined before its exchange, of at
    most 65,536 digits for a group. rows should be a written table, as it is read in every round.
    """
    spread = F.col(item)
    state = None
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(F.col(value), shift).bitwiseAND(0xFFFF).alias("digit")
        if state is None:
            hist = rows.groupBy(*keys, digit).agg(F.count("*").alias("n")).withColumn("room", F.lit(k).cast("long")).withColumn("high", F.lit(0).cast("long"))
        else:
            inside = _joined(rows, state.select(*keys, "high", "room"), keys, spread).where(F.shiftright(F.col(value), shift + 16) == F.col("high"))
            hist = inside.groupBy(*keys, "high", "room", digit).agg(F.count("*").alias("n"))
        found = _narrowed(hist, keys, F.col("digit").desc())
        state = written(found.select(*keys, (F.col("high") * 65536 + F.col("digit")).alias("high"), "room", "n"), "radix-values")
    # high is now the k-th value, and room of the n rows that have it are wanted; groups of fewer rows have no state
    bounds = state.where("room = n").select(*keys, F.lit(None).cast("binary").alias("bound"), F.lit(0).alias("bytes"))
    open_groups, at = state.where("room < n").select(*keys, "high", "room", F.lit(b"").alias("prefix")), 1
    while not open_groups.isEmpty():
        head = F.substring(F.col(item).cast("binary"), 1, at + 1)
        inside = _joined(rows, open_groups, keys, spread).where((F.col(value) == F.col("high")) & (F.substring(F.col(item).cast("binary"), 1, at - 1) == F.col("prefix")))
        hist = inside.groupBy(*keys, "high", "room", head.alias("digit")).agg(F.count("*").alias("n"))
        found = written(_narrowed(hist, keys, F.col("digit")), "radix-bytes")
        bounds = bounds.union(found.where("room = n").select(*keys, F.col("digit").alias("bound"), F.lit(at + 1).alias("bytes")))
        open_groups, at = found.where("room < n").select(*keys, "high", "room", F.col("digit").alias("prefix")), at + 2
    least = state.select(*keys, "high").join(bounds, keys)
    everyone = rows.select(*keys).distinct().join(least, keys, "left")
    tied = (F.col(value) == F.col("high")) & (F.col("bound").isNull() | (F.expr(f"substring(cast(`{item}` as binary), 1, bytes)") <= F.col("bound")))
    return _joined(rows, everyone, keys, spread).where(F.col("high").isNull() | (F.col(value) > F.col("high")) | tied).select(rows.columns)


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair``, ``term``), item, value and rank of every pair of sources and of each group's over-used terms."""
    counts = written(term_counts(docs, min_docs), "term-counts")
    groups = written(_groups(docs, counts), "audit-groups")
    pairs = pair_divergence(counts, groups)
    cells = _joined(counts, groups, ["lang", "source"], F.col("term"))
    p, q = _p(F.col("n"), F.col("total"), F.col("terms")), _p(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    over = written(over.select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value")), "over-used")
    terms = top_rows(over, ["lang", "source"], "value", "item", top)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").union(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    return both.withColumn("rank", rank)


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


QUERIES = {"op12_divergence_audit": op12_divergence_audit}
ORACLE_SQL = {
    "op12_divergence_audit": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), tokens AS (
  SELECT row_no, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT row_no) >= {MIN_DOCS}
), cells AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
  SELECT lang, CAST(sum(lang_n) AS HUGEINT) AS lang_total, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, CAST(coalesce(t.total, 0) AS HUGEINT) AS total, coalesce(l.v, 0) AS v, l.lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source) t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN langs l ON g.lang = l.lang
), whole AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + {SCALE} * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p, 1 + {SCALE} * (k.lang_n + 1) // (g.lang_total + g.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM whole a JOIN whole b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM whole WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
}

"""Chat formatting by quotation linking.

Messages quote one another in e-mail style: lines that begin with one or more ``>``, the level of a line
being their number (spaces between them are allowed). A message's lines are cut into runs of one
level; a run of level k is a passage quoted at depth k, the runs of level 0 are the message's own
words. Attribution lines ("On ... wrote:") directly before a quote are part of it and go with it.

Passages are normalised (letters and digits, lower-cased, one space between words) and hashed. A
message offers for linking its own text as a whole, each of its own paragraphs, and any run of
consecutive own lines (lines without words do not count). Of a message's runs only those of 2, 4, 8 ... lines are
hashed; a quote of other length meets a message where its first and its last such run stand at the right
distance. Both sides are combined by hash before they meet, so that however often a passage is quoted or
written, the equi-join sees a hash from each side once. Quotes that find nothing in this way, as those that were wrapped anew or
begin or end within a line, are looked for once more by their words alone: of all messages the runs of as many words as such
quotes' longest runs of 2, 4, 8 ... words have are hashed, and what is asked for stays. A quote is linked to the latest earlier message of
its own conversation that offers the passage, and else, if it has ``LEAST_WORDS`` words (a parameter), to the earliest
message of any other; a message's
parent is the message that its first quote of level 1 is linked to within the conversation, and
without one the message before it.

Each conversation is then ordered by replies: every message after its parent, siblings by turn, a
message's whole branch before its next sibling. Messages that each reply to the one before form a
run, which stays together; behind a run come the branches off it, those off later messages
first. Runs know the run they branch off, and their paths to the root are found by doubling: each
round joins the oldest known ancestor with what that one knows, and halves the rounds left. A
conversation's messages are numbered in parts of ``PART`` turns, so a very long one is not one task.

Rows: one per message, its text without quotes. A null text counts as empty; a null turn counts as
after all others; rows that agree in conversation and turn are told apart by role and text. A null
conv_id is a conversation of its own. Empty input gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import table, written

_LEVEL = re.compile(r"^\s{0,3}((?:>\s?)+)")
_ATTRIBUTION = re.compile(r"^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$", re.I)
_OMITTED = re.compile(r"\[\s*(?:\.{3}|…|snip|snipped)\s*\]|\(\s*(?:\.{3}|…)\s*\)|<snip>|^\s*(?:\.{3}|…)\s*$", re.I)
#: Words that a passage must have to be linked to another conversation, and turns of a part.
LEAST_WORDS, PART = 4, 4096


def _conv(conv_id: str):
    """conv_id as a key without nulls."""
    return F.coalesce(F.col(conv_id), F.lit(-(2**63)))


def parse_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """``(own text, [(level, passage)])``, passages in the order of the message."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    last, cut = 0, False
    for line in text.split("\n"):
        m = _LEVEL.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if last == 0:
                back = len(own)
                while back and not own[back - 1].strip():
                    back -= 1
                for lines in (1, 2, 3):
                    if lines <= back and _ATTRIBUTION.match(" ".join(own[back - lines : back])):
                        del own[back - lines :]
                        break
            for k, piece in enumerate(_OMITTED.split(line[m.end() :])):
                cut = cut or k > 0
                if level != last or not quotes or cut and piece.strip():
                    quotes.append((level, []))
                    cut = False
                quotes[-1][1].append(piece)
                last = level
        last = level
    kept = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip() if quotes else "\n".join(own)
    return kept, [(level, "\n".join(lines)) for level, lines in quotes]


def normalise(passage: str) -> str:
    return " ".join(re.findall(r"\w+", passage.lower()))


def _passages(own: str) -> list[str]:
    """The text as a whole, its paragraphs and its lines; longer runs of lines are offered by ``_runs``."""
    found = [normalise(own), *(normalise(p) for p in re.split(r"\n\s*\n", own)), *(normalise(p) for p in own.split("\n"))]
    return [p for p in dict.fromkeys(found) if p]


def _runs(text: str) -> list[np.ndarray]:
    """Hashes of the runs of 2, 4, 8 ... lines, by their first line; lines without words are left out."""
    lines = [line for line in map(normalise, text.split("\n")) if line]
    h = np.array([int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") for line in lines], np.uint64)
    out, size = [], 1
    while 2 * size <= len(lines):
        with np.errstate(over="ignore"):
            h = words.mix(words.mix(h[:-size]) * np.uint64(3) + h[size:])
        size *= 2
        out.append(h.view(np.int64))
    return out


def _word_runs(passage: str, sizes: list[int]) -> dict[int, np.ndarray]:
    """Hashes of the runs of so many words, powers of two, by their first word."""
    h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in passage.split()], np.uint64)
    out, size, most = {}, 1, min(len(h), max(sizes))
    while size <= most:
        with np.errstate(over="ignore"):
            if size in sizes:
                out[size] = words.mix(h + np.uint64(size)).view(np.int64)
            h = words.mix(words.mix(h[:-size]) * np.uint64(3) + h[size:])
        size *= 2
    return out


def _asked(passage: str) -> dict:
    """Hashes of a quote's first and last longest run, and how many lines, or words, the last begins behind the first."""
    runs = _runs(passage)
    found = {"first": int(runs[-1][0]), "last": int(runs[-1][-1]), "behind": len(runs[-1]) - 1} if runs else {}
    plain = normalise(passage)
    size = 1 << max(0, plain.count(" ") + 1).bit_length() - 1 if plain else 0
    if size > 1:
        run = _word_runs(plain, [size])[size]
        found |= {"word_first": int(run[0]), "word_last": int(run[-1]), "word_behind": len(run) - 1, "word_size": size}
    return found


def _word_reader(sizes: list[int]):
    schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("line", pa.int32()), ("run", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, place, own in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "own")), strict=True):
                for h in _word_runs(normalise(own), sizes).values():
                    n = len(h)
                    yield pa.record_batch([pa.array(np.full(n, conv)), pa.array(np.full(n, place)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h)], schema=schema)

    return run, "conv long, place long, line int, run long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = [("word_first", pa.int64()), ("word_last", pa.int64()), ("word_behind", pa.int32()), ("word_size", pa.int32())]
    quote = pa.struct([("level", pa.int32()), ("passage", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("behind", pa.int32()), *word])
    run = pa.struct([("line", pa.int32()), ("hash", pa.int64())])
    for batch in batches:
        own, offered, runs, quotes = [], [], [], []
        for text in batch.column("text").to_pylist():
            kept, found = parse_quotes(text or "")
            own.append(kept)
            offered.append(_passages(kept))
            runs.append([{"line": k, "hash": h} for size in _runs(kept) for k, h in enumerate(size.tolist())])
            quotes.append([{"level": level, "passage": normalise(p)} | _asked(p) for level, p in found])
        columns = [*batch.columns[:-1], pa.array(own, pa.string()), pa.array(offered, pa.list_(pa.string())), pa.array(runs, pa.list_(run)), pa.array(quotes, pa.list_(quote))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "own", "offered", "runs", "quotes"])


_ASKED = ("first", "last", "behind", "word_first", "word_last", "word_behind", "word_size")


def _hashed(least_words: int):
    def of(q):
        far = F.size(F.split(q["passage"], " ")) >= least_words
        hashed = F.when(q["passage"] != "", F.xxhash64(q["passage"]))
        return F.struct(q["level"].alias("level"), hashed.alias("hash"), far.alias("far"), *[q[c].alias(c) for c in _ASKED])

    return of


def _offers(parsed: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv, place, hash of what messages offer: passages, and runs of lines that are quoted somewhere."""
    asked = quoted.where(F.col("first").isNotNull()).select("hash", "first", "last", "behind").distinct()
    runs = parsed.where(F.size("runs") > 0).select("conv", "place", F.explode("runs").alias("r")).select("conv", "place", "r.line", F.col("r.hash").alias("run"))
    return parsed.select("conv", "place", F.explode("offered").alias("hash")).unionByName(_holding(runs, asked)).distinct()


def _word_offers(parsed: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv, place, hash of the messages that have all words of a quote side by side."""
    asked = quoted.select("hash", *(F.col(f"word_{c}").alias(c) for c in ("first", "last", "behind"))).distinct()
    sizes = sorted(r.word_size for r in quoted.select("word_size").distinct().collect())  # powers of two
    read, schema = _word_reader(sizes)
    runs = parsed.where(F.octet_length("own") > 0).select("conv", "place", "own").mapInArrow(read, schema)
    return _holding(runs, asked).distinct()


def _holding(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """conv, place, hash where a message's runs have a quote's first and last one at the right distance."""
    either = asked.select(F.explode(F.array("first", "last")).alias("run")).distinct()
    runs = written(runs.join(either.hint("merge"), "run", "left_semi"), "quoted-runs")
    begun = runs.join(asked.withColumnRenamed("first", "run").hint("merge"), "run")
    begun = begun.select("conv", "place", "hash", (F.col("line") + F.col("behind")).alias("line"), F.col("last").alias("run"))
    return begun.join(runs.hint("merge"), ["conv", "place", "line", "run"], "left_semi").select("conv", "place", "hash")


def messages(conversations: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every message with its place in its conversation (0 first) and its quotes parsed."""
    columns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    kinds = "conv_id long, turn long, role string, digest long, own string, offered array<string>, runs array<struct<line:int,hash:long>>, "
    kinds += "quotes array<struct<level:int,passage:string,first:long,last:long,behind:int,word_first:long,word_last:long,word_behind:int,word_size:int>>"
    parsed = columns.select("conv_id", "turn", "role", F.xxhash64("text").alias("digest"), "text").mapInArrow(_parse, kinds)
    # passages stay behind as hashes
    hashed = parsed.select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "own",
        F.transform("offered", lambda p: F.xxhash64(p)).alias("offered"),
        "runs",
        F.transform("quotes", _hashed(least_words)).alias("quotes"),
    )
    part = F.coalesce(F.expr(f"turn div {PART}"), F.lit(2**62))
    hashed = written(hashed.withColumns({"row_no": F.monotonically_increasing_id(), "conv": _conv("conv_id"), "part": part}), "messages")
    order = Window.partitionBy("conv", "part").orderBy("turn", "role", "digest", "row_no")
    sums = Window.partitionBy("conv").orderBy("part")
    parts = hashed.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(sums) - F.col("n"))
    placed = hashed.withColumn("within", F.row_number().over(order)).join(parts.hint("merge"), ["conv", "part"])
    return written(placed.withColumn("place", F.col("base") + F.col("within") - 1).drop("part", "within", "n", "base"), "placed-messages")


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, place, quote_no, level, from_conv, from_place of every quote that is found elsewhere."""
    quoted = parsed.select("conv", "place", F.posexplode("quotes").alias("quote_no", "quote")).select("conv", "place", "quote_no", "quote.*")
    quoted = quoted.where(F.col("hash").isNotNull())
    found = written(_matched(quoted, _offers(parsed, quoted)), "passage-links")
    left = quoted.join(found.select("conv", "place", "quote_no").hint("merge"), ["conv", "place", "quote_no"], "left_anti")
    left = written(left.where(F.col("word_size").isNotNull()), "unlinked-quotes")
    return found if left.isEmpty() else found.unionByName(_matched(left, _word_offers(parsed, left)))


def _matched(quoted: DataFrame, offers: DataFrame) -> DataFrame:
    """conv, place, quote_no, level, from_conv, from_place of the quotes that an offer answers."""
    # within the conversation: the latest earlier offer, by a running maximum over both in one order
    own = offers.select("conv", "hash", "place", F.col("place").alias("offer"), F.lit(None).cast("int").alias("quote_no"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("far"))
    asked = quoted.groupBy("conv", "hash").agg(F.first("level").alias("any")).drop("any")
    own = own.join(asked, ["conv", "hash"], "left_semi")
    asks = quoted.select("conv", "hash", "place", F.lit(None).cast("long").alias("offer"), "quote_no", "level", "far")
    before = Window.partitionBy("conv", "hash").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    near = own.unionByName(asks).withColumn("from_place", F.max("offer").over(before)).where(F.col("quote_no").isNotNull())
    # elsewhere: the earliest offer of the hash, or that of the next conversation where it is in the quote's own; both sides have a hash once
    wanted = near.where(F.col("from_place").isNull() & F.col("far")).groupBy("hash").agg(F.count("*").alias("asked"))
    spoken = offers.join(wanted.hint("merge"), "hash", "left_semi").groupBy("hash", "conv").agg(F.min("place").alias("place"))
    spoken = written(spoken, "quoted-elsewhere")
    first = spoken.groupBy("hash").agg(F.min(F.struct("conv", "place")).alias("least"))
    rest = spoken.join(first.hint("merge"), "hash").where(F.col("conv") != F.col("least.conv"))
    second = rest.groupBy("hash").agg(F.min(F.struct("conv", "place")).alias("next"))
    far = first.join(second.hint("merge"), "hash", "left")
    found = near.join(far.hint("merge"), "hash", "left")
    found = found.withColumn("at", F.when(F.col("far"), F.when(F.col("least.conv") != F.col("conv"), F.col("least")).otherwise(F.col("next"))))
    foreign = F.col("at").isNotNull()
    return found.where(F.col("from_place").isNotNull() | foreign).select(
        "conv",
        "place",
        "quote_no",
        "level",
        F.when(F.col("from_place").isNotNull(), F.col("conv")).otherwise(F.col("at.conv")).alias("from_conv"),
        F.coalesce("from_place", "at.place").alias("from_place"),
    )


def link_conversations(conversations: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per message: conv_id, position in reply order, turn, role, text without quotes, parent_turn, depth, quotes, linked.

    depth counts the branches on the way to the message; quotes are those it has, linked those found elsewhere. least_words: what a quote
    must have to be linked to another conversation.
    """
    parsed = messages(conversations, least_words)
    found = written(links(parsed), "quote-links")
    own = (F.col("level") == 1) & (F.col("from_conv") == F.col("conv"))
    per = found.groupBy("conv", "place").agg(
        F.count("*").alias("linked"), F.min(F.when(own, F.struct("quote_no", "from_place")))["from_place"].alias("quoted_place")
    )
    parent = F.coalesce("quoted_place", F.when(F.col("place") > 0, F.col("place") - 1))
    replies = parsed.select("conv", "place").join(per.hint("merge"), ["conv", "place"], "left")
    replies = written(replies.select("conv", "place", F.coalesce("linked", F.lit(0)).alias("linked"), parent.alias("parent")), "replies")

    # the first message of each message's run: a running maximum, by parts
    first = F.when(~F.coalesce(F.col("parent") == F.col("place") - 1, F.lit(False)), F.col("place"))
    parts = replies.withColumn("part", F.expr(f"place div {PART}")).withColumn("first", first)
    running = Window.partitionBy("conv", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = parts.groupBy("conv", "part").agg(F.max("first").alias("last")).withColumn("before", F.max("last").over(earlier))
    runs = parts.withColumn("head", F.max("first").over(running)).join(last.select("conv", "part", "before").hint("merge"), ["conv", "part"])
    runs = written(runs.select("conv", "place", "parent", "linked", F.coalesce("head", "before").alias("head")), "runs")

    above = runs.select("conv", F.col("place").alias("parent"), F.col("head").alias("up"))
    step = F.array(F.struct((-F.coalesce("parent", F.lit(-1))).alias("after"), F.col("head").alias("head")))
    heads = runs.where(F.col("place") == F.col("head"))
    paths = written(heads.join(above.hint("merge"), ["conv", "parent"], "left").select("conv", "head", "up", step.alias("path")), "run-paths")
    while paths.where(F.col("up").isNotNull()).limit(1).count():
        over = paths.select("conv", F.col("head").alias("up"), F.col("up").alias("next"), F.col("path").alias("upper"))
        longer = F.when(F.col("upper").isNull(), F.col("path")).otherwise(F.concat("upper", "path"))
        paths = written(paths.join(over.hint("merge"), ["conv", "up"], "left").select("conv", "head", F.col("next").alias("up"), longer.alias("path")), "run-paths")
    sizes = runs.groupBy("conv", "head").agg(F.count("*").alias("n"))
    order = Window.partitionBy("conv").orderBy("path")
    placed = paths.join(sizes.hint("merge"), ["conv", "head"]).withColumn("start", F.sum("n").over(order) - F.col("n"))
    placed = placed.select("conv", "head", "start", (F.size("path") - 1).alias("depth"))
    turns = parsed.select("conv", F.col("place").alias("parent"), F.col("turn").alias("parent_turn"))
    # (conv, place) spreads one long conversation; only runs meet by (conv, head), which AQE can split
    final = runs.join(placed.hint("merge"), ["conv", "head"]).join(turns.hint("merge"), ["conv", "parent"], "left")
    final = final.select("conv", "place", "parent_turn", "linked", "depth", (F.col("start") + F.col("place") - F.col("head")).alias("position"))
    return parsed.join(final.hint("merge"), ["conv", "place"]).select(
        "conv_id", "position", "turn", "role", F.col("own").alias("text"), "parent_turn", "depth", F.size("quotes").alias("quotes"), "linked"
    )


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {"op7_quotation_linking": op7_quotation_linking}
ORACLE_SQL: dict[str, str] = {}

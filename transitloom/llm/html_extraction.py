"""HTML main text by consensus host paths.

Every page's containers (the elements that hold blocks of text) are scored: the text outside links
in them, less what boilerplate they hold. A page votes for its best container by its generalised
path, the tags and classes from the root with digits dropped; the votes are added up per host in
Spark, and each page is read again by its host's winning path. A page without an element on that
path goes by its own best container.

Never part of the text: scripts, styles, comments and other non-text elements, hidden elements,
and, at any depth, elements that are menus, headers, footers, sidebars, notices, adverts, forms or
reader comments by their tag, role, class or id (headings in a header inside an article are kept).
A class speaks for itself: ``sidebar-content`` and ``comment-body`` are boilerplate, ``has-sidebar`` is not. An id counts on containers only, and not
if it has words beyond that, as the anchors that are made of headings have (``related-work``). Words that name parts of articles as well
(``discussion``, ``related``, ``social``) count where the element is links for the greater part. Within a line, hidden parts and adverts go.
A form that wraps the page, and a marked element that holds the main or most of an article, stays.
Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by an empty line in page order; nothing is capped.

Only scripts, styles, titles, iframes and the like run to the end of a page when they are left open. A
button, drawing or player that is never closed, or that ends behind its parent, is an empty element, and a ``<`` that
begins no tag is text. Memory and time grow with the page's length, whatever its depth.

A null or empty page, and one without text outside boilerplate, gives an empty text. A null url, or
one without a host, counts as the host "". Unclosed and stray tags are tolerated. Repeated rows are
extracted each. Empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Hosts whose winners are broadcast; with more, winners and pages are joined by host and a salt.
BROADCAST_HOSTS, SALTS = 200_000, 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|iframe|textarea|title)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>",  # a quote that is not closed
    re.S | re.I,
)
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<]*\Z")
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_CONTAINERS = frozenset("html body main article section div nav aside header footer form table td th dialog menu ul ol dl details fieldset figure center".split())
_BLOCKS = _CONTAINERS - {"td", "th"} | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr blockquote pre hr figcaption caption address summary legend thead tbody".split())
_SPACED = frozenset("br td th img wbr option".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no text of the page.
_SILENT = re.compile(r"<(/?)(svg|annotation|annotation-xml|object|canvas|audio|video|select|datalist|button|template)\b((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_BLOCK_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_BLOCKS | {'td', 'th'}, key=len, reverse=True))})\b", re.I)
_APART_TAGS = frozenset("nav aside header footer dialog menu head".split())
_APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus guestbook".split())
#: Words that name parts of articles as well: they count where an element is links for the greater part.
_WEAK_WORDS = frozenset("discussion responses reviews social related share sharing".split())
#: What else may stand in the id of boilerplate: an id with any other word is an anchor made of a heading.
_ID_WORDS = frozenset("site page main global top bottom left right primary secondary box block section list bar panel inner outer container wrap wrapper area content el id the".split())
_APART_WORDS = _COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion promoted "
    "sidebar sidenav rail menu nav navbar navigation topnav subnav breadcrumb breadcrumbs header masthead topbar footer foot colophon "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "recommended pagination pager widget widgets toolbar login register search form copyright disclaimer".split()
)
#: Words of a class that tell of the element's surroundings or subject, not of its own part.
_ABOUT_WORDS = frozenset("has have with without no not is layout category cat tag type format status template".split())
_AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored".split())
#: Parts of a line that may be hidden or adverts.
_INLINE = frozenset("span a b i em strong small font label mark ins del u s sub sup code kbd q cite abbr time big tt".split())
_WRAP_WORDS, _MAIN_WORDS = frozenset("wrap wrapper container area inner".split()), frozenset("content main article post entry story".split())


class Block(NamedTuple):
    text: str
    linked: int
    apart: bool
    #: the innermost element around it that may turn out to be boilerplate, or -1
    doubtful: int


class Container(NamedTuple):
    node: int
    depth: int
    first: int
    last: int
    good: int
    bad: int


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _words(token: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))


def _marks(attributes: dict[str, str], by_id: bool) -> frozenset[str]:
    """The boilerplate words of the class names, and of the id, that speak for the element itself."""
    found: frozenset[str] = frozenset()
    known = _APART_WORDS | _WEAK_WORDS
    for token in attributes.get("class", "").split():
        words = _words(token)
        marks = words & known
        if marks and not words & _ABOUT_WORDS and (marks & _COMMENT_WORDS or not (words & _WRAP_WORDS and words & _MAIN_WORDS)):
            found |= marks
    for token in attributes.get("id", "").split() if by_id else ():
        words = _words(token)
        if words & known and not words - known - _ID_WORDS and not (words & _WRAP_WORDS and words & _MAIN_WORDS and not words & _COMMENT_WORDS):
            found |= words & known
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def _unread(attributes: dict[str, str]) -> bool:
    """Whether a part of a line is hidden or an advert."""
    return _hidden(attributes) or any(_words(c) & _AD_WORDS and not _words(c) & _ABOUT_WORDS for c in attributes.get("class", "").split())


def _apart(tag: str, attributes: dict[str, str]) -> str:
    """"yes" for boilerplate, "header" for one whose headings may count, "form", "name" by class or id only, "weak" if it is so by its links, or ""."""
    if tag in ("html", "body"):
        return ""
    if _hidden(attributes):
        return "yes"
    if tag in _APART_TAGS or attributes.get("role", "").lower() in _APART_ROLES:
        return "header" if tag == "header" else "yes"
    marks = _marks(attributes, tag in _CONTAINERS)
    if marks and marks <= _WEAK_WORDS:
        return "" if tag in ("main", "article") else "weak"
    if marks & _COMMENT_WORDS:
        return "yes"
    if tag in ("main", "article"):
        return ""
    if marks:
        return "header" if marks <= {"header", "masthead"} else "name"
    return "form" if tag == "form" else ""


def _silent(page: str) -> dict[int, int]:
    """Where the silent elements begin and end; one that is not closed within its parent ends at its own tag."""
    tags: dict[int, int] = {}
    closed: dict[int, tuple[int, int]] = {}
    opened: dict[str, list[int]] = {}
    for m in _SILENT.finditer(page):
        tag = m[2].lower()
        if not m[1]:
            tags[m.start()] = m.end()
            if not (m[3].endswith("/") and tag in ("svg", "annotation")):
                opened.setdefault(tag, []).append(m.start())
        elif opened.get(tag):
            closed[opened[tag].pop()] = (m.start(), m.end())
    if not closed:
        return tags
    places, ends = _ends(page)
    spans, at = tags, 0
    for start in sorted(closed):
        last, end = closed[start]
        first = bisect_left(places, tags[start])
        # what is inside another one goes with it; an element that ends in it began before it
        if start >= at and ends[first] > bisect_left(places, last):
            spans[start] = at = end
    return spans


def _ends(page: str) -> tuple[list[int], list[int]]:
    """Where the tags of blocks are, and before each of them, and behind the last, the number of the first tag that ends what is open there."""
    places, depth = [], ([0], [0])  # of paragraphs and of the blocks that must be closed
    for m in _BLOCK_TAG.finditer(page):
        name, step = m[2].lower(), -1 if m[1] else 1
        places.append(m.start())
        for k, counts in enumerate(depth):
            own = name == "p" if k == 0 else name not in ("p", "li", "dt", "dd", "tr", "td", "th", "hr", "thead", "tbody")
            counts.append(counts[-1] + own * step)
    first = [len(places) + 1] * (len(places) + 1)
    for counts in depth:
        waiting: list[int] = []
        for k, count in enumerate(counts):
            while waiting and counts[waiting[-1]] > count:
                first[waiting[-1]] = min(first[waiting[-1]], k)
                waiting.pop()
            waiting.append(k)
    return places, first


def parse(page: str) -> tuple[list[tuple[str, bool]], list[Container], list[tuple[int, str]]]:
    """``(blocks, containers, nodes)`` of a page.

    blocks: (text, whether it is boilerplate). containers: their node, depth, first and last block,
    characters outside links, characters of boilerplate and links. nodes: (parent, name) of the containers.
    """
    blocks: list[Block] = []
    nodes: list[tuple[int, str]] = [(-1, "")]
    found: list[tuple[int, int, int, int, bool, int]] = []
    # open elements: tag, node, first block, whether apart, the innermost doubtful element
    stack: list[tuple[str, int, int, str, int]] = [("", 0, 0, "", -1)]
    opened: Counter = Counter()
    # doubtful elements: [outer one, kind, first block, last block, holds a main, holds an article or h1]
    doubtful: list[list] = []
    silent = _silent(page)
    piece: list[str] = []
    linked, link_depth, articles, heading, leaf_apart = 0, 0, 0, False, ""
    # the hidden part of a line: its tag and how many of these are open
    unread, unread_depth = "", 0

    def flush() -> None:
        nonlocal linked, unread
        unread = ""
        text = " ".join(html.unescape("".join(piece)).split())
        piece.clear()
        if text:
            _, _, _, apart, doubt = stack[-1]
            kept = not apart or apart == "header" and heading and articles
            linked = min(linked, len(text))
            own = 2 * linked > len(text) if leaf_apart == "weak" else bool(leaf_apart)
            blocks.append(Block(text, linked, own or not kept, doubt))
        linked = 0

    def close() -> None:
        nonlocal articles
        if stack[-1][3:] != stack[-2][3:]:
            flush()
        tag, node, first, apart, doubt = stack.pop()
        opened[tag] -= 1
        articles -= tag in ("article", "main")
        if doubt != stack[-1][4]:
            doubtful[doubt][3] = len(blocks)
        if len(blocks) > first:
            found.append((node, len(stack), first, len(blocks), bool(apart), doubt))

    def holds(tag: str) -> None:
        doubt = stack[-1][4]
        while doubt >= 0 and not doubtful[doubt][4 if tag == "main" else 5]:
            doubtful[doubt][4 if tag == "main" else 5] = True
            doubt = doubtful[doubt][0]

    def text_of(text: str) -> None:
        nonlocal linked
        if unread:
            return
        piece.append(text)
        if link_depth:
            linked += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside a silent element
        if m.start() > at:
            text_of(page[at : m.start()])
        at = silent.get(m.start(), m.end())
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        ends, written = bool(m[2] or m[5]), m[4] or m[7]
        if tag == "a":
            link_depth = max(0, link_depth + (-1 if ends else 1))
        if tag in _SPACED:
            piece.append(" ")
        if tag == unread:
            unread_depth += -1 if ends else 1
            if not unread_depth:
                unread = ""
        elif not unread and not ends and written and tag in _INLINE and _unread(_attributes(written)):
            unread, unread_depth = tag, 1
        if tag in _BLOCKS:
            flush()
            link_depth = 0
            if tag in _HEADINGS:
                heading = not ends
                if tag == "h1" and not ends:
                    holds(tag)
            if tag not in _CONTAINERS:
                leaf_apart = _apart(tag, _attributes(written)) if written and not ends else ""
        if tag in _CONTAINERS:
            leaf_apart = ""
            if ends:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        close()
                    close()
            else:
                attributes = _attributes(written) if written else {}
                kind = _apart(tag, attributes)
                if tag in ("main", "article") and not kind:
                    holds(tag)
                if tag in ("td", "th") and kind:
                    flush()
                _, outer, _, apart, doubt = stack[-1]
                if kind in ("form", "name", "weak") and not apart:
                    doubtful.append([doubt, kind, len(blocks), len(blocks), False, False])
                    doubt = len(doubtful) - 1
                elif kind and not apart:
                    apart = kind
                name = ".".join([tag, *sorted(re.sub(r"[\d>]+", "", c.lower()) for c in attributes.get("class", "").split())])
                articles += tag in ("article", "main")
                opened[tag] += 1
                nodes.append((outer, name))
                stack.append((tag, len(nodes) - 1, len(blocks), apart, doubt))
    if at < len(page):
        text_of(_CUT_TAG.sub("", page[at:]))  # a tag that was cut off is markup
    flush()
    while len(stack) > 1:
        close()

    text = [0, *accumulate(0 if b.apart else len(b.text) for b in blocks)]
    links = [0, *accumulate(0 if b.apart else b.linked for b in blocks)]
    released = []
    for outer, kind, first, last, has_main, has_article in doubtful:
        most = 2 * (text[last] - text[first]) > text[-1]
        own = has_main or (has_article or kind == "form") and most or kind == "weak" and 2 * (links[last] - links[first]) <= text[last] - text[first]
        released.append(own and (outer < 0 or released[outer]))
    apart = [b.apart or b.doubtful >= 0 and not released[b.doubtful] for b in blocks]
    good = [0, *accumulate(0 if a else len(b.text) - b.linked for a, b in zip(apart, blocks))]
    bad = [0, *accumulate(len(b.text) if a else b.linked for a, b in zip(apart, blocks))]
    containers = [
        Container(node, depth, first, last, good[last] - good[first], bad[last] - bad[first])
        for node, depth, first, last, marked, doubt in found
        if not marked and (doubt < 0 or released[doubt])
    ]
    if blocks:
        containers.append(Container(0, 0, 0, len(blocks), good[-1], bad[-1]))
    return [(b.text, a) for b, a in zip(blocks, apart)], containers, nodes


def best(containers: list[Container]) -> Container | None:
    """The container with the most text less boilerplate; of equals the deepest, then the first."""
    return max(containers, key=lambda c: (c.good - c.bad, c.depth, -c.first), default=None)


def path_of(nodes: list[tuple[int, str]], node: int) -> str:
    names = []
    while node > 0:
        node, name = nodes[node]
        names.append(name)
    return ">".join(reversed(names))


def path_keys(nodes: list[tuple[int, str]]) -> list[int]:
    """A hash of each node's path, by the hash of its parent's."""
    keys = [0]
    for outer, name in nodes[1:]:
        keys.append(xxhash.xxh64_intdigest(name, keys[outer]))
    return keys


def text_by_path(page: str, path: str | None) -> str:
    """The main text of a page by its host's path, or by its own best container."""
    blocks, containers, nodes = parse(page)
    spans = []
    if path is not None:
        key = path_keys([(-1, ""), *((k, name) for k, name in enumerate(path.split(">")) if path)])[-1]
        keys = path_keys(nodes)
        spans = sorted((c.first, c.last) for c in containers if keys[c.node] == key and c.good > 0)
    if not spans and (own := best(containers)):
        spans = [(own.first, own.last)]
    kept, done = [], 0
    for first, last in spans:  # an element inside another of the same path is in its span
        kept += [text for text, apart in blocks[max(first, done) : last] if not apart]
        done = max(done, last)
    return "\n\n".join(kept)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, path, share = [], [], []
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            _, containers, nodes = parse(page or "")
            won = best(containers)
            if won and won.good > 0:
                host.append(h), path.append(path_of(nodes, won.node)), share.append(won.good / (won.good + won.bad))
        yield pa.record_batch([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(share, pa.float64())], names=["host", "path", "share"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_by_path(page or "", path) for path, page in zip(batch.column("path").to_pylist(), batch.column("html").to_pylist(), strict=True)]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("path")]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "path"])


def _host(url: str):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with the most votes, a page's vote weighing its container's share of good text."""
    votes = pages.select(_host("url").alias("host"), "html").mapInArrow(_vote, "host string, path string, share double")
    counted = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the host's winning path of every page."""
    winners = written(host_paths(pages), "host-paths")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host("url").alias("host"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = own.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    schema = "page_id long, url string, text string, n_chars long, path string"
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE_SQL: dict[str, str] = {}

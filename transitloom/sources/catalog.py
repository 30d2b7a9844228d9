"""Catalog pages: headings, the links below them, and the city they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import classify_section, squeeze

_TOKEN = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>|<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"


def plain(html: Column) -> Column:
    """Text of a piece of HTML: tags dropped, the common references decoded, white space squeezed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return squeeze(text)


def page_entries(pages: DataFrame) -> DataFrame:
    """page_id, pos, heading (null for links), href, title: headings and links in document order."""
    parts = [F.regexp_extract_all("html", F.lit(_TOKEN), k) for k in (2, 3, 4)]
    entries = pages.select("page_id", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("heading", "href", "title"), strict=True)])).alias("pos", "e"))
    link = F.col("e.href") != ""
    return entries.select("page_id", "pos", F.when(~link, plain(F.col("e.heading"))).alias("heading"), F.when(link, F.col("e.href")).alias("href"), F.when(link, plain(F.col("e.title"))).alias("title"))


def sections(entries: DataFrame) -> DataFrame:
    """Links with the last heading before them on their page and its transport type."""
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = entries.withColumn("section", F.last("heading", ignorenulls=True).over(before)).where("href IS NOT NULL")
    return headed.select("page_id", "pos", "section", classify_section(F.col("section")).alias("route_type"), "href", "title")


_EVENT = r"""(?is)<(/?)(div|section|article|main|header|footer|nav|aside|ul|ol|table|form|body)\b([^>]*)>|<span\b([^>]*)>(.*?)</span\s*>|<a\b([^>]*)>(.*?)</a\s*>|<!--.*?-->"""
# The classes of a section's header, of the name in it, and of the block with its links.
HEADER, HEADER_NAME, BLOCK = "typeHeader", "typeHeader-name", "wikiCatalogFilterListItem"


def _attribute(text: Column, name: str) -> Column:
    """The value of an attribute in a tag's text, with or without quotes; empty if there is none."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.coalesce(F.regexp_extract(text, pattern, k), F.lit("")) for k in (1, 2, 3)))


def tag_events(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, kind, text, href: containers that open and close, named spans and links, in document order.

    level is the number of containers that are open around an event (of a container's own two events: around it).
    """
    names = ("close", "tag", "own", "span", "name", "link", "title")
    parts = [F.regexp_extract_all("html", F.lit(_EVENT), k).alias(n) for k, n in enumerate(names, 1)]
    events = pages.select("page_id", F.posexplode(F.arrays_zip(*parts)).alias("pos", "e")).select("page_id", "pos", "e.*")
    has = lambda text, name: F.array_contains(F.split(_attribute(text, "class"), r"\s+"), name)
    opens, closes = (F.col("tag") != "") & (F.col("close") == ""), (F.col("tag") != "") & (F.col("close") != "")
    kind = (
        F.when(opens & has(F.col("own"), HEADER), "header")
        .when(opens & has(F.col("own"), BLOCK), "block")
        .when(opens, "open")
        .when(closes, "close")
        .when((F.col("span") != "") & has(F.col("span"), HEADER_NAME), "name")
        .when(F.col("link") != "", "link")
    )
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.sum(step).over(upto) - F.when(opens, 1).otherwise(0)
    href = F.when(F.col("link") != "", _attribute(F.col("link"), "href"))
    text = F.when(F.col("link") != "", plain(F.col("title"))).when(F.col("span") != "", plain(F.col("name")))
    return events.withColumns({"kind": kind, "level": level}).where("kind IS NOT NULL").select("page_id", "pos", "level", "kind", text.alias("text"), href.alias("href"))


def section_links(pages: DataFrame) -> DataFrame:
    """page_id, section, route_type, block, pos, href, title: the links in the block that follows a section's header.

    A header's block is the next one among its siblings: on its level, before the container around it ends. Two headers may share
    a block. A header without a named title, or without a block, has no links, nor has one whose title names no transport type;
    links without an address are left out.
    """
    events = tag_events(pages)
    # the end of a container is an end to the siblings inside it, one level up
    ends = events.where("kind = 'close'").select("page_id", "pos", (F.col("level") + 1).alias("level"), F.lit("end").alias("kind"), "text", "href")
    marks = events.where("kind IN ('header', 'block', 'close')").unionByName(ends)
    later = Window.partitionBy("page_id", "level").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    following = lambda *kinds: F.first(F.when(F.col("kind").isin(*kinds), F.struct("kind", "pos")), ignorenulls=True).over(later)
    spans = marks.withColumns({"next": following("block", "end"), "closed": following("close", "end")})
    until = F.coalesce(F.col("closed")["pos"], F.lit(2**31 - 1))
    blocks = spans.where("kind = 'block'").select("page_id", F.col("pos").alias("block"), until.alias("until"))
    next_block = F.when(F.col("next")["kind"] == "block", F.col("next")["pos"])
    headers = spans.where("kind = 'header'").select("page_id", F.col("pos").alias("header"), until.alias("header_until"), next_block.alias("block"))
    titles = events.where("kind = 'name'").select("page_id", F.col("pos").alias("at"), F.col("text").alias("name"))
    titled = headers.join(titles, "page_id").where("at > header AND at < header_until").groupBy("page_id", "header", "block").agg(F.min_by("name", "at").alias("section"))
    titled = titled.withColumn("route_type", classify_section(F.col("section"))).where("route_type IS NOT NULL")
    links = events.where("kind = 'link' AND href <> ''").select("page_id", "pos", "href", F.col("text").alias("title"))
    inside = links.join(blocks, "page_id").where("pos > block AND pos < until").select("page_id", "block", "pos", "href", "title")
    return titled.join(inside, ["page_id", "block"]).select("page_id", "section", "route_type", "block", "pos", "href", "title")


def unrecognised(entries: DataFrame) -> DataFrame:
    """Headings without a transport type, and how often they occur."""
    return entries.where(F.col("heading").isNotNull() & classify_section(F.col("heading")).isNull()).groupBy("heading").agg(F.count("*").alias("times"))


def dominant_city(links: DataFrame, by: str, city: str, actual: DataFrame | None = None) -> DataFrame:
    """by, city: the given city where it is among a group's links, else the most frequent, of equals the least."""
    counts = links.where(F.col(city).isNotNull()).groupBy(by, city).agg(F.count("*").alias("n"))
    given = F.lit(False)
    if actual is not None:
        counts = counts.join(actual.select(by, F.col("actual")), by, "left")
        given = F.coalesce(F.col("actual") == F.col(city), F.lit(False))
    ranked = counts.withColumn("rank", F.struct(given.cast("int").alias("given"), F.col("n")))
    top = ranked.groupBy(by).agg(F.max("rank").alias("rank"))
    return ranked.join(top, [by, "rank"]).groupBy(by).agg(F.min(city).alias(city))

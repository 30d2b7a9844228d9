"""Ideas of passengers: their lists, page by page, and the routes that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idea_rating, idea_type
from .catalog import plain

# The cells of an idea's row, and the empty pages after which a list has ended.
CELLS, EMPTY_PAGES = 6, 3


def _absolute(href: Column, base: str) -> Column:
    return F.when(F.startswith(href, F.lit("http")), href).when(href != "", F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(href, "^/+", "")))


def idea_list(pages: DataFrame, base: str, most_pages: int = 0) -> DataFrame:
    """From ``(query_no, page, html)``: place, id, title, url, city, author, date, rating, voters of each idea, first seen first.

    Rows of tables with six cells or more are ideas; one without a number has no id and does not count. An id that several queries or
    pages show counts once, as the first query and page have it. A query's list ends behind three empty pages in a row, or at ``most_pages``.
    """
    tables = F.regexp_extract_all("html", F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), 1)
    rows = F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr\s*>|\z)"), 1)))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)(?=<td\b|</td\s*>|\z)"), 1))
    listed = pages.select("query_no", "page", F.filter(cells, lambda c: F.size(c) >= CELLS).alias("rows"))
    if most_pages > 0:
        listed = listed.where(F.col("page") <= most_pages)
    recent = Window.partitionBy("query_no").orderBy("page").rowsBetween(1 - EMPTY_PAGES, 0)
    empty = F.when(F.size("rows") == 0, 1).otherwise(0)
    ended = listed.withColumn("ended", F.sum(empty).over(recent) == EMPTY_PAGES)
    last = ended.groupBy("query_no").agg(F.min(F.when(F.col("ended"), F.col("page"))).alias("last"))
    shown = ended.join(last, "query_no").where(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    ideas = shown.select("query_no", "page", F.posexplode("rows").alias("row", "c"))
    cell = lambda k: plain(F.get("c", F.lit(k)))
    number = F.regexp_extract(cell(0), r"(\d+)", 1).try_cast("bigint")
    href = F.regexp_extract(F.get("c", F.lit(1)), r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)
    rating, voters = idea_rating(cell(5))
    named = ideas.select(
        "query_no", "page", "row", number.alias("id"), cell(1).alias("title"), _absolute(href, base).alias("href"),
        cell(2).alias("city"), cell(3).alias("author"), cell(4).alias("date"), rating.alias("rating"), voters.alias("voters"),
    ).where("id IS NOT NULL")
    url = F.coalesce("href", F.concat(F.lit(base.rstrip("/") + "/idea/"), F.col("id").cast("string")))
    place = F.struct("query_no", "page", "row")
    columns = ["title", "url", "city", "author", "date", "rating", "voters"]
    first = named.withColumn("url", url).groupBy("id").agg(F.min(place).alias("place"), F.min_by(F.struct(*columns), place).alias("idea"))
    return first.select("place", "id", "idea.*")


def ideas_to_routes(ideas: DataFrame, shapes: DataFrame) -> DataFrame:
    """The ideas as routes, with the line and stops of ``shapes(id, h1, coords, stops)`` where there are any.

    The author stands in company, the city in price, and ``rating(voters)`` in transport_class, as the sheets show them.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = ideas.join(shapes, "id", "left")
    return joined.select(
        "place",
        F.col("id").alias("route_id"),
        F.col("title").alias("name"),
        idea_type(F.col("title"), F.col("h1")).alias("route_type"),
        blank("url").alias("url"),
        blank("author").alias("company"),
        blank("city").alias("price"),
        F.concat(blank("rating"), F.lit("("), blank("voters"), F.lit(")")).alias("transport_class"),
        F.lit(True).alias("active"),
        F.lit(True).alias("is_idea"),
        F.lit(None).cast("string").alias("error"),
        F.when(F.size("coords") > 0, F.col("coords")).alias("coords"),
        F.when(F.size("coords") > 0, F.col("stops")).alias("stops"),
    )

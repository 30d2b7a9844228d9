"""Points of interest near lines, by a grid join.

A distance predicate alone would compare every point with every segment. Instead both get the
cells of a grid that is as wide as the buffer: a point has one, a segment those of its box and one
around it, so the equi-join on cells finds each pair within the buffer, and finds it once. Long
segments are first cut so that no row has many cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, planar_segment_km, segment_distance_km
from ..tables import written
from . import shapes
from .geometry import DIRECTION, segments

#: Cells that a piece of a segment may be long.
PIECE_CELLS = 16


def near_segments(pois: DataFrame, points: DataFrame, buffer_m: float, greatest_latitude: float = 70.0) -> DataFrame:
    """poi columns, route_id, di: each POI within the buffer of a direction, once.

    POIs in one place and directions of one shape are compared once, and become rows of their own at the end, from lists, as these rows grow with the product of both.
    greatest_latitude bounds how far a degree of longitude shrinks; cells are sized for it.
    """
    groups = shapes.alike(points, DIRECTION, ["seq"], ["lat", "lon"])
    near = written(_near_places(pois, shapes.firsts(points, groups, DIRECTION), buffer_m, greatest_latitude), "near-places")
    near = near.select("lat", "lon", F.struct(*DIRECTION).alias("first"))
    places = shapes.in_blocks(written(pois.distinct(), "distinct-pois"), ["lat", "lon"], F.struct(*pois.columns), "here").withColumnRenamed("block", "place_block")
    places = written(places.drop("of_group"), "pois-of-places")
    directions = written(shapes.in_blocks(groups, ["first"], F.struct(*DIRECTION), "alike").drop("of_group"), "directions-of-shapes")
    items = near.join(places.drop("here"), ["lat", "lon"]).join(directions.drop("alike"), "first")
    items = shapes.dealt(items, "lat", "lon", "place_block", "first", "block")
    met = items.join(places, ["lat", "lon", "place_block"]).join(directions, ["first", "block"])
    return shapes.product(met, "poi", "here", "direction", "alike", []).select(*(F.col("poi")[c].alias(c) for c in pois.columns), *(F.col("direction")[c].alias(c) for c in DIRECTION))


def near_any(pois: DataFrame, points: DataFrame, buffer_m: float, greatest_latitude: float = 70.0) -> DataFrame:
    """The POIs, each once, that are within the buffer of any direction."""
    groups = shapes.alike(points, DIRECTION, ["seq"], ["lat", "lon"])
    near = _near_places(pois, shapes.firsts(points, groups, DIRECTION), buffer_m, greatest_latitude)
    return pois.distinct().join(near.select("lat", "lon").distinct(), ["lat", "lon"], "left_semi").select(pois.columns)


def near_stats(pois: DataFrame, points: DataFrame, buffer_m: float, by: list[str], greatest_latitude: float = 70.0) -> DataFrame:
    """``poi_stats`` of the POIs within the buffer of each direction or route, with the values of all that are; groups of one shape share them."""
    groups = shapes.alike(points, by, [c for c in (*DIRECTION, "seq") if c not in by], [c for c in (*DIRECTION, "lat", "lon") if c not in by and c != "route_id"])
    near = written(_near_places(pois, shapes.firsts(points, groups, by), buffer_m, greatest_latitude).select("lat", "lon", *by).distinct(), "near-places")
    hits = written(pois.select("poi_id", "poi_type", "lat", "lon").distinct().join(near, ["lat", "lon"]), "near-pois")
    return shapes.for_all(written(poi_stats(hits, poi_values(hits.select("poi_id", "poi_type").distinct()), by), "poi-stats"), groups, by)


def _near_places(pois: DataFrame, points: DataFrame, buffer_m: float, greatest_latitude: float) -> DataFrame:
    """lat, lon, route_id, di: each place of POIs within the buffer of a direction, once."""
    if buffer_m <= 0:
        raise ValueError("buffer_m must be positive")
    cell = buffer_m / METRES_PER_DEGREE
    wide = cell / math.cos(math.radians(greatest_latitude))
    row = lambda x: F.floor(F.col(x) / cell)
    column = lambda x: F.floor(F.col(x) / wide)
    longest = F.greatest(F.abs(F.col("lat2") - F.col("lat1")) / cell, F.abs(F.col("lon2") - F.col("lon1")) / wide)
    pieces = F.greatest(F.lit(1), F.ceil(longest / PIECE_CELLS)).cast("int")
    coordinates = ["lat1", "lon1", "lat2", "lon2"]
    passed = written(segments(points).select(*DIRECTION, *coordinates).distinct(), "passed-segments")
    cut = passed.select(coordinates).distinct().withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    for c in ("lat", "lon"):
        at = lambda k, c=c: F.col(c + "1") + (F.col(c + "2") - F.col(c + "1")) * k / F.col("pieces")
        cut = cut.withColumn(f"{c}_a", at(F.col("piece"))).withColumn(f"{c}_b", at(F.col("piece") + 1))
    span = lambda f, c: F.sequence(F.least(f(f"{c}_a"), f(f"{c}_b")) - 1, F.greatest(f(f"{c}_a"), f(f"{c}_b")) + 1)
    cells = cut.withColumn("cell_row", F.explode(span(row, "lat"))).withColumn("cell_column", F.explode(span(column, "lon")))
    cells = cells.select(*coordinates, "cell_row", "cell_column").distinct()
    placed = pois.select("lat", "lon").distinct().withColumns({"cell_row": row("lat"), "cell_column": column("lon")})
    ends = [F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")]
    close = (planar_segment_km(*ends) <= 1.5 * buffer_m / 1000) & (segment_distance_km(*ends) <= buffer_m / 1000)
    # cells are many more than the points' size tells, so they are not sent to every executor; distances take long for so few bytes, so tasks are not merged
    spark = points.sparkSession
    dealt = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell_row", "cell_column")
    met = dealt(placed).join(dealt(cells).hint("merge"), ["cell_row", "cell_column"]).where(close).select("lat", "lon", *coordinates)
    return written(met, "near-segments").join(passed, coordinates).select("lat", "lon", *DIRECTION).distinct()


def poi_values(pois: DataFrame, total: float = 1000.0) -> DataFrame:
    """poi_type, count, value: ``total`` shared by the POIs of a type, at least 1 each."""
    counts = pois.groupBy("poi_type").agg(F.count("*").alias("count"))
    return counts.withColumn("value", F.greatest(F.lit(1.0), F.lit(total) / F.col("count")))


def poi_stats(hits: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Sum of values, count, and counts by type of the distinct POIs of each group."""
    valued = hits.select("poi_id", "poi_type", *by).distinct().join(values.select("poi_type", "value"), "poi_type")
    typed = valued.groupBy(*by, "poi_type").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return typed.groupBy(*by).agg(
        F.sum("v").alias("total_value"),
        F.sum("n").alias("count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("poi_type", "n")))).alias("by_type"),
    )


# Kinds of POI by their tags.
POI_TAGS = {"Школа": {"amenity": "school"}, "Детский сад": {"amenity": "kindergarten"}}


def poi_kind(tags: Column) -> Column:
    """The first kind all of whose tags a POI has; null for none."""
    kind = F.when(F.lit(False), F.lit(""))
    for name, needed in POI_TAGS.items():
        fits = F.lit(True)
        for key, value in needed.items():
            fits = fits & F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))
        kind = kind.when(fits, name)
    return kind


# Sites of the kind that do not count.
MILITARY = ["airfield", "base", "barracks", "naval_base"]


def osm_pois(elements: DataFrame) -> DataFrame:
    """poi_id, poi_type, name, lat, lon, osm_type from ``(id, type, lat, lon, center(lat, lon), tags)``.

    Elements without a name or a known kind do not count, nor do military land and sites and private aerodromes. A node has
    its own coordinates, a way or relation those of its centre; other elements, and those without coordinates, have none and do not count.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    military = (tag("landuse") == "military") | tag("military").isin(*MILITARY) | ((tag("access") == "private") & (tag("aeroway") == "aerodrome"))
    name = F.trim(F.coalesce(tag("name"), F.lit("")))
    at = lambda c: F.when(F.col("type") == "node", F.col(c)).when(F.col("type").isin("way", "relation"), F.col(f"center.{c}"))
    found = elements.where((name != "") & ~F.coalesce(military, F.lit(False)))
    placed = found.select(F.col("id").alias("poi_id"), poi_kind(F.col("tags")).alias("poi_type"), name.alias("name"), at("lat").alias("lat"), at("lon").alias("lon"), F.col("type").alias("osm_type"))
    return placed.dropna(subset=["poi_type", "lat", "lon"])

"""Routes, stops, terminals and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .geometry import DIRECTION, in_bbox, routes_inside

# Shifts of obfuscated coordinates, by the point's number in its array.
LAT_SHIFT = [5.331, 6.812, 9.315, 0.233, 5.187, 4.778, 4.163, 5.886]
LON_SHIFT = [7.882, 7.05, 3.84, 1.77, 0.21, 4.41, 4.012, 1.366]


def route_tasks(catalog: DataFrame, include: set[str] = frozenset(), exclude: set[str] = frozenset(), only: str = "", most_number: int = 0) -> DataFrame:
    """Catalog rows to load: types included and not excluded, an exact name or id if asked, numbers up to a limit; each once."""
    kept = catalog
    if include:
        kept = kept.where(F.col("route_type").isin(*sorted(include)))
    if exclude:
        kept = kept.where(~F.col("route_type").isin(*sorted(exclude)))
    if only.strip():
        wanted = only.strip().lower()
        kept = kept.where((F.lower(text.squeeze(F.col("name"))) == wanted) | (F.col("route_id").cast("string") == wanted))
    return kept.where(text.passes_number_filter(F.col("name"), most_number)).dropDuplicates(["route_type", "route_id"])


def split_active(routes: DataFrame, active_only: bool = True) -> DataFrame:
    return routes.where("active") if active_only else routes


def route_state(routes: DataFrame, points: DataFrame) -> DataFrame:
    """routes with state: ``bad`` (an error), ``ok`` (a direction of two or more points), else ``empty``."""
    lines = points.groupBy(*DIRECTION).agg(F.count("*").alias("n")).where("n >= 2").select("route_id").distinct().withColumn("drawn", F.lit(True))
    state = F.when(F.col("error").isNotNull(), "bad").when(F.col("drawn"), "ok").otherwise("empty")
    return routes.join(lines, "route_id", "left").withColumn("state", state).drop("drawn")


# The summary's titles of types.
TYPE_TITLES = {"Поездов": "train", "Троллейбусов": "trolleybus", "Трамваев": "tram", "Автобусов": "bus", "Маршруток": "minibus", "Водных маршрутов": "water"}


def type_counts(routes: DataFrame, points: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
    """title, routes: how many routes there are of each type of the summary; trains count that lie in the box whole, none without a box."""
    inside = routes_inside(points, bbox).where("inside").select("route_id") if bbox else routes.select("route_id").where("false")
    counted = routes.where("route_type <> 'train'").unionByName(routes.where("route_type = 'train'").join(inside, "route_id", "left_semi"))
    titles = F.create_map(*[F.lit(x) for title, kind in TYPE_TITLES.items() for x in (kind, title)])
    sums = counted.groupBy(F.try_element_at(titles, F.col("route_type")).alias("title")).agg(F.count("*").alias("routes"))
    every = routes.sparkSession.createDataFrame([(t,) for t in TYPE_TITLES], "title string")
    return every.join(sums, "title", "left").select("title", F.coalesce("routes", F.lit(0)).alias("routes"))


def density(unique_km: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Kilometres of the network's union per square kilometre of a box, of 111 km a degree; null for a box without an area."""
    south, west, north, east = bbox
    area = (north - south) * 111.0 * (east - west) * 111.0 * math.cos(math.radians((south + north) / 2))
    return F.round(unique_km / area, 3) if area > 0 else F.lit(None).cast("double")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows that agree in the keys, the first in the order."""
    turn = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("turn_of_key", F.row_number().over(turn)).where("turn_of_key = 1").drop("turn_of_key")


def stop_key(stop_id: Column, name: Column) -> Column:
    return F.coalesce(stop_id.cast("string"), F.concat(F.lit("name:"), text.normalize_stop_name(name)))


def unique_stops(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """From ``(route_id, di, seq, stop_id, stop_name, lat, lon)``: a row per stop key.

    Routes with an error do not count. The first occurrence names the stop, the first with both coordinates places it; types and routes are sorted sets.
    """
    order = F.struct("route_id", "di", "seq")
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    keyed = stops.join(routes.where("error IS NULL").select("route_id", "route_type"), "route_id").withColumn("key", stop_key(F.col("stop_id"), F.col("stop_name")))
    # coordinates together: a struct as order makes each aggregate one more that is sorted
    found = keyed.groupBy("key").agg(
        F.min_by("stop_id", order).alias("stop_id"),
        F.min_by(text.squeeze(F.col("stop_name")), order).alias("name"),
        F.min_by(F.struct("lat", "lon", "seq"), F.when(placed, order)).alias("at"),
        F.sort_array(F.collect_set("route_type")).alias("types"),
        F.sort_array(F.collect_set("route_id")).alias("routes"),
    )
    return found.select("key", "stop_id", "name", "at.lat", "at.lon", F.col("at.seq").alias("idx"), "types", "routes")


def endpoints(stops: DataFrame) -> DataFrame:
    """route_id, di, first_stop, last_stop."""
    return stops.groupBy(*DIRECTION).agg(F.min_by("stop_name", "seq").alias("first_stop"), F.max_by("stop_name", "seq").alias("last_stop"))


def terminal_groups(stops: DataFrame) -> DataFrame:
    """key, routes: the routes that begin or end at a terminal, by its cleaned and normalised name."""
    ends = endpoints(stops).select("route_id", F.explode(F.array("first_stop", "last_stop")).alias("name"))
    keyed = ends.select("route_id", text.normalize_terminal(text.clean_terminal_name(F.col("name"))).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.sort_array(F.collect_set("route_id")).alias("routes"))


def stops_area_km2(stops: DataFrame) -> DataFrame:
    """One row: area of the stops' bounding box on a plane of 111 km a degree."""
    high = (F.max("lat") - F.min("lat")) * 111.0
    wide = (F.max("lon") - F.min("lon")) * 111.0 * F.cos(F.radians((F.max("lat") + F.min("lat")) / 2))
    return stops.agg((high * wide).alias("area_km2"))


def route_count_estimate(population_thousand: Column, area_km2: Column, stops: Column, transfer: Column) -> Column:
    # The regression's weights.
    estimate = (0.156 * population_thousand + 0.729 * area_km2 + 0.375 * stops) / (10.4 * F.greatest(transfer, F.lit(0.1)))
    return F.greatest(F.lit(1), F.rint(estimate).cast("bigint"))


def unshifted(lat: Column, lon: Column, index: Column) -> tuple[Column, Column]:
    out = []
    for value, shift in ((lat, LAT_SHIFT), (lon, LON_SHIFT)):
        by = F.get(F.array(*[F.lit(x) for x in shift]), (index % 8).cast("int"))
        out.append(F.rint((value - by) * 1e7) / 1e7)
    return out[0], out[1]


def fixed_coordinate(lat: Column, lon: Column, index: Column, bbox: tuple[float, float, float, float] | None = None) -> Column:
    """A struct: the point in the box as it is, else un-shifted, else null; without a box whichever is on the globe."""
    la, lo = unshifted(lat, lon, index)
    raw, moved = F.struct(lat.alias("lat"), lon.alias("lon")), F.struct(la.alias("lat"), lo.alias("lon"))
    globe = (-90.0, -180.0, 90.0, 180.0)
    if bbox:
        return F.when(in_bbox(lat, lon, bbox), raw).when(in_bbox(la, lo, bbox), moved).when(in_bbox(la, lo, globe), moved).when(in_bbox(lat, lon, globe), raw)
    return F.when(in_bbox(lat, lon, globe), raw).when(in_bbox(la, lo, globe), moved)


def schedule_summary(departures: DataFrame) -> DataFrame:
    """From ``(route_id, hhmm, weekday, weekend)``: first and last minute, trips, headway and days of each route.

    The headway spans all times and counts weekday trips, or all where there are none.
    """
    valid = departures.withColumn("minute", text.minutes(F.col("hhmm"))).where("minute IS NOT NULL")
    sums = valid.groupBy("route_id").agg(
        F.min("minute").alias("first"),
        F.max("minute").alias("last"),
        F.count("*").alias("trips"),
        F.count_if("weekday").alias("weekday_trips"),
        F.count_if("weekend").alias("weekend_trips"),
    )
    n = F.when(F.col("weekday_trips") > 0, F.col("weekday_trips")).otherwise(F.col("trips"))
    head = F.when(n > 1, (F.col("last") - F.col("first")) / (n - 1)).otherwise(0.0)
    work, rest = F.col("weekday_trips") > 0, F.col("weekend_trips") > 0
    days = F.when(work & rest, "ежедневно").when(work, "будни").when(rest, "выходные").otherwise("")
    return sums.select("route_id", "first", "last", "weekday_trips", "weekend_trips", head.alias("head_minutes"), days.alias("days"))

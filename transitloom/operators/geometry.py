"""Directions, their segments and measures, and filters by geometry.

points: ``(route_id, di, seq, lat, lon)``, a row a point; (route_id, di) names a direction for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, STRAIGHT_EPS_KM, haversine_km, utm_epsg, with_utm_xy

DIRECTION = ["route_id", "di"]


def segments(points: DataFrame) -> DataFrame:
    """Every point but the first of its direction with the point before it: lat1, lon1, lat2, lon2."""
    order = Window.partitionBy(*DIRECTION).orderBy("seq")
    before = points.withColumns({"lat1": F.lag("lat").over(order), "lon1": F.lag("lon").over(order)})
    return before.where("lat1 IS NOT NULL AND lon1 IS NOT NULL").select(*DIRECTION, "seq", "lat1", "lon1", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))


def segment_km() -> Column:
    return haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))


def direction_km(points: DataFrame) -> DataFrame:
    """route_id, di, points, km, base_km, curvilinearity.

    base_km is the greatest distance between points. Of more than 100 points every (n div 100)-th and
    the last are compared. One row a direction holds its points as an array, so the pairs meet in
    a row and not in a join. curvilinearity is 0 for a direction without length and infinite
    where base_km is below the least base.
    """
    packed = points.groupBy(*DIRECTION).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("line"))
    index = F.sequence(F.lit(1), F.size("line") - 1)
    step = F.when(F.size("line") > 100, F.expr("size(line) div 100")).otherwise(1)

    def between(a: Column, b: Column) -> Column:
        return haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])

    km = F.when(F.size("line") < 2, 0.0).otherwise(F.aggregate(index, F.lit(0.0), lambda s, i: s + between(F.get("line", i - 1), F.get("line", i))))
    picked = F.filter("line", lambda p, i: (i % step == 0) | (i == F.size("line") - 1))
    wide = packed.select(*DIRECTION, F.size("line").cast("bigint").alias("points"), km.alias("km"), picked.alias("picked"))
    far = F.array_max(F.transform("picked", lambda a: F.array_max(F.transform("picked", lambda b: between(a, b)))))
    out = wide.select(*DIRECTION, "points", "km", F.coalesce(far, F.lit(0.0)).alias("base_km"))
    curve = F.when(F.col("km") <= 0, 0.0).when(F.col("base_km") < STRAIGHT_EPS_KM, float("inf")).otherwise(F.col("km") / F.col("base_km"))
    return out.withColumn("curvilinearity", curve)


def route_measures(directions: DataFrame) -> DataFrame:
    """route_id, min_km, max_km, curvilinearity (the largest)."""
    return directions.groupBy("route_id").agg(
        F.coalesce(F.min("km"), F.lit(0.0)).alias("min_km"),
        F.coalesce(F.max("km"), F.lit(0.0)).alias("max_km"),
        F.coalesce(F.max("curvilinearity"), F.lit(0.0)).alias("curvilinearity"),
    )


def network_bbox(points: DataFrame, buffer_deg: float = 0.0) -> DataFrame:
    """One row: south, west, north, east of all finite points, widened and clipped to the globe; null if none."""
    grow = max(0.0, buffer_deg)
    finite = points.where("NOT isnan(lat) AND NOT isnan(lon)")
    return finite.agg(
        F.greatest(F.min("lat") - grow, F.lit(-90.0)).alias("south"),
        F.greatest(F.min("lon") - grow, F.lit(-180.0)).alias("west"),
        F.least(F.max("lat") + grow, F.lit(90.0)).alias("north"),
        F.least(F.max("lon") + grow, F.lit(180.0)).alias("east"),
    )


def in_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float]) -> Column:
    south, west, north, east = bbox
    return F.coalesce(lat.between(south, north) & lon.between(west, east) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def routes_inside(points: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """route_id, inside: whether all points are in the box."""
    return points.groupBy("route_id").agg(F.bool_and(in_bbox(F.col("lat"), F.col("lon"), bbox)).alias("inside"))


def beyond_radius(points: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """route_id, far_km (of its farthest point), beyond."""
    far = F.max(haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)))
    return points.groupBy("route_id").agg(far.alias("far_km")).withColumn("beyond", F.col("far_km") > radius_km)


def route_limits(points: DataFrame, curvilinearity: float = 0.0, min_km: float = 0.0, radius_km: float = 0.0, center: tuple[float, float] | None = None) -> DataFrame:
    """route_id, min_km, curvilinearity, reason: the first limit that a route breaks, null for routes that stay.

    A limit of 0 is off, as is the radius without a center.
    """
    measures = route_measures(direction_km(points))
    reason = F.when(F.lit(False), F.lit(""))
    if curvilinearity > 0:
        reason = reason.when(F.col("curvilinearity") > curvilinearity, "криволинейность")
    if min_km > 0:
        reason = reason.when(F.col("min_km") < min_km, "длина")
    if radius_km > 0 and center:
        measures = measures.join(beyond_radius(points, *center, radius_km).select("route_id", "beyond"), "route_id")
        reason = reason.when(F.col("beyond"), "радиус")
    return measures.select("route_id", "min_km", "curvilinearity", reason.alias("reason"))


def network_center(points: DataFrame) -> DataFrame:
    """route_id, di, center_km: distance of each direction's centroid from the mean of the centroids."""
    centroids = points.groupBy(*DIRECTION).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    center = centroids.agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"))  # one row
    return centroids.join(F.broadcast(center)).select(
        *DIRECTION, haversine_km(F.col("lat"), F.col("lon"), F.col("center_lat"), F.col("center_lon")).alias("center_km")
    )


def projected(points: DataFrame) -> DataFrame:
    """Points with x and y in metres, in the one UTM zone of the network's mean point."""
    zone = points.agg(utm_epsg(F.avg("lat"), F.avg("lon")).alias("epsg"))  # one row
    return with_utm_xy(points.join(F.broadcast(zone)))


def local_xy(points: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Points with x and y in metres on a plane that touches the globe at (lat0, lon0)."""
    import math

    shrink = math.cos(math.radians(lat0))
    return points.withColumns({"x": (F.col("lon") - lon0) * METRES_PER_DEGREE * shrink, "y": (F.col("lat") - lat0) * METRES_PER_DEGREE})


def without_exact_repeats(points: DataFrame) -> DataFrame:
    """Points without those that are where the point before them is."""
    here, order = F.struct("lat", "lon"), Window.partitionBy(*DIRECTION).orderBy("seq")
    return points.withColumn("before", F.lag(here).over(order)).where(~here.eqNullSafe(F.col("before"))).drop("before")


def without_repeats(points: DataFrame, eps: float = 0.01) -> DataFrame:
    """Points with finite x and y, without those in the same cell of an ``eps`` grid as the point before."""
    order = Window.partitionBy(*DIRECTION).orderBy("seq")
    finite = points.where("NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('Infinity') AND abs(y) < double('Infinity')")
    cell = F.struct(F.rint(F.col("x") / eps), F.rint(F.col("y") / eps))
    return finite.withColumn("cell", cell).withColumn("last", F.lag("cell").over(order)).where(~F.col("cell").eqNullSafe(F.col("last"))).drop("cell", "last")


def signatures(points: DataFrame) -> DataFrame:
    """route_id, di, signature: a digest of a direction's coordinates in their order, to four decimals."""
    point = F.concat_ws(",", *[F.format_string("%.4f", F.when(F.round(c, 4) == 0, 0.0).otherwise(F.col(c))) for c in ("lat", "lon")])
    line = points.groupBy(*DIRECTION).agg(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))).alias("line"))
    return line.select(*DIRECTION, F.substring(F.sha2(F.array_join(F.transform("line", lambda x: x["p"]), ";"), 256), 1, 10).alias("signature"))

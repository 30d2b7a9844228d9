"""Geodesic and planar functions on columns. Angles are degrees, distances kilometres unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Earth diameter, and lengths below which a base line counts as a point.
EARTH_DIAMETER_KM = 12742.0
STRAIGHT_EPS_KM = 1e-6
KM_PER_DEGREE = 111.0
METRES_PER_DEGREE = 111_000.0


def valid_point(lat: Column, lon: Column) -> Column:
    """True for finite coordinates on the globe; null coordinates are not valid."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_DIAMETER_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def haversine_atan_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The arc tangent form, for points close to each other's antipodes."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_DIAMETER_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def angle(a: tuple, b: tuple) -> Column:
    """Radians between vectors, well conditioned at 0 and pi."""
    n = cross(a, b)
    return F.atan2(F.sqrt(dot(n, n)), dot(a, b))


def segment_distance_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of a point from the arc between two others.

    The foot of the perpendicular counts where it lies between the ends: the point's components
    along the two inward normals at the ends are then not negative. Otherwise the nearer end counts, as
    for a segment without length.
    """
    p, a, b = unit_vector(lat, lon), unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    n = cross(a, b)
    size = F.sqrt(dot(n, n))
    ends = F.least(haversine_km(lat, lon, lat1, lon1), haversine_km(lat, lon, lat2, lon2))
    between = (dot(cross(n, a), p) >= -1e-12 * size) & (dot(cross(b, n), p) >= -1e-12 * size)
    off = F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(n, p) / size))))
    return F.when((size > 1e-15) & between, EARTH_DIAMETER_KM / 2 * off).otherwise(ends)


def planar_segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a local plane of 111 km a degree, longitudes shrunk at the segment's middle latitude."""
    shrink = F.cos(F.radians((lat1 + lat2) / 2))
    bx, by = (lon2 - lon1) * shrink, lat2 - lat1
    px, py = (lon - lon1) * shrink, lat - lat1
    size = bx * bx + by * by
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / size))).otherwise(0.0)
    return KM_PER_DEGREE * F.sqrt(F.pow(px - t * bx, 2) + F.pow(py - t * by, 2))


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)).cast("int")
    return F.when(lat >= 0, zone + 32600).otherwise(zone + 32700)


def with_utm_xy(points: DataFrame, epsg: str = "epsg") -> DataFrame:
    """Points with easting x and northing y in metres (WGS84): transverse Mercator by the Krueger series to the sixth order.

    Steps are columns of their own, so that no expression is evaluated or copied more than once.
    """
    # The ellipsoid and the series in its third flattening n.
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    e = (f * (2 - f)) ** 0.5
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    c = F.col
    steps = [
        {"utm_s": F.sin(F.radians("lat")), "utm_d": F.radians(c("lon") - ((c(epsg) % 100) * 6 - 183))},
        {"utm_t": F.sinh(atanh(c("utm_s")) - e * atanh(e * c("utm_s")))},
        {"utm_xi": F.atan2("utm_t", F.cos("utm_d")), "utm_eta": atanh(F.sin("utm_d") / F.sqrt(1 + c("utm_t") * c("utm_t")))},
        {
            "x": k0 * radius * (c("utm_eta") + sum(k * F.cos(2 * j * c("utm_xi")) * F.sinh(2 * j * c("utm_eta")) for j, k in enumerate(alpha, 1))) + 500_000.0,
            "y": k0 * radius * (c("utm_xi") + sum(k * F.sin(2 * j * c("utm_xi")) * F.cosh(2 * j * c("utm_eta")) for j, k in enumerate(alpha, 1)))
            + F.when(c(epsg) >= 32700, 10_000_000.0).otherwise(0.0),
        },
    ]
    for step in steps:
        points = points.withColumns(step)
    return points.drop("utm_s", "utm_d", "utm_t", "utm_xi", "utm_eta")


#: The code of the Mollweide projection, and steps of Newton's method for its auxiliary angle: exact to a micrometre below 85 degrees.
MOLLWEIDE, NEWTON_STEPS = 54009, 12
_RADIUS = 6378137.0


def with_mollweide_xy(points: DataFrame) -> DataFrame:
    """Points with x and y in metres of the equal-area Mollweide projection on a sphere of the ellipsoid's greater radius."""
    # 2 t + sin 2 t = pi sin lat, solved for 2 t; at the poles the slope is 0 and t is the latitude
    points = points.withColumns({"moll_s": F.pi() * F.sin(F.radians("lat")), "moll_t": 2 * F.radians("lat")})
    t = F.col("moll_t")
    for _ in range(NEWTON_STEPS):
        slope = 1 + F.cos(t)
        points = points.withColumn("moll_t", F.when(F.abs("lat") >= 89.9999, t).otherwise(t - (t + F.sin(t) - F.col("moll_s")) / slope))
    x = 2 * 2**0.5 / math.pi * _RADIUS * F.radians("lon") * F.cos(t / 2)
    return points.withColumns({"x": x, "y": 2**0.5 * _RADIUS * F.sin(t / 2)}).drop("moll_s", "moll_t")


def mollweide_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """lat, lon of a place in the Mollweide projection; null outside the globe."""
    sine = y / (2**0.5 * _RADIUS)
    t = F.asin(F.when(F.abs(sine) <= 1, sine))
    lon = F.degrees(math.pi * x / (2 * 2**0.5 * _RADIUS * F.cos(t)))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (2 * t + F.sin(2 * t)) / math.pi)))), F.when(F.abs(lon) <= 180, lon)


def is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def with_projected_xy(points: DataFrame, epsg: str = "epsg") -> DataFrame:
    """Points with x and y in metres in the projection that each row names: a UTM zone or ``MOLLWEIDE``; null for any other, and for a pole in UTM."""
    fit = is_utm(F.col(epsg)) & (F.abs("lat") < 90)
    utm = with_utm_xy(points.withColumns({"any_lat": F.col("lat"), "lat": F.when(fit, F.col("lat"))}), epsg)
    utm = utm.withColumnsRenamed({"x": "utm_x", "y": "utm_y"}).withColumn("lat", F.col("any_lat")).drop("any_lat")
    both = with_mollweide_xy(utm).withColumnsRenamed({"x": "moll_x", "y": "moll_y"})
    pick = {c: F.when(is_utm(F.col(epsg)), F.col(f"utm_{c}")).when(F.col(epsg) == MOLLWEIDE, F.col(f"moll_{c}")) for c in "xy"}
    return both.withColumns(pick).drop("utm_x", "utm_y", "moll_x", "moll_y")

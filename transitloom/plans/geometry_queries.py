"""Queries of geometry, measures and filters by geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import geometry as g
from .register import Register
from .surrogate import Views

REGISTER = Register()
BBOX = (51.61, 39.1, 51.75, 39.25)
CENTER = (51.67, 39.2)
_SEGMENTS = """seg AS (SELECT * FROM (SELECT route_id, di, seq, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1, lat AS lat2, lon AS lon2
FROM v_zigzag WINDOW w AS (PARTITION BY route_id, di ORDER BY seq)) WHERE lat1 IS NOT NULL)"""
_KM = f"""{_SEGMENTS}, km AS (SELECT route_id, di, sum({{hav lat1 lon1 lat2 lon2}}) AS km FROM seg GROUP BY ALL),
num AS (SELECT route_id, di, seq, lat, lon, row_number() OVER (PARTITION BY route_id, di ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY route_id, di) AS n FROM v_zigzag),
pick AS (SELECT * FROM num WHERE n <= 100 OR i % (n // 100) = 0 OR i = n - 1),
base AS (SELECT a.route_id, a.di, max({{hav a.lat a.lon b.lat b.lon}}) AS base_km FROM pick a JOIN pick b USING (route_id, di) GROUP BY ALL),
cnt AS (SELECT route_id, di, count(*) AS points FROM v_zigzag GROUP BY ALL),
dirs AS (SELECT route_id, di, points, coalesce(km, 0.0) AS km, base_km,
  CASE WHEN coalesce(km, 0.0) <= 0 THEN 0.0 WHEN base_km < 1e-6 THEN CAST('Infinity' AS DOUBLE) ELSE km / base_km END AS curvilinearity
  FROM cnt JOIN base USING (route_id, di) LEFT JOIN km USING (route_id, di)),
meas AS (SELECT route_id, min(km) AS min_km, max(km) AS max_km, max(curvilinearity) AS curvilinearity FROM dirs GROUP BY ALL)"""


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@REGISTER("w1_segments", f"WITH {_SEGMENTS} SELECT * FROM seg")
def _(v: Views) -> DataFrame:
    return g.segments(v.zigzag)


@REGISTER("m1_haversine", f"WITH {_SEGMENTS} SELECT route_id, di, seq, round({{hav lat1 lon1 lat2 lon2}}, 6) AS km FROM seg")
def _(v: Views) -> DataFrame:
    return g.segments(v.zigzag).select("route_id", "di", "seq", F.round(g.segment_km(), 6).alias("km"))


@REGISTER("m2_haversine_atan", f"WITH {_SEGMENTS} SELECT route_id, di, seq, round({{hav lat1 lon1 lat2 lon2}}, 6) AS km FROM seg")
def _(v: Views) -> DataFrame:
    km = geo.haversine_atan_km(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")])
    return g.segments(v.zigzag).select("route_id", "di", "seq", F.round(km, 6).alias("km"))


_ENDS = """ends AS (SELECT route_id, di, min_by(lat, seq) AS lat1, min_by(lon, seq) AS lon1, max_by(lat, seq) AS lat2, max_by(lon, seq) AS lon2 FROM v_zigzag GROUP BY ALL),
p AS (SELECT route_id, di, seq, lat, lon, lat1, lon1, lat2, lon2 FROM v_zigzag JOIN ends USING (route_id, di))"""


def _ends(v: Views) -> DataFrame:
    ends = v.zigzag.groupBy("route_id", "di").agg(*[f(c, "seq").alias(c + k) for k, f in (("1", F.min_by), ("2", F.max_by)) for c in ("lat", "lon")])
    return v.zigzag.join(ends, ["route_id", "di"])


_VECTORS = """, u AS (SELECT *, cos(radians(lat))*cos(radians(lon)) AS px, cos(radians(lat))*sin(radians(lon)) AS py, sin(radians(lat)) AS pz,
 cos(radians(lat1))*cos(radians(lon1)) AS ax, cos(radians(lat1))*sin(radians(lon1)) AS ay, sin(radians(lat1)) AS az,
 cos(radians(lat2))*cos(radians(lon2)) AS bx, cos(radians(lat2))*sin(radians(lon2)) AS bw, sin(radians(lat2)) AS bz FROM p),
n AS (SELECT *, ay*bz-az*bw AS nx, az*bx-ax*bz AS ny, ax*bw-ay*bx AS nz FROM u),
s AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS size FROM n)"""


@REGISTER(
    "m3_segment_distance",
    f"""WITH {_ENDS}{_VECTORS}
SELECT route_id, di, seq, round(CASE WHEN size > 1e-15
  AND (ny*az-nz*ay)*px+(nz*ax-nx*az)*py+(nx*ay-ny*ax)*pz >= -1e-12*size AND (bw*nz-bz*ny)*px+(bz*nx-bx*nz)*py+(bx*ny-bw*nx)*pz >= -1e-12*size
  THEN 6371.0*abs(asin(greatest(-1.0, least(1.0, (nx*px+ny*py+nz*pz)/nullif(size, 0)))))
  ELSE least({{hav lat lon lat1 lon1}}, {{hav lat lon lat2 lon2}}) END, 6) AS km FROM s""",
)
def _(v: Views) -> DataFrame:
    km = geo.segment_distance_km(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")])
    return _ends(v).select("route_id", "di", "seq", F.round(km, 6).alias("km"))


@REGISTER("m4_angle", f"WITH {_ENDS}{_VECTORS} SELECT route_id, di, seq, round(atan2(size, ax*bx+ay*bw+az*bz), 6) AS radians FROM s")
def _(v: Views) -> DataFrame:
    a, b = (geo.unit_vector(F.col("lat" + k), F.col("lon" + k)) for k in "12")
    return _ends(v).select("route_id", "di", "seq", F.round(geo.angle(a, b), 6).alias("radians"))


@REGISTER(
    "m5_planar_distance",
    f"""WITH {_ENDS}, q AS (SELECT *, cos(radians((lat1+lat2)/2)) AS c FROM p),
d AS (SELECT *, (lon2-lon1)*c AS bx, lat2-lat1 AS bw, (lon-lon1)*c AS px, lat-lat1 AS py FROM q),
t AS (SELECT *, CASE WHEN bx*bx+bw*bw > 0 THEN greatest(0.0, least(1.0, (px*bx+py*bw)/(bx*bx+bw*bw))) ELSE 0.0 END AS t FROM d)
SELECT route_id, di, seq, round(111.0*sqrt(pow(px-t*bx, 2)+pow(py-t*bw, 2)), 6) AS km FROM t""",
)
def _(v: Views) -> DataFrame:
    km = geo.planar_segment_km(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")])
    return _ends(v).select("route_id", "di", "seq", F.round(km, 6).alias("km"))


@REGISTER("m7_utm_zone", "SELECT CAST(32600 + least(60, greatest(1, floor((avg(lon) + 180) / 6) + 1)) AS INTEGER) AS epsg FROM v_zigzag")
def _(v: Views) -> DataFrame:
    return v.zigzag.agg(geo.utm_epsg(F.avg("lat"), F.avg("lon")).alias("epsg"))


@REGISTER("m8_projection")
def _(v: Views) -> DataFrame:
    return g.projected(v.zigzag).select("route_id", "di", "seq", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@REGISTER(
    "w2_grid_dedupe",
    """WITH c AS (SELECT route_id, di, seq, round_even((lon - 39.1) * 111000.0 * cos(radians(51.6)) / 500.0, 0) AS cx, round_even((lat - 51.6) * 111000.0 / 500.0, 0) AS cy FROM v_zigzag),
l AS (SELECT *, lag(cx) OVER w AS lx, lag(cy) OVER w AS ly FROM c WINDOW w AS (PARTITION BY route_id, di ORDER BY seq))
SELECT route_id, di, seq FROM l WHERE cx IS DISTINCT FROM lx OR cy IS DISTINCT FROM ly""",
)
def _(v: Views) -> DataFrame:
    return g.without_repeats(g.local_xy(v.zigzag, 51.6, 39.1), 500.0).select("route_id", "di", "seq")


@REGISTER("ag1_polyline_km", f"WITH {_SEGMENTS} SELECT route_id, di, round(sum({{hav lat1 lon1 lat2 lon2}}), 6) AS km FROM seg GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return g.segments(v.zigzag).groupBy("route_id", "di").agg(F.round(F.sum(g.segment_km()), 6).alias("km"))


@REGISTER("ag2_diameter", f"WITH {_KM} SELECT route_id, di, round(base_km, 6) AS base_km FROM dirs")
def _(v: Views) -> DataFrame:
    return g.direction_km(v.zigzag).select("route_id", "di", *_r("base_km"))


@REGISTER("ag3_direction_measures", f"WITH {_KM} SELECT route_id, di, points, round(km, 6) AS km, round(base_km, 6) AS base_km, round(curvilinearity, 6) AS curvilinearity FROM dirs")
def _(v: Views) -> DataFrame:
    return g.direction_km(v.zigzag).select("route_id", "di", "points", *_r("km", "base_km", "curvilinearity"))


@REGISTER("ag4_route_measures", f"WITH {_KM} SELECT route_id, round(min_km, 6) AS min_km, round(max_km, 6) AS max_km, round(curvilinearity, 6) AS curvilinearity FROM meas")
def _(v: Views) -> DataFrame:
    return g.route_measures(g.direction_km(v.zigzag)).select("route_id", *_r("min_km", "max_km", "curvilinearity"))


@REGISTER("ag5_network_bbox", "SELECT greatest(min(lat) - 0.01, -90.0) AS south, greatest(min(lon) - 0.01, -180.0) AS west, least(max(lat) + 0.01, 90.0) AS north, least(max(lon) + 0.01, 180.0) AS east FROM v_zigzag")
def _(v: Views) -> DataFrame:
    return g.network_bbox(v.zigzag, 0.01)


_IN = f"lat BETWEEN {BBOX[0]} AND {BBOX[2]} AND lon BETWEEN {BBOX[1]} AND {BBOX[3]}"
_LIMITS = f"""lim AS (SELECT route_id, min_km, curvilinearity, CASE WHEN curvilinearity > 2.0 THEN 'криволинейность' WHEN min_km < 5.0 THEN 'длина' WHEN far > 12.0 THEN 'радиус' END AS reason
FROM meas JOIN (SELECT route_id, max({{hav lat lon {CENTER[0]} {CENTER[1]}}}) AS far FROM v_zigzag GROUP BY ALL) USING (route_id))"""


@REGISTER("f7_route_limits", f"WITH {_KM}, {_LIMITS} SELECT route_id, round(min_km, 6) AS min_km, round(curvilinearity, 6) AS curvilinearity, reason FROM lim")
def _(v: Views) -> DataFrame:
    return g.route_limits(v.zigzag, 2.0, 5.0, 12.0, CENTER).select("route_id", *_r("min_km", "curvilinearity"), "reason")


@REGISTER("ag16_exclusion_counts", f"WITH {_KM}, {_LIMITS} SELECT reason, count(*) AS routes FROM lim WHERE reason IS NOT NULL GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return g.route_limits(v.zigzag, 2.0, 5.0, 12.0, CENTER).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("routes"))


@REGISTER("snk9_excluded", f"WITH {_KM}, {_LIMITS} SELECT name, route_type, route_id, reason, round(min_km, 2) AS min_km FROM lim JOIN v_routes USING (route_id) WHERE reason IS NOT NULL")
def _(v: Views) -> DataFrame:
    out = g.route_limits(v.zigzag, 2.0, 5.0, 12.0, CENTER).where("reason IS NOT NULL")
    return out.join(v.routes, "route_id").select("name", "route_type", "route_id", "reason", F.round("min_km", 2).alias("min_km"))


@REGISTER("f8_radius", f"SELECT route_id, round(max({{hav lat lon {CENTER[0]} {CENTER[1]}}}), 6) AS far_km, max({{hav lat lon {CENTER[0]} {CENTER[1]}}}) > 12.0 AS beyond FROM v_zigzag GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return g.beyond_radius(v.zigzag, *CENTER, 12.0).select("route_id", *_r("far_km"), "beyond")


@REGISTER("f9_routes_inside", f"SELECT route_id, bool_and({_IN}) AS inside FROM v_zigzag GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return g.routes_inside(v.zigzag, BBOX)


@REGISTER("f10_fully_in_bbox", f"SELECT route_id, coalesce(bool_and({_IN}), true) AS inside FROM v_routes LEFT JOIN v_points USING (route_id) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    inside = g.routes_inside(v.points, BBOX)
    return v.routes.select("route_id").join(inside, "route_id", "left").select("route_id", F.coalesce("inside", F.lit(True)).alias("inside"))


@REGISTER("f11_select_secondary", f"SELECT route_id FROM v_points GROUP BY ALL HAVING bool_and({_IN})")
def _(v: Views) -> DataFrame:
    return g.routes_inside(v.points, BBOX).where("inside").select("route_id")


@REGISTER("f12_points_in_bbox", f"SELECT route_id, di, seq FROM v_zigzag WHERE {_IN}")
def _(v: Views) -> DataFrame:
    return v.zigzag.where(g.in_bbox(F.col("lat"), F.col("lon"), BBOX)).select("route_id", "di", "seq")


@REGISTER("f16_valid_coordinates", "SELECT count(*) AS stops, count_if(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) AS valid FROM v_stops_seq")
def _(v: Views) -> DataFrame:
    return v.stops_seq.agg(F.count("*").alias("stops"), F.count_if(geo.valid_point(F.col("lat"), F.col("lon"))).alias("valid"))


@REGISTER(
    "ag13_center_distances",
    """WITH c AS (SELECT route_id, di, avg(lat) AS lat, avg(lon) AS lon FROM v_points GROUP BY ALL), m AS (SELECT avg(lat) AS mlat, avg(lon) AS mlon FROM c)
SELECT route_id, di, round({hav lat lon mlat mlon}, 6) AS center_km FROM c, m""",
)
def _(v: Views) -> DataFrame:
    return g.network_center(v.points).select("route_id", "di", *_r("center_km"))


@REGISTER(
    "p23_units",
    """SELECT p.route_id, p.di, concat(CAST(p.route_id AS VARCHAR), ':', CAST(p.di AS VARCHAR)) AS key,
concat(name, ' (', CASE WHEN p.di = 0 THEN 'туда' ELSE 'обратно' END, ')') AS name, count(*) AS points
FROM v_points p JOIN v_routes r USING (route_id) WHERE error IS NULL GROUP BY ALL HAVING count(*) >= 2""",
)
def _(v: Views) -> DataFrame:
    units = v.points.groupBy("route_id", "di").agg(F.count("*").alias("points")).where("points >= 2").join(v.routes.where("error IS NULL"), "route_id")
    return units.select("route_id", "di", F.concat_ws(":", "route_id", "di").alias("key"), text.unit_name(F.col("name"), F.col("di")).alias("name"), "points")


@REGISTER(
    "s9_geometry_signature",
    """WITH p AS (SELECT route_id, di, seq, printf('%.4f', CASE WHEN round(lat, 4) = 0 THEN 0.0 ELSE lat END) || ',' || printf('%.4f', CASE WHEN round(lon, 4) = 0 THEN 0.0 ELSE lon END) AS p FROM v_zigzag)
SELECT route_id, di, left(sha256(string_agg(p, ';' ORDER BY seq, p)), 10) AS signature FROM p GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    return g.signatures(v.zigzag)

"""Queries of rasters, corridors, volumes around stops and the heat map."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import heat_color
from ..operators import corridor, mosaic, network, overlap, raster
from ..tables import numbered
from .network_queries import _STOPS
from .register import Register
from .surrogate import Views

REGISTER = Register()
HALF = 2
BBOX = (51.6, 39.1, 51.66, 39.163)
_VAL = "CASE WHEN raw_value <> 4294967295 AND raw_value >= 0 AND raw_value <= 100000 THEN raw_value ELSE 0.0 END"
_VOL = f"""{_STOPS}, pt AS (SELECT key, lat, lon, CAST(round_even((51.66 - lat) / 0.001, 0) AS BIGINT) AS r, CAST(round_even((lon - 39.1) / 0.001, 0) AS BIGINT) AS c FROM us WHERE lat IS NOT NULL AND lon IS NOT NULL),
vol AS (SELECT key, lat, lon, coalesce(sum({_VAL}), 0.0) AS volume FROM pt LEFT JOIN v_pixels ON row_no BETWEEN r - {HALF} AND r + {HALF} AND col_no BETWEEN c - {HALF} AND c + {HALF} GROUP BY key, pt.lat, pt.lon)"""
_VOL = _VOL.replace("SELECT key, lat, lon, coalesce", "SELECT key, pt.lat, pt.lon, coalesce")


def _placed(v: Views) -> DataFrame:
    return network.unique_stops(v.stops_seq, v.routes).where("lat IS NOT NULL AND lon IS NOT NULL").select("key", "lat", "lon")


def _volumes(v: Views) -> DataFrame:
    stops = _placed(v)
    return stops.join(raster.window_sums(v.pixels, raster.point_squares(stops, "key", HALF), "key"), "key")


@REGISTER("r10_clean_values", f"SELECT row_no, col_no, {_VAL} AS value FROM v_pixels")
def _(v: Views) -> DataFrame:
    return v.pixels.select("row_no", "col_no", raster.clean_value(F.col("raw_value")).alias("value"))


@REGISTER("src17_tile_sums", f"SELECT tile_id, sum({_VAL}) AS volume, count(*) AS pixels FROM v_pixels GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return v.pixels.groupBy("tile_id").agg(F.sum(raster.clean_value(F.col("raw_value"))).alias("volume"), F.count("*").alias("pixels"))


@REGISTER("w6_prefix_sums", f"""WITH e AS (SELECT min(row_no) AS r0, max(row_no) AS r1, min(col_no) AS c0, max(col_no) AS c1 FROM v_pixels), g AS (SELECT unnest(range(r0, r1 + 1)) AS row_no, c0, c1 FROM e),
h AS (SELECT row_no, unnest(range(c0, c1 + 1)) AS col_no FROM g), f AS (SELECT h.row_no, h.col_no, coalesce({_VAL}, 0.0) AS value FROM h LEFT JOIN v_pixels p ON h.row_no = p.row_no AND h.col_no = p.col_no),
a AS (SELECT row_no, col_no, sum(value) OVER (PARTITION BY row_no ORDER BY col_no) AS s FROM f) SELECT row_no, col_no, sum(s) OVER (PARTITION BY col_no ORDER BY row_no) AS total FROM a""")
def _(v: Views) -> DataFrame:
    return raster.prefix_sums(v.pixels)


@REGISTER("r6_window_sums", f"WITH s AS (SELECT DISTINCT s_suppkey AS square, s_suppkey * 3 % 60 AS r, s_suppkey * 7 % 60 AS c FROM supplier) SELECT square, coalesce(sum({_VAL}), 0.0) AS volume FROM s LEFT JOIN v_pixels ON row_no BETWEEN r AND r + 5 AND col_no BETWEEN c AND c + 9 GROUP BY ALL")
def _(v: Views) -> DataFrame:
    squares = v.supplier.selectExpr("s_suppkey AS square", "s_suppkey * 3 % 60 AS row_lo", "s_suppkey * 3 % 60 + 5 AS row_hi", "s_suppkey * 7 % 60 AS col_lo", "s_suppkey * 7 % 60 + 9 AS col_hi")
    return raster.window_sums(v.pixels, squares, "square")


@REGISTER("r9_stop_volumes", f"WITH {_VOL} SELECT key, volume FROM vol")
def _(v: Views) -> DataFrame:
    return _volumes(v).select("key", "volume")


@REGISTER("j3_stops_with_volumes", f"WITH {_VOL} SELECT us.key, coalesce(volume, 0.0) AS volume FROM us LEFT JOIN vol ON us.key = vol.key")
def _(v: Views) -> DataFrame:
    return network.unique_stops(v.stops_seq, v.routes).select("key").join(_volumes(v).select("key", "volume"), "key", "left").fillna(0.0, ["volume"])


@REGISTER("snk11_stop_volumes_sheet", f"WITH {_VOL} SELECT row_number() OVER (ORDER BY volume DESC, key) AS place, key, volume FROM vol")
def _(v: Views) -> DataFrame:
    return numbered(_volumes(v).select("key", "volume"), "place", F.desc("volume"), F.col("key"))


_CORR = f"""seg AS (SELECT * FROM (SELECT route_id, di, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1, lat AS lat2, lon AS lon2 FROM v_points WINDOW w AS (PARTITION BY route_id, di ORDER BY seq)) WHERE lat1 IS NOT NULL),
pr AS (SELECT *, cos(radians((lat1+lat2)/2)) AS k FROM seg JOIN v_pixels p ON p.lat BETWEEN least(lat1, lat2) - 0.004 AND greatest(lat1, lat2) + 0.004 AND p.lon BETWEEN least(lon1, lon2) - 0.008 AND greatest(lon1, lon2) + 0.008),
d AS (SELECT *, (lon2-lon1)*k AS bx, lat2-lat1 AS bw, (lon-lon1)*k AS px, lat-lat1 AS py FROM pr),
t AS (SELECT *, CASE WHEN bx*bx+bw*bw > 0 THEN greatest(0.0, least(1.0, (px*bx+py*bw)/(bx*bx+bw*bw))) ELSE 0.0 END AS t FROM d),
hit AS (SELECT DISTINCT route_id, di, tile_id, row_no, col_no, {_VAL} AS value FROM t WHERE 111.0*sqrt(pow(px-t*bx, 2)+pow(py-t*bw, 2)) <= 0.4),
cs AS (SELECT route_id, di, sum(value) AS volume, count(*) AS pixels, count(DISTINCT tile_id) AS tiles FROM hit GROUP BY ALL)"""


@REGISTER("r1_corridor_sums", f"WITH {_CORR} SELECT * FROM cs")
def _(v: Views) -> DataFrame:
    return raster.corridor_sums(v.points, v.pixels, 400.0)


@REGISTER("j11_corridor_pixels", f"WITH {_CORR} SELECT route_id, di, pixels FROM cs")
def _(v: Views) -> DataFrame:
    return raster.corridor_sums(v.points, v.pixels, 400.0).select("route_id", "di", "pixels")


@REGISTER(
    "r1_corridor_areas",
    """WITH x AS (SELECT route_id, di, (max(lon) - min(lon)) * 69000 AS metres FROM v_points GROUP BY ALL)
SELECT route_id, di, CAST(round((800 * metres + pi() * 160000) / 1000) AS BIGINT) AS thousand_m2 FROM x WHERE metres > 0""",
)
def _(v: Views) -> DataFrame:
    node = (F.col("route_id") * (1 << 16) + F.col("di")).alias("node")
    flat = v.points.select(node, F.lit(0).alias("line"), "seq", (F.col("lon") * 69000).alias("x"), (F.col("lat") * 111000).alias("y"))
    areas = corridor.corridor_areas(overlap.node_segments(flat), 400.0)
    return areas.select(F.expr(f"node div {1 << 16}").alias("route_id"), F.expr(f"int(node % {1 << 16})").alias("di"), F.round(F.col("corridor_m2") / 1000).cast("bigint").alias("thousand_m2"))


@REGISTER(
    "r1_crossing_areas",
    """WITH h AS (SELECT l_orderkey AS node, 1000.0 + 10 * (l_orderkey % 200) AS half FROM lineitem GROUP BY ALL)
SELECT node, CAST(round((2 * (400 * half + pi() * 10000) - 40000) / 1000) AS BIGINT) AS thousand_m2 FROM h""",
)
def _(v: Views) -> DataFrame:
    """Crosses whose one arm is passed three times, in part and both ways."""
    half = 1000.0 + 10 * (F.col("l_orderkey") % 200)
    stops = [(-half, 0 * half), (half, 0 * half), (half / 2, 0 * half), (0 * half, 0 * half), (0 * half, half), (0 * half, -half)]
    way = F.array(*[F.struct(F.lit(i).cast("bigint").alias("seq"), x.alias("x"), (y + 5_700_000.0).alias("y")) for i, (x, y) in enumerate(stops)])
    points = v.lineitem.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("node"), F.lit(0).alias("line"), F.inline(way))
    areas = corridor.corridor_areas(overlap.node_segments(points), 100.0)
    return areas.select("node", F.round(F.col("corridor_m2") / 1000).cast("bigint").alias("thousand_m2"))


@REGISTER(
    "r5_pyramid",
    f"""WITH e AS (SELECT min(row_no) AS r0, max(row_no) AS r1, min(col_no) AS c0, max(col_no) AS c1 FROM v_pixels),
b AS (SELECT DISTINCT s_suppkey AS box, greatest(r0, s_suppkey % 40 - 9) AS row_lo, least(r1, s_suppkey % 40 + s_suppkey * 7 % 61) AS row_hi,
 greatest(c0, s_suppkey % 23 - 5) AS col_lo, least(c1, s_suppkey % 23 + s_suppkey * 5 % 53) AS col_hi FROM supplier, e),
k AS (SELECT b.*, (SELECT min(n) FROM range(0, 20) AS g(n) WHERE ceil((row_hi - row_lo + 1) / pow(2, n)) * ceil((col_hi - col_lo + 1) / pow(2, n)) <= 200) AS level FROM b WHERE row_lo <= row_hi AND col_lo <= col_hi),
w AS (SELECT *, CAST(pow(2, level) AS BIGINT) AS scale FROM k)
SELECT box, CAST(level AS INTEGER) AS level, scale, (p.row_no - row_lo) // scale AS row_no, (p.col_no - col_lo) // scale AS col_no, sum({_VAL}) AS raw_value
FROM w JOIN v_pixels p ON p.row_no BETWEEN row_lo AND row_hi AND p.col_no BETWEEN col_lo AND col_hi GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    key = F.col("s_suppkey")
    boxes = v.supplier.select(key.alias("box"), (key % 40 - 9).alias("row_lo"), (key % 40 + key * 7 % 61).alias("row_hi"), (key % 23 - 5).alias("col_lo"), (key % 23 + key * 5 % 53).alias("col_hi")).distinct()
    return raster.pyramid(v.pixels, boxes, "box", 200)


@REGISTER("ag11_route_corridors", f"WITH {_CORR} SELECT route_id, sum(volume) AS volume, CAST(sum(pixels) AS BIGINT) AS pixels, CAST(sum(tiles) AS BIGINT) AS tiles FROM cs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return raster.route_totals(raster.corridor_sums(v.points, v.pixels, 400.0))


_TOP = f"""ins AS (SELECT * FROM vol WHERE lat BETWEEN {BBOX[0]} AND {BBOX[2]} AND lon BETWEEN {BBOX[1]} AND {BBOX[3]}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY volume DESC, key) AS n, count(*) OVER () AS total FROM ins) WHERE n <= greatest(1, ceil(total * 35.0 / 100)))"""


_STEPS = (0.5 / 111.0, 0.5 / 111.0 / math.cos(math.radians((BBOX[0] + BBOX[2]) / 2)))


def _heat_sql() -> str:
    dlat, dlon = _STEPS
    return f"{_VOL}, {_TOP}, cell AS (SELECT CAST(trunc((lat - {BBOX[0]!r}::DOUBLE) / {dlat!r}::DOUBLE) AS BIGINT) AS i, CAST(trunc((lon - {BBOX[1]!r}::DOUBLE) / {dlon!r}::DOUBLE) AS BIGINT) AS j, sum(volume) AS value FROM top WHERE volume > 0 GROUP BY ALL)"


def _cells(v: Views) -> DataFrame:
    return raster.heat_cells(_volumes(v).withColumnRenamed("volume", "weight"), BBOX, 0.5)


@REGISTER("w7_top_stops", f"WITH {_VOL}, {_TOP} SELECT key, volume FROM top")
def _(v: Views) -> DataFrame:
    south, west, north, east = BBOX
    inside = _volumes(v).where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return raster.top_share(inside, "volume", "key", 35.0).select("key", "volume")


@REGISTER("ag20_heat_cells", f"WITH {_heat_sql()} SELECT i, j, value FROM cell")
def _(v: Views) -> DataFrame:
    return _cells(v)


@REGISTER("h2_smoothed_cells", f"WITH {_heat_sql()}, st(a, b, s) AS (VALUES (0, 0, 0.5::DOUBLE), (1, 0, 0.125::DOUBLE), (-1, 0, 0.125::DOUBLE), (0, 1, 0.125::DOUBLE), (0, -1, 0.125::DOUBLE)) SELECT c.i, c.j, round(sum(o.value * s), 6) AS value FROM cell c JOIN st ON true JOIN cell o ON o.i = c.i - a AND o.j = c.j - b GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return raster.smoothed(_cells(v)).withColumn("value", F.round("value", 6))


@REGISTER("h1_heat_map", f"WITH {_heat_sql()} SELECT i, j, value, round(value / max(value) OVER (), 6) AS t, CAST(round_even(pow(value / max(value) OVER (), 0.6) * 31, 0) AS BIGINT) AS level FROM cell")
def _(v: Views) -> DataFrame:
    return raster.heat_levels(_cells(v)).select("i", "j", "value", F.round("t", 6).alias("t"), "level")


@REGISTER("w8_relative_volumes", f"WITH {_VOL} SELECT key, round(volume / max(volume) OVER (), 6) AS share FROM vol")
def _(v: Views) -> DataFrame:
    volumes = _volumes(v)
    return volumes.select("key", F.round(F.col("volume") / volumes.agg(F.max("volume")).scalar(), 6).alias("share"))


@REGISTER("snk13_heat_sheet", f"WITH {_heat_sql()} SELECT i, j, round(100 * value / max(value) OVER (), 2) AS percent FROM cell")
def _(v: Views) -> DataFrame:
    cells = _cells(v)
    return cells.select("i", "j", F.round(100 * F.col("value") / cells.agg(F.max("value")).scalar(), 2).alias("percent"))


@REGISTER("snk17_heat_colors")
def _(v: Views) -> DataFrame:
    return raster.heat_levels(_cells(v)).select("i", "j", "level", heat_color(F.col("level") / 31).alias("color"))


@REGISTER(
    "snk17_heat_placemarks",
    f"""WITH {_heat_sql()}, m AS (SELECT i, j, pow(value / max(value) OVER (), 0.6) AS t FROM cell)
SELECT i, j, 'heat' || CAST(round_even(t * 31, 0) AS BIGINT) AS style, 1 AS extrude, 'relativeToGround' AS altitude_mode, round(400 * t, 6) AS altitude,
printf('%.7f,%.7f', {BBOX[1]!r}::DOUBLE + (j + 1) * {_STEPS[1]!r}::DOUBLE, {BBOX[0]!r}::DOUBLE + i * {_STEPS[0]!r}::DOUBLE) AS second_corner FROM m""",
)
def _(v: Views) -> DataFrame:
    marks = raster.heat_placemarks(raster.heat_levels(_cells(v)), BBOX[0], BBOX[1], *_STEPS)
    second = F.regexp_extract("coordinates", r"^\S+ ([^ ]+),[^, ]+ ", 1)
    return marks.select("i", "j", "style", "extrude", "altitude_mode", F.round("altitude", 6).alias("altitude"), second.alias("second_corner"))


@REGISTER("r2_mosaic_sums")
def _(v: Views) -> DataFrame:
    """Two tiles of the city's pixels in UTM and two in the Mollweide projection, a fifth one without a place."""
    corner = "CASE WHEN tile_id < 2 THEN {} ELSE {} END"
    tiles = v.pixels.selectExpr(
        "tile_id", "CASE WHEN tile_id < 2 THEN 32637 WHEN tile_id < 4 THEN 54009 END AS epsg", f"double({corner.format(505000, 3320000)} + tile_id * 50) AS x0",
        f"double({corner.format(5720000, 5990000)}) AS y0", "100.0D AS dx", "-100.0D AS dy", "64 AS rows", "64 AS cols",
    ).distinct()
    nowhere = tiles.limit(1).selectExpr("99L AS tile_id", "32637 AS epsg", "0.0D AS x0", "0.0D AS y0", "1.0D AS dx", "1.0D AS dy", "64 AS rows", "64 AS cols")
    sums = mosaic.mosaic_sums(v.points, v.pixels, tiles.unionByName(nowhere), 400.0)
    return sums.withColumn("corridor_m2", F.round("corridor_m2", 1))

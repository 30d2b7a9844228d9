"""Queries of catalog pages, payloads, exports and generated routes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import generate, geometry, network, raster
from ..sources import catalog, files, payloads
from ..tables import written
from .network_queries import _LABEL, _STATE, _STOPS, _TERM
from .register import Register
from .surrogate import Views

REGISTER = Register()
_LI = "unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>', 1))"


@REGISTER("src3_catalog_links", f"SELECT page_id, href, count(*) AS times FROM (SELECT page_id, {_LI} AS href FROM pages) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return catalog.sections(catalog.page_entries(v.pages)).groupBy("page_id", "href").agg(F.count("*").alias("times"))


@REGISTER("src4_headings", "SELECT page_id, count(*) AS headings FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1\\b[^>]*>.*?</h1\\s*>')) AS h FROM pages) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return catalog.page_entries(v.pages).where("heading IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("headings"))


@REGISTER("src2_pages", "SELECT page_id, length(html) AS characters, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host FROM pages")
def _(v: Views) -> DataFrame:
    return v.pages.select("page_id", F.length("html").cast("bigint").alias("characters"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"))


@REGISTER("j16_links_under_headings")
def _(v: Views) -> DataFrame:
    return catalog.sections(catalog.page_entries(v.pages)).groupBy("section", "route_type").agg(F.count("*").alias("links"))


# a header in a box of its own, two headers before one block, a header whose block is in another box, one without a name, one of no transport type
_SECTIONS = """concat('<body><div class="top"><div class="x typeHeader"><span class=typeHeader-name> Автобусы </span></div><div>ad <a href="/no">no</a></div><div class="wikiCatalogFilterListItem a"><ul><li><a href="/c/', page_id,
'">', page_id, ' &amp; co</a></li><li><a class=z>none</a></li></ul><div><a href="/c/', page_id + 1, '"><b>b</b></a></div></div><a href="/after">after</a><div class="wikiCatalogFilterListItem"><a href=''/second''>s</a></div></div>',
'<div><div class="typeHeader"><span class="typeHeader-name">Трамваи</span></div><div class="typeHeader"><span class="typeHeader-name">Троллейбусы</span></div><div class=''wikiCatalogFilterListItem''><a href=/t/', page_id, '>t</a></div></div>',
'<div><div class="typeHeader"><span class="typeHeader-name">Метро</span></div></div><div class="wikiCatalogFilterListItem"><a href="/m">m</a></div>',
'<div class="typeHeader">bare</div><div class="typeHeader"><span class="typeHeader-name">Прочее</span></div><div class="wikiCatalogFilterListItem"><a href="/p">p</a></div></body>')"""


@REGISTER(
    "j16_section_links",
    """SELECT page_id, 'Автобусы' AS section, '/c/' || (page_id + k) AS href, CASE k WHEN 0 THEN page_id || ' & co' ELSE 'b' END AS title FROM pages, (VALUES (0), (1)) AS v(k)
UNION ALL SELECT page_id, s, '/t/' || page_id, 't' FROM pages, (VALUES ('Трамваи'), ('Троллейбусы')) AS w(s)""",
)
def _(v: Views) -> DataFrame:
    return catalog.section_links(v.pages.select("page_id", F.expr(_SECTIONS).alias("html"))).select("page_id", "section", "href", "title")


_HOST = "regexp_extract(url, '^[a-z]+://([^/]*)', 1)"
_CITY = "nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '')"


@REGISTER("ag15_dominant_city", f"WITH c AS (SELECT {_HOST} AS host, {_CITY} AS city, count(*) AS n FROM pages GROUP BY ALL) SELECT host, min_by(city, (-n, city)) AS city FROM c WHERE city IS NOT NULL GROUP BY ALL")
def _(v: Views) -> DataFrame:
    links = v.pages.select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), text.city_from_url(F.col("url")).alias("city"))
    return catalog.dominant_city(links, "host", "city")


@REGISTER(
    "f17_sections_of_city",
    f"WITH c AS (SELECT {_HOST} AS host, {_CITY} AS city, count(*) AS n FROM pages GROUP BY ALL), d AS (SELECT host, min_by(city, (-n, city)) AS city FROM c WHERE city IS NOT NULL GROUP BY ALL) SELECT page_id FROM pages JOIN d ON {_HOST} = host AND {_CITY} = city",
)
def _(v: Views) -> DataFrame:
    links = v.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), text.city_from_url(F.col("url")).alias("city"))
    return links.join(catalog.dominant_city(links, "host", "city"), ["host", "city"], "left_semi").select("page_id")


@REGISTER("f13_title_terms", "SELECT page_id FROM pages WHERE contains(lower(html), 'the') OR contains(lower(html), 'der')")
def _(v: Views) -> DataFrame:
    terms = F.filter(F.transform(F.split(F.lit("the, der"), ","), lambda t: F.trim(t)), lambda t: t != "")
    return v.pages.where(F.exists(terms, lambda t: F.contains(F.lower("html"), t))).select("page_id")


_SH = lambda n, s: f"round_even((CAST(embedding[{n}] AS DOUBLE) * 20 - ({s})[CAST((i - 1) % 8 AS INTEGER) + 1]) * 1e7, 0) / 1e7"


@REGISTER(
    "p3_unshifted_points",
    f"""WITH p AS (SELECT vec_id, i, embedding, unnest(range(1, len(embedding) // 2 + 1)) AS i2 FROM (SELECT vec_id, embedding, 0 AS i FROM embeddings)),
q AS (SELECT vec_id, {_SH('2 * i2 - 1', network.LAT_SHIFT).replace('(i - 1)', '(i2 - 1)')} AS lat, {_SH('2 * i2', network.LON_SHIFT).replace('(i - 1)', '(i2 - 1)')} AS lon FROM p)
SELECT vec_id, count(*) AS points, CAST(sum(CAST(round(lat * 1e7) AS BIGINT)) AS BIGINT) AS lats, CAST(sum(CAST(round(lon * 1e7) AS BIGINT)) AS BIGINT) AS lons FROM q WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    raw = v.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 20).alias("e"))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(e) div 2") - 1), lambda i: F.slice("e", 2 * i + 1, 2))
    points = raw.select("vec_id", F.explode(payloads.unshift_array(pairs)).alias("p"))
    return points.groupBy("vec_id").agg(F.count("*").alias("points"), *[F.sum(F.round(F.col("p." + c) * 1e7).cast("bigint")).alias(c + "s") for c in ("lat", "lon")])


@REGISTER("p16_lng_lat_pairs", "SELECT c_custkey, round(c_acctbal / 1000, 6) AS lat, round(-c_acctbal / 500, 6) AS lon FROM customer")
def _(v: Views) -> DataFrame:
    written = F.concat(F.lit("[["), (-F.col("c_acctbal") / 500).cast("decimal(20,9)").cast("string"), F.lit(" , "), (F.col("c_acctbal") / 1000).cast("decimal(20,9)").cast("string"), F.lit("],[999,1]]"))
    return v.customer.select("c_custkey", F.explode(payloads.lng_lat_pairs(written)).alias("p")).select("c_custkey", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


def _payloads(v: Views) -> DataFrame:
    """A payload a route, of its points: the second direction twice, its shift added as a server would."""
    shift = lambda c, s: F.col(c) + F.get(F.array(*[F.lit(x) for x in s]), (F.col("seq") % 8).cast("int"))
    at = F.array(shift("lat", network.LAT_SHIFT), shift("lon", network.LON_SHIFT))
    lines = v.points.groupBy("route_id", "di").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", at.alias("at")))), lambda x: x["at"]).alias("coords"))
    stop = F.struct(F.col("route_id").cast("string").alias("id"), F.concat(F.lit(" Stop "), "di").alias("name"), F.lit("51.6").alias("lat"), F.lit("39.1").alias("lon"))
    trips = lines.select("route_id", "di", F.explode(F.array_repeat(F.struct("coords", F.array(stop).alias("stops")), 2)).alias("trip"))
    return trips.groupBy("route_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("trip")).alias("trips"))).alias("payload"))


@REGISTER("p6_parsed_payloads", "SELECT route_id, count(DISTINCT di) AS directions, count(*) AS points FROM v_points GROUP BY ALL")
def _(v: Views) -> DataFrame:
    parsed = payloads.parse_payloads(_payloads(v))
    return parsed.groupBy("route_id").agg(F.count("*").alias("directions"), F.sum(F.size("coords")).alias("points"))


@REGISTER("p4_stops_of_payloads", "SELECT DISTINCT route_id, route_id AS stop_id, 'Stop ' || di AS name, CAST(51.6 AS DOUBLE) AS lat FROM v_points")
def _(v: Views) -> DataFrame:
    parsed = payloads.parse_payloads(_payloads(v)).select("route_id", F.explode("stops").alias("s"))
    return parsed.select("route_id", F.col("s.id").alias("stop_id"), "s.name", "s.lat")


@REGISTER("src7_decoded_payloads", "SELECT c_custkey, c_name AS name FROM customer")
def _(v: Views) -> DataFrame:
    coded = v.customer.select("c_custkey", payloads.decode_payload(F.to_json(F.struct(F.col("c_name").alias("name")))).alias("coded"))
    return coded.select("c_custkey", F.get_json_object(payloads.decode_payload(F.col("coded")), "$.name").alias("name"))


@REGISTER("p9_transport_classes", "SELECT c_custkey, c_mktsegment AS class FROM customer")
def _(v: Views) -> DataFrame:
    inner = F.struct(F.struct(F.col("c_mktsegment").alias("name")).alias("transportClass"))
    return v.customer.select("c_custkey", payloads.transport_class(F.to_json(F.struct(F.array(inner).alias("a")))).alias("class"))


@REGISTER("src11_idea_lines", "SELECT route_id AS idea_id, count(*) AS points FROM v_points WHERE di = 0 GROUP BY ALL")
def _(v: Views) -> DataFrame:
    line = v.points.where("di = 0").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("l"))
    text_of = lambda p: F.concat(F.lit("["), p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))
    body = F.array_join(F.transform("l", text_of), ",")
    first = text_of(F.get("l", F.lit(0)))
    html = F.concat(F.lit('x "coordinates": [[1,2]] y "coordinates":['), first, F.lit(","), body, F.lit(","), first, F.lit("] z"))
    return payloads.idea_line(line.select(F.col("route_id").alias("idea_id"), html.alias("html"))).select("idea_id", F.size("line").cast("bigint").alias("points"))


@REGISTER("snk16_kml_placemarks")
def _(v: Views) -> DataFrame:
    return files.placemarks(v.points, v.routes, geometry.direction_km(v.points).select("route_id", "di", F.round("km", 2).alias("km")))


@REGISTER("snk5_route_sheet", "SELECT route_type, name, p.route_id, p.di + 1 AS direction, count(*) AS points, max(volume) AS volume FROM v_points p JOIN v_routes USING (route_id) LEFT JOIN v_ghs ON node = p.route_id * 2 + p.di GROUP BY ALL")
def _(v: Views) -> DataFrame:
    rows = v.points.groupBy("route_id", "di").agg(F.count("*").alias("points")).withColumn("node", F.col("route_id") * 2 + F.col("di"))
    sheet = rows.join(v.routes, "route_id").join(v.ghs.select("node", "volume"), "node", "left")
    return sheet.select("route_type", "name", "route_id", (F.col("di") + 1).alias("direction"), "points", "volume")


@REGISTER("snk3_summary", "SELECT 'routes' AS measure, CAST(count(*) AS DOUBLE) AS value FROM v_routes UNION ALL SELECT 'active', CAST(count_if(active) AS DOUBLE) FROM v_routes UNION ALL SELECT 'errors', CAST(count(error) AS DOUBLE) FROM v_routes UNION ALL SELECT 'directions', CAST(count(DISTINCT (route_id, di)) AS DOUBLE) FROM v_points UNION ALL SELECT 'stops', CAST(count(*) AS DOUBLE) FROM v_stops_seq")
def _(v: Views) -> DataFrame:
    routes = v.routes.agg(F.count("*").alias("routes"), F.count_if("active").alias("active"), F.count("error").alias("errors"))
    routes = routes.unpivot([], ["routes", "active", "errors"], "measure", "value")
    directions = v.points.select("route_id", "di").distinct().agg(F.lit("directions").alias("measure"), F.count("*").alias("value"))
    stops = v.stops_seq.agg(F.lit("stops").alias("measure"), F.count("*").alias("value"))
    return routes.unionByName(directions).unionByName(stops).select("measure", F.col("value").cast("double").alias("value"))


_LEFT = "ok AS (SELECT * FROM st WHERE active AND state = 'ok'), vs AS (SELECT * FROM v_stops_seq WHERE route_id IN (SELECT route_id FROM ok))"


@REGISTER(
    "snk3_network_summary",
    f"""WITH {_STATE}, {_LEFT}, {_STOPS.replace("v_stops_seq", "vs")}, {_TERM.replace("v_stops_seq", "vs")},
whole AS (SELECT route_id FROM v_points GROUP BY ALL HAVING bool_and(lat BETWEEN 51.6 AND 51.63 AND lon BETWEEN 39.1 AND 39.13)),
t(measure, kind) AS (VALUES ('Поездов', 'train'), ('Троллейбусов', 'trolleybus'), ('Трамваев', 'tram'), ('Автобусов', 'bus'), ('Маршруток', 'minibus'), ('Водных маршрутов', 'water'))
SELECT 'Маршрутов в обработке' AS measure, CAST(count(*) AS DOUBLE) AS value FROM st WHERE active UNION ALL SELECT 'Успешно (в отчёте)', count(*) FROM ok
UNION ALL SELECT 'Ошибок', count(*) FROM st WHERE active AND state = 'bad' UNION ALL SELECT 'Пропущено неактивных (--active-only)', count_if(NOT active) FROM v_routes
UNION ALL SELECT 'Отсечено: длина', 0 UNION ALL SELECT 'Маршрутов на карте (KML)', count(*) FROM ok
UNION ALL SELECT 'Остановок уникальных', count(*) FROM us UNION ALL SELECT 'Конечных', count(DISTINCT key) FROM x WHERE key <> ''
UNION ALL SELECT measure, count(ok.route_id) FROM t LEFT JOIN ok ON route_type = kind AND (kind <> 'train' OR ok.route_id IN (SELECT route_id FROM whole)) GROUP BY measure""",
)
def _(v: Views) -> DataFrame:
    from ..config import Limits, RunConfig
    from .network import Network

    run = Network(RunConfig("city", limits=Limits()), v.routes, v.points, v.stops_seq, v.pois, v.pixels)
    shown = ["Маршрутов в обработке", "Успешно (в отчёте)", "Ошибок", "Пропущено неактивных (--active-only)", "Отсечено: длина", "Маршрутов на карте (KML)", "Остановок уникальных", "Конечных", *network.TYPE_TITLES]
    out = written(run.summary((51.6, 39.1, 51.63, 39.13)).where(F.col("measure").isin(shown)).select("measure", "value"), "summary")
    run.close()
    return out


@REGISTER(
    "snk19_error_block",
    f"""WITH {_STATE}, b AS (SELECT route_id, '    ' || {_LABEL} || ' ' || name || ': ' || error AS line FROM st WHERE state = 'bad')
SELECT '⚠ Ошибки (' || count(*) || '):' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY route_id) FROM (SELECT * FROM b ORDER BY route_id LIMIT 5)) AS text FROM b HAVING count(*) > 0
UNION ALL SELECT '' FROM b HAVING count(*) = 0""",
)
def _(v: Views) -> DataFrame:
    return files.error_block(network.route_state(v.routes, v.points))


def _terminals(v: Views, pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stops and the terminals. The rows of stops, the stops and both results are written, as each is read several times."""
    rows = written(v.stops_seq.select("route_id", "di", "seq", "stop_id", "stop_name", "lat", "lon"), "stop-rows")
    stops = written(network.unique_stops(rows, v.routes).where("lat IS NOT NULL AND lon IS NOT NULL").select("key", "lat", "lon"), "stops")
    volumes = raster.shared_window_sums(pixels, raster.point_squares(stops, "key", 2), "key")
    flat = written(geometry.local_xy(stops, 51.6, 39.1).join(volumes, "key").select("key", "x", "y", "lat", "lon", "volume"), "stop-volumes")
    # the stops of the streets stand at their routes' terminals
    stop = F.struct("stop_id", "stop_name")
    ends = rows.groupBy("route_id", "di").agg(F.min_by(stop, "seq").alias("a"), F.max_by(stop, "seq").alias("b"))
    ends = ends.select("route_id", "di", F.explode(F.array("a", "b")).alias("stop")).where("stop IS NOT NULL").withColumn("key", network.stop_key(F.col("stop.stop_id"), F.col("stop.stop_name")))
    ends = ends.select("route_id", "di", "key").join(flat.select("key", "x", "y", "lat", "lon"), "key")
    return flat, written(generate.terminals(ends, flat), "terminals")


@REGISTER("gen1_terminals")
def _(v: Views) -> DataFrame:
    return _terminals(v, v.pixels)[1].select("key", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "volume", F.col("rank").cast("bigint").alias("rank"))


@REGISTER("gen5_generated_routes")
def _(v: Views) -> DataFrame:
    pixels = written(v.pixels, "pixels")
    stops, found = _terminals(v, pixels)
    # the pixels' centres lie a thousandth of a degree apart, the first at 51.66, 39.10
    high, wide = geo.METRES_PER_DEGREE * 0.001, geo.METRES_PER_DEGREE * 0.001 * math.cos(math.radians(51.6))
    grid = generate.Grid(west=-0.5 * wide, north=60.5 * high, width=wide, height=high)
    out = generate.generate_routes(stops, found, pixels, grid, 5)
    return out.select("n", "origin", "destination", "stops", F.round("length_km", 3).alias("length_km"), F.round("ratio", 3).alias("ratio"), "volume", "status")


@REGISTER("g13_passes")
def _(v: Views) -> DataFrame:
    from ..config import Limits, RunConfig
    from .network import Network

    run = Network(RunConfig("city", dedup=True, dedup_passes=3, limits=Limits(curvilinearity=2.0)), v.routes, v.points, v.stops_seq, v.pois, v.pixels)
    out = written(run.removed.select("step", "pass", "node", "partners", "representative", "volume"), "passes")
    run.close()
    return out


@REGISTER("x1_network_report")
def _(v: Views) -> DataFrame:
    from ..config import Limits, RunConfig
    from .network import Network

    run = Network(RunConfig("city", dedup=True, limits=Limits(curvilinearity=2.0)), v.routes, v.points, v.stops_seq, v.pois, v.pixels)
    out = written(run.summary((51.6, 39.1, 51.8, 39.3)).select("measure", "value").unionByName(run.sizes()), "report")
    run.close()
    return out

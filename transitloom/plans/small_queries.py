"""Queries of the small operators: orders, keys, maps, tags, signatures, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, sql, text
from ..operators import generate, geometry, nearby, overlap, raster
from ..sources import files, ideas, payloads
from ..tables import numbered
from .overlap_queries import _G, _removed
from .raster_queries import _VAL
from .register import Register
from .surrogate import Views

REGISTER = Register()


@REGISTER(
    "w3_exact_repeats",
    "WITH p AS (SELECT route_id, di, seq, floor(lat * 10) AS lat, floor(lon * 5) AS lon FROM v_zigzag) SELECT route_id, di, seq FROM (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM p WINDOW w AS (PARTITION BY route_id, di ORDER BY seq)) WHERE lat IS DISTINCT FROM a OR lon IS DISTINCT FROM b",
)
def _(v: Views) -> DataFrame:
    coarse = v.zigzag.withColumns({"lat": F.floor(F.col("lat") * 10), "lon": F.floor(F.col("lon") * 5)})
    return geometry.without_exact_repeats(coarse).select("route_id", "di", "seq")


@REGISTER("w5_removal_steps", f"WITH {_G} SELECT row_number() OVER (ORDER BY volume, node) AS step, node FROM vic")
def _(v: Views) -> DataFrame:
    return _removed(v).select("step", "node")


@REGISTER("snk7_removal_sheet", f"WITH {_G} SELECT row_number() OVER (ORDER BY volume, node) AS step, node, representative, partners, closed, round(volume, 2) AS volume FROM vic")
def _(v: Views) -> DataFrame:
    return _removed(v).select("step", "node", "representative", "partners", "closed", F.round("volume", 2).alias("volume"))


@REGISTER("o3_metric_order", "SELECT node, row_number() OVER (ORDER BY volume DESC, node) AS place FROM v_ghs")
def _(v: Views) -> DataFrame:
    return numbered(v.ghs.select("node", "volume"), "place", F.desc("volume"), F.col("node")).select("node", "place")


@REGISTER("o4_top_percent", "SELECT node FROM (SELECT node, row_number() OVER (ORDER BY volume DESC, node) AS n, count(*) OVER () AS total FROM v_ghs) WHERE n <= greatest(1, ceil(total * 10.0 / 100))")
def _(v: Views) -> DataFrame:
    return raster.top_share(v.ghs.select("node", "volume"), "volume", "node", 10.0).select("node")


@REGISTER("o5_first_errors", "SELECT route_id, error FROM v_routes WHERE error IS NOT NULL ORDER BY route_id LIMIT 5")
def _(v: Views) -> DataFrame:
    return v.routes.where("error IS NOT NULL").orderBy("route_id").limit(5).select("route_id", "error")


@REGISTER("a1_array_functions", "SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive FROM embeddings")
def _(v: Views) -> DataFrame:
    return v.embeddings.select("vec_id", F.get("embedding", F.lit(0)).alias("first"), F.element_at("embedding", -1).alias("last"), F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("positive"))


@REGISTER("k1_counts_by_key", "SELECT route_id, count(*) FILTER (weekday) AS weekday, count(*) FILTER (NOT weekday) AS other FROM v_departures GROUP BY ALL")
def _(v: Views) -> DataFrame:
    counts = v.departures.groupBy("route_id", "weekday").agg(F.count("*").alias("n"))
    maps = counts.groupBy("route_id").agg(F.map_from_entries(F.collect_list(F.struct("weekday", "n"))).alias("m"))
    of = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("bigint")
    return maps.select("route_id", of(True).alias("weekday"), of(False).alias("other"))


@REGISTER("s7_unit_names", "SELECT route_id, r_regionkey AS di, concat(name, ' (', CASE r_regionkey WHEN 0 THEN 'туда' WHEN 1 THEN 'обратно' ELSE 'направление ' || (r_regionkey + 1) END, ')') AS unit FROM v_routes JOIN supplier ON s_suppkey = route_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(v: Views) -> DataFrame:
    rows = v.routes.join(v.supplier.selectExpr("s_suppkey AS route_id", "s_nationkey AS n_nationkey"), "route_id").join(v.nation, "n_nationkey")
    return rows.select("route_id", F.col("n_regionkey").alias("di"), text.unit_name(F.col("name"), F.col("n_regionkey")).alias("unit"))


@REGISTER("s8_stable_keys", "SELECT DISTINCT CAST(route_id AS VARCHAR) || ':' || CAST(di AS VARCHAR) AS key FROM v_zigzag")
def _(v: Views) -> DataFrame:
    return v.zigzag.select(F.concat_ws(":", "route_id", "di").alias("key")).distinct()


@REGISTER("s10_source_signatures", "SELECT page_id, left(md5(url || ';tile.tif|' || CAST(length(html) AS VARCHAR)), 12) AS signature FROM pages")
def _(v: Views) -> DataFrame:
    return v.pages.select("page_id", files.source_signature(F.array("url", F.lit("tile.tif")), F.length("html")).alias("signature"))


@REGISTER("s12_heat_levels", "SELECT p_partkey, CAST(round_even(pow(p_size / 50.0, 0.6) * 31, 0) AS BIGINT) AS level FROM part")
def _(v: Views) -> DataFrame:
    return v.part.select("p_partkey", F.rint(F.pow(F.col("p_size") / 50, F.lit(0.6)) * 31).cast("bigint").alias("level"))


@REGISTER("f15_poi_tags", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Школа' WHEN 'HOUSEHOLD' THEN 'Детский сад' END AS kind FROM customer")
def _(v: Views) -> DataFrame:
    amenity = F.when(F.col("c_mktsegment") == "BUILDING", "school").when(F.col("c_mktsegment") == "HOUSEHOLD", "kindergarten").otherwise("other")
    return v.customer.select("c_custkey", nearby.poi_kind(F.create_map(F.lit("amenity"), amenity)).alias("kind"))


@REGISTER("f18_stop_coordinates", "SELECT route_id, di, seq, lat IS NOT NULL AND lon IS NOT NULL AND lat BETWEEN 51.6 AND 90 AND lon BETWEEN -180 AND 180 AS placed FROM v_stops_seq")
def _(v: Views) -> DataFrame:
    return v.stops_seq.select("route_id", "di", "seq", (geo.valid_point(F.col("lat"), F.col("lon")) & F.coalesce(F.col("lat") >= 51.6, F.lit(False))).alias("placed"))


@REGISTER("m6_point_validity", "SELECT c_custkey, c_acctbal / 50 BETWEEN -90 AND 90 AND c_acctbal / 25 BETWEEN -180 AND 180 AS valid FROM customer")
def _(v: Views) -> DataFrame:
    return v.customer.select("c_custkey", geo.valid_point(F.col("c_acctbal") / 50, F.col("c_acctbal") / 25).alias("valid"))


@REGISTER(
    "p12_metadata_fallback",
    "SELECT doc_id, coalesce(CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang || ' a' ELSE '' END, '') AS transport_class, doc_id % 3 = 1 AS is_electrobus FROM documents",
)
def _(v: Views) -> DataFrame:
    payload = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("source").alias("transportClass")))).otherwise("{}")
    label = F.when(F.col("doc_id") % 3 == 1, F.concat(F.col("lang"), F.lit("</em><p> a</p>"))).otherwise("-</em>")
    note = F.when(F.col("doc_id") % 3 == 1, "Электробус").otherwise("")
    page = F.concat(F.lit("<html><body><section><div><p><b>Классы&nbsp;транспорта:</b> <em>"), label, F.lit("</p></div></section><footer>"), note, F.lit("</footer></body></html>"))
    found = v.documents.select("doc_id", payloads.metadata(payload, page).alias("m"))
    return found.select("doc_id", "m.*")


@REGISTER("p24_task_addresses", "SELECT route_id, '/' || route_type || '?routes=' || CAST(route_id AS VARCHAR) AS url FROM v_routes")
def _(v: Views) -> DataFrame:
    return v.routes.select("route_id", text.task_url(F.col("route_type"), F.col("route_id")).alias("url"))


@REGISTER("j12_tile_bounds", "SELECT tile_id, min(row_no) AS row_lo, max(row_no) AS row_hi, min(col_no) AS col_lo, max(col_no) AS col_hi FROM v_pixels GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return raster.tile_bounds(v.pixels)


@REGISTER("j13_first_tiles", "WITH t AS (SELECT tile_id, min(row_no) AS r0, max(row_no) AS r1, min(col_no) AS c0, max(col_no) AS c1 FROM v_pixels GROUP BY ALL) SELECT s_suppkey, min(tile_id) AS tile_id FROM supplier JOIN t ON s_suppkey % 70 BETWEEN r0 AND r1 AND s_suppkey * 3 % 70 BETWEEN c0 AND c1 GROUP BY ALL")
def _(v: Views) -> DataFrame:
    points = v.supplier.selectExpr("s_suppkey", "s_suppkey % 70 AS row_no", "s_suppkey * 3 % 70 AS col_no")
    return raster.first_tile(points, raster.tile_bounds(v.pixels), "s_suppkey")


@REGISTER("r4_surface_layer", "SELECT tile_id, sum(CASE WHEN raw_value <> 4294967295 AND raw_value >= 0 AND raw_value <= 1e12 THEN raw_value ELSE 0.0 END) AS surface FROM v_pixels GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return v.pixels.groupBy("tile_id").agg(F.sum(raster.clean_value(F.col("raw_value"), greatest=1e12)).alias("surface"))


@REGISTER("r7_point_volumes", f"SELECT s_suppkey, coalesce(sum({_VAL}), 0.0) AS volume FROM supplier LEFT JOIN v_pixels ON row_no BETWEEN s_suppkey * 5 % 64 - 1 AND s_suppkey * 5 % 64 + 1 AND col_no BETWEEN s_suppkey * 11 % 64 - 1 AND s_suppkey * 11 % 64 + 1 GROUP BY ALL")
def _(v: Views) -> DataFrame:
    squares = v.supplier.selectExpr("s_suppkey", "s_suppkey * 5 % 64 - 1 AS row_lo", "s_suppkey * 5 % 64 + 1 AS row_hi", "s_suppkey * 11 % 64 - 1 AS col_lo", "s_suppkey * 11 % 64 + 1 AS col_hi")
    return raster.window_sums(v.pixels, squares, "s_suppkey")


_WAYS = "s_suppkey, CAST(s_suppkey * 5 % 64 AS DOUBLE) AS row1, CAST(s_suppkey * 11 % 64 AS DOUBLE) AS col1, CAST(s_suppkey * 13 % 64 AS DOUBLE) AS row2, CAST(s_suppkey * 17 % 64 AS DOUBLE) AS col2"


@REGISTER(
    "r8_corridor_volumes",
    f"""WITH w AS (SELECT {_WAYS} FROM supplier), n AS (SELECT *, greatest(1, CAST(floor(sqrt(pow(row2-row1, 2)+pow(col2-col1, 2)) / 4) AS INTEGER)) AS parts FROM w),
k AS (SELECT *, unnest(range(0, parts)) AS k FROM n),
s AS (SELECT s_suppkey, CAST(round_even(row1 + (row2 - row1) * ((k + 0.5::DOUBLE) / parts), 0) AS BIGINT) AS r, CAST(round_even(col1 + (col2 - col1) * ((k + 0.5::DOUBLE) / parts), 0) AS BIGINT) AS c FROM k)
SELECT s_suppkey, coalesce(sum({_VAL}), 0.0) AS volume FROM s LEFT JOIN v_pixels ON row_no BETWEEN r - 2 AND r + 2 AND col_no BETWEEN c - 2 AND c + 2 GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    return raster.corridor_volumes(v.supplier.selectExpr(*_WAYS.split(", ")), v.pixels, "s_suppkey", 4)


@REGISTER("g6_validated_edges", "SELECT count(*) AS edges FROM v_edges WHERE kmax > 0.9")
def _(v: Views) -> DataFrame:
    return overlap.clean_edges(v.edges, 0.9).agg(F.count("*").alias("edges"))


@REGISTER("gen2_origins", "WITH t AS (SELECT node, row_number() OVER (ORDER BY volume DESC, node) AS place FROM v_ghs WHERE node <= 40) SELECT n, node AS key FROM range(1, 61) AS r(n) JOIN t ON place = CASE WHEN n <= (SELECT count(*) FROM t) THEN n ELSE 1 END")
def _(v: Views) -> DataFrame:
    found = numbered(v.ghs.where("node <= 40").selectExpr("node AS key", "volume"), "rank", F.desc("volume"), F.col("key"))
    return generate.origins(found, 60).select("n", "key")


@REGISTER(
    "snk12_generated_sheet",
    "SELECT o_orderkey AS n, o_orderstatus AS origin, o_orderpriority AS destination, round(o_custkey / 7.0, 2) AS length_km, o_custkey AS stops, CASE WHEN o_custkey % 3 = 0 THEN '∞' ELSE printf('%.2f', o_custkey / 7.0) END AS ratio, round(o_totalprice / 1000, 1) AS volume, CASE WHEN o_custkey > 0 THEN round(o_totalprice / 1000 / (o_custkey / 7.0), 1) END AS volume_per_km, 's' AS status, 'c' AS chain FROM orders",
)
def _(v: Views) -> DataFrame:
    ratio = F.when(F.col("o_custkey") % 3 == 0, float("inf")).otherwise(F.col("o_custkey") / 7)
    routes = v.orders.select(
        F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("origin"), F.col("o_orderpriority").alias("destination"), (F.col("o_custkey") / 7).alias("length_km"),
        F.col("o_custkey").alias("stops"), ratio.alias("ratio"), F.col("o_totalprice").alias("volume"), F.lit("s").alias("status"), F.lit("c").alias("chain"),
    )
    return generate.sheet(routes)


@REGISTER("r5_downsampled", f"SELECT row_no // 4 AS row_no, col_no // 4 AS col_no, sum({_VAL}) AS raw_value FROM v_pixels WHERE lat BETWEEN 51.61 AND 51.65 AND lon BETWEEN 39.11 AND 39.15 GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return raster.downsampled(raster.clipped(v.pixels, (51.61, 39.11, 51.65, 39.15)), 4)


_IDEA_PAGE = """concat('<p>x</p><TABLE class="ideas"><tr><th>№</th></tr><tr><td>№ ', c_custkey % 60, '</td><td><a class=t href="/idea/', c_custkey, '">', c_name, ' &amp; <b>b</b></a></td><td>City</td><td>Author ', c_nationkey,
'</td><td>1.2.</td><td>', CASE c_custkey % 3 WHEN 0 THEN '—' WHEN 1 THEN '-1' ELSE concat('4,5 (', c_nationkey, ')') END, '</td></tr><tr><td>5</td><td>too short</td></tr><tr><td>none</td><td>a</td><td>b</td><td>c</td><td>d</td><td>e</td></tr></TABLE>')"""


@REGISTER(
    "src10_idea_list",
    """WITH i AS (SELECT c_custkey % 60 AS id, c_custkey % 2 AS query_no, c_custkey AS page, c_name || ' & b' AS title, 'https://ideas.example/idea/' || c_custkey AS url, 'Author ' || c_nationkey AS author,
CASE c_custkey % 3 WHEN 1 THEN -1.0 WHEN 2 THEN 4.5 END::DOUBLE AS rating, CASE WHEN c_custkey % 3 = 2 THEN c_nationkey END::BIGINT AS voters FROM customer WHERE c_custkey < 400)
SELECT id, arg_min(title, (query_no, page)) AS title, arg_min(url, (query_no, page)) AS url, 'City' AS city, arg_min(author, (query_no, page)) AS author, arg_min(coalesce(rating, 0), (query_no, page)) AS rating, arg_min(coalesce(voters, 0), (query_no, page)) AS voters FROM i GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    # behind three empty pages, from page 400 on, a list has ended
    html = F.when(F.col("c_custkey") < 400, F.expr(_IDEA_PAGE)).when(F.col("c_custkey") < 406, "<p>nothing</p>").otherwise(F.expr(_IDEA_PAGE))
    pages = v.customer.select((F.col("c_custkey") % 2).alias("query_no"), F.col("c_custkey").alias("page"), html.alias("html"))
    found = ideas.idea_list(pages, "https://ideas.example")
    return found.select("id", "title", "url", "city", "author", F.coalesce("rating", F.lit(0.0)).alias("rating"), F.coalesce("voters", F.lit(0)).alias("voters"))


@REGISTER(
    "src12_idea_routes",
    "SELECT doc_id AS route_id, lang AS name, CASE WHEN doc_id % 2 = 0 THEN 'tram' ELSE 'bus' END AS route_type, coalesce(source, '') AS company, CASE WHEN doc_id % 3 = 0 THEN '4.0(' || doc_id || ')' ELSE '()' END AS transport_class, CASE WHEN doc_id % 4 = 0 THEN 2 END AS points FROM documents",
)
def _(v: Views) -> DataFrame:
    listed = v.documents.select(
        F.struct("doc_id").alias("place"), F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.lit(None).cast("string").alias("url"), F.lit("c").alias("city"), F.col("source").alias("author"),
        F.when(F.col("doc_id") % 3 == 0, 4.0).alias("rating"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("voters"),
    )
    line = F.expr("CASE WHEN doc_id % 4 = 0 THEN array(struct(51.0D AS lat, 39.0D AS lon), struct(51.1D AS lat, 39.0D AS lon)) ELSE array() END")
    shapes = v.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("Новый ТРАМВАЙ").alias("h1"), line.alias("coords"), F.array(F.lit("s")).alias("stops"))
    return ideas.ideas_to_routes(listed, shapes).select("route_id", "name", "route_type", "company", "transport_class", F.size("coords").alias("points"))


@REGISTER(
    "u1_sql_functions",
    "SELECT route_id, di, seq, round({hav lat lon 51.7 39.2}, 6) AS km, lat BETWEEN 51.6 AND 51.7 AND lon BETWEEN 39.1 AND 39.2 AS inside, route_id AS number, 425 AS minute FROM v_zigzag",
)
def _(v: Views) -> DataFrame:
    sql.register(v.spark)
    return v.zigzag.selectExpr(
        "route_id", "di", "seq", "round(haversine_km(lat, lon, 51.7D, 39.2D), 6) AS km", "in_box(lat, lon, 51.6D, 39.1D, 51.7D, 39.2D) AS inside",
        "route_number(concat('э', route_id, ' (5)')) AS number", "bigint(hhmm_minutes(' 7:05')) AS minute",
    )

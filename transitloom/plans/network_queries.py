"""Queries of routes, stops, schedules, text functions and points of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import nearby, network
from ..sources import payloads
from ..tables import numbered
from .register import Register
from .surrogate import Views

REGISTER = Register()
_LABEL = "CASE route_type " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in text.TYPE_LABELS.items()) + " ELSE route_type END"


def _contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_SECTION = (
    "CASE "
    + " ".join(f"WHEN {_contains('t', w)} THEN '{k}'" for k, w in text.SECTION_WORDS)
    + f" WHEN contains(t, 'автобус') OR (contains(t, 'bus') AND NOT contains(t, 'trolley')) THEN 'bus' WHEN {_contains('t', text.MINIBUS_WORDS)} THEN 'minibus' END"
)
_IDEA = lambda t: "CASE " + " ".join(f"WHEN {_contains(t, w)} THEN '{k}'" for k, w in text.IDEA_WORDS) + " END"
_SQ = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@REGISTER("f1_route_tasks", "SELECT DISTINCT route_type, name, route_id FROM v_routes WHERE route_type NOT IN ('metro', 'train') AND NOT contains(name, '(') AND CAST(regexp_extract(name, '\\d+') AS BIGINT) <= 500")
def _(v: Views) -> DataFrame:
    return network.route_tasks(v.routes, exclude={"metro", "train"}, most_number=500).select("route_type", "name", "route_id")


@REGISTER("f2_number_filter", "SELECT route_id, NOT contains(name, '(') AND CAST(regexp_extract(name, '\\d+') AS BIGINT) <= 50 AS passes FROM v_routes")
def _(v: Views) -> DataFrame:
    return v.routes.select("route_id", text.passes_number_filter(F.col("name"), 50).alias("passes"))


@REGISTER("f3_active", "SELECT count(*) AS routes, count_if(active) AS active, count_if(NOT active) AS skipped FROM v_routes")
def _(v: Views) -> DataFrame:
    return v.routes.agg(F.count("*").alias("routes"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("skipped"))


_STATE = "st AS (SELECT r.*, CASE WHEN error IS NOT NULL THEN 'bad' WHEN d.route_id IS NOT NULL THEN 'ok' ELSE 'empty' END AS state FROM v_routes r LEFT JOIN (SELECT DISTINCT route_id FROM (SELECT route_id, di FROM v_points GROUP BY ALL HAVING count(*) >= 2)) d USING (route_id))"


@REGISTER("f4_route_states", f"WITH {_STATE} SELECT route_id, state FROM st")
def _(v: Views) -> DataFrame:
    return network.route_state(v.routes, v.points).select("route_id", "state")


@REGISTER("f5_ok_routes", f"WITH {_STATE} SELECT route_id FROM st WHERE state = 'ok'")
def _(v: Views) -> DataFrame:
    return network.route_state(v.routes, v.points).where("state = 'ok'").select("route_id")


@REGISTER("s4_route_number", "SELECT route_id, CAST(nullif(regexp_extract(name, '\\d+'), '') AS BIGINT) AS number FROM v_routes")
def _(v: Views) -> DataFrame:
    return v.routes.select("route_id", text.route_number(F.col("name")).alias("number"))


@REGISTER("s5_type_label", f"SELECT route_id, {_LABEL} AS label FROM v_routes")
def _(v: Views) -> DataFrame:
    return v.routes.select("route_id", text.type_label(F.col("route_type")).alias("label"))


_TRAINS_BOX = (51.6, 39.1, 51.63, 39.13)


@REGISTER(
    "snk4_type_counts",
    f"""WITH {_STATE}, t(title, kind) AS (VALUES ('Поездов', 'train'), ('Троллейбусов', 'trolleybus'), ('Трамваев', 'tram'), ('Автобусов', 'bus'), ('Маршруток', 'minibus'), ('Водных маршрутов', 'water')),
whole AS (SELECT route_id FROM v_points GROUP BY ALL HAVING bool_and(lat BETWEEN {_TRAINS_BOX[0]} AND {_TRAINS_BOX[2]} AND lon BETWEEN {_TRAINS_BOX[1]} AND {_TRAINS_BOX[3]}))
SELECT title, count(st.route_id) AS routes FROM t LEFT JOIN st ON st.route_type = kind AND state = 'ok' AND (kind <> 'train' OR st.route_id IN (SELECT route_id FROM whole)) GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    return network.type_counts(network.route_state(v.routes, v.points).where("state = 'ok'"), v.points, _TRAINS_BOX)


@REGISTER("snk8_errors", "SELECT route_id, name, error FROM v_routes WHERE error IS NOT NULL")
def _(v: Views) -> DataFrame:
    return v.routes.where("error IS NOT NULL").select("route_id", "name", "error")


@REGISTER("o1_route_order", f"SELECT route_id, row_number() OVER (ORDER BY route_type, name, route_id) AS place FROM v_routes")
def _(v: Views) -> DataFrame:
    return numbered(v.routes.select("route_type", "name", "route_id"), "place", "route_type", "name", "route_id").select("route_id", "place")


@REGISTER("o8_union", "SELECT route_id, name FROM v_routes UNION ALL SELECT p_partkey, p_name FROM part")
def _(v: Views) -> DataFrame:
    return v.routes.select("route_id", "name").unionByName(v.part.selectExpr("p_partkey AS route_id", "p_name AS name"))


@REGISTER("o9_intersect", "SELECT route_id FROM v_routes WHERE active INTERSECT SELECT route_id FROM v_points")
def _(v: Views) -> DataFrame:
    return v.routes.where("active").select("route_id").intersect(v.points.select("route_id"))


@REGISTER("o10_except", "SELECT route_id FROM v_routes EXCEPT SELECT route_id FROM v_routes WHERE error IS NOT NULL")
def _(v: Views) -> DataFrame:
    return v.routes.select("route_id").join(v.routes.where("error IS NOT NULL"), "route_id", "left_anti")


@REGISTER("o11_distinct_tasks", "SELECT DISTINCT route_id, weekday FROM v_departures")
def _(v: Views) -> DataFrame:
    return v.departures.dropDuplicates(["route_id", "weekday"]).select("route_id", "weekday")


@REGISTER("w9_first_wins", "SELECT route_id, min_by(event_id, (hhmm, event_id)) AS event_id FROM v_departures GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return network.first_of(v.departures, ["route_id"], ["hhmm", "event_id"]).select("route_id", "event_id")


@REGISTER("j1_cached_tasks", "SELECT route_id, route_id IN (SELECT route_id FROM v_departures) AS cached FROM v_routes")
def _(v: Views) -> DataFrame:
    known = v.departures.select("route_id").distinct()
    hits = v.routes.select("route_id").join(known, "route_id", "left_semi").withColumn("cached", F.lit(True))
    return hits.unionByName(v.routes.select("route_id").join(known, "route_id", "left_anti").withColumn("cached", F.lit(False)))


_NO_PARENTHESES = "regexp_replace({}, '\\([^()]*\\)', '', 'g')"
_CLEAN = "n"
for _ in range(12):  # deeper than any of the names below is nested
    _CLEAN = _NO_PARENTHESES.format(_CLEAN)
_CLEAN = _SQ(_CLEAN)
_BARE = lambda x: f"regexp_replace({_SQ(x)}, '^[ ,;:!?.\\-]+|[ ,;:!?.\\-]+$', '', 'g')"
_NORM = lambda x: _BARE("regexp_replace(lower(" + x + "), '[«»\"''’`]', '', 'g')")
#: Stop names with what the rules are about: marks, punctuation at the ends, nested and odd parentheses, none at all.
_ODD = """CASE seq % 8 WHEN 0 THEN concat('«', trim(stop_name), '». ') WHEN 1 THEN concat('’`', stop_name, ' - ') WHEN 2 THEN concat('((a) b)(', stop_name, '))')
WHEN 3 THEN concat('((((((((((', stop_name, '))))))))))') WHEN 4 THEN '“q”  „w“ ;' WHEN 5 THEN '' WHEN 6 THEN concat('"', stop_name, '", ?') ELSE stop_name END"""


@REGISTER("w4_endpoints", "SELECT route_id, di, min_by(stop_name, seq) AS first_stop, max_by(stop_name, seq) AS last_stop FROM v_stops_seq GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return network.endpoints(v.stops_seq)


@REGISTER("s1_normalize_terminal", f"SELECT DISTINCT n AS stop_name, {_NORM('n')} AS normal FROM (SELECT {_ODD} AS n FROM v_stops_seq)")
def _(v: Views) -> DataFrame:
    return v.stops_seq.select(F.expr(_ODD).alias("stop_name")).select("stop_name", text.normalize_terminal(F.col("stop_name")).alias("normal")).distinct()


@REGISTER("s2_clean_terminal", f"SELECT DISTINCT n AS stop_name, {_CLEAN} AS clean FROM (SELECT {_ODD} AS n FROM v_stops_seq)")
def _(v: Views) -> DataFrame:
    return v.stops_seq.select(F.expr(_ODD).alias("stop_name")).select("stop_name", text.clean_terminal_name(F.col("stop_name")).alias("clean")).distinct()


@REGISTER("s3_normalize_stop", f"SELECT DISTINCT n AS stop_name, {_BARE('lower(n)')} AS normal FROM (SELECT {_ODD} AS n FROM v_stops_seq)")
def _(v: Views) -> DataFrame:
    return v.stops_seq.select(F.expr(_ODD).alias("stop_name")).select("stop_name", text.normalize_stop_name(F.col("stop_name")).alias("normal")).distinct()


_STOPS = f"""k AS (SELECT s.*, route_type, (route_id, di, seq) AS o, coalesce(CAST(stop_id AS VARCHAR), 'name:' || {_BARE('lower(stop_name)')}) AS key FROM v_stops_seq s JOIN v_routes USING (route_id) WHERE error IS NULL),
us AS (SELECT key, min_by(coalesce(stop_id, -1), o) AS sid, min_by({_SQ('stop_name')}, o) AS name, min_by(lat, o) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS lat,
min_by(lon, o) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS lon, min_by(seq, o) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS idx,
list_sort(list(DISTINCT route_type)) AS types, list_sort(list(DISTINCT route_id)) AS routes FROM k GROUP BY key)"""


def _stops(v: Views) -> DataFrame:
    return network.unique_stops(v.stops_seq, v.routes)


@REGISTER("ag6_unique_stops", f"WITH {_STOPS} SELECT key, nullif(sid, -1) AS stop_id, name, lat, lon, idx, array_to_string(types, ',') AS types, array_to_string(routes, ',') AS routes FROM us")
def _(v: Views) -> DataFrame:
    return _stops(v).withColumns({"types": F.array_join("types", ","), "routes": F.array_join(F.col("routes").cast("array<string>"), ",")})


@REGISTER("snk10_unique_stops_sheet", f"WITH {_STOPS} SELECT row_number() OVER (ORDER BY lower(name), key) AS place, key, name, CAST(len(routes) AS BIGINT) AS routes FROM us")
def _(v: Views) -> DataFrame:
    stops = _stops(v).select("key", "name", F.size("routes").cast("bigint").alias("routes"))
    return numbered(stops, "place", F.lower("name"), F.col("key"))


@REGISTER("o2_stop_order", f"WITH {_STOPS} SELECT key, row_number() OVER (ORDER BY lower(name), key) AS place FROM us")
def _(v: Views) -> DataFrame:
    return numbered(_stops(v).select("key", "name"), "place", F.lower("name"), F.col("key")).select("key", "place")


@REGISTER("ag17_stops_area", "SELECT round((max(lat)-min(lat))*111.0*(max(lon)-min(lon))*111.0*cos(radians((max(lat)+min(lat))/2)), 6) AS area_km2 FROM v_stops_seq")
def _(v: Views) -> DataFrame:
    return network.stops_area_km2(v.stops_seq).select(F.round("area_km2", 6).alias("area_km2"))


@REGISTER("ag18_route_count", "SELECT s_suppkey AS city, greatest(1, CAST(round_even((0.156*abs(s_acctbal) + 0.729*s_nationkey + 0.375*s_suppkey) / (10.4*greatest(s_nationkey / 10.0, 0.1)), 0) AS BIGINT)) AS routes FROM supplier")
def _(v: Views) -> DataFrame:
    n = network.route_count_estimate(F.abs("s_acctbal"), F.col("s_nationkey"), F.col("s_suppkey"), F.col("s_nationkey") / 10)
    return v.supplier.select(F.col("s_suppkey").alias("city"), n.alias("routes"))


_TERM = f"""e AS (SELECT route_id, di, min_by(stop_name, seq) AS a, max_by(stop_name, seq) AS b FROM v_stops_seq GROUP BY ALL),
x AS (SELECT route_id, {_NORM(_CLEAN.replace('(n,', '(u.n,'))} AS key FROM e, unnest([a, b]) AS u(n))"""


@REGISTER("ag7_terminals", f"WITH {_TERM} SELECT key, array_to_string(list_sort(list(DISTINCT route_id)), ',') AS routes FROM x WHERE key <> '' GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return network.terminal_groups(v.stops_seq).select("key", F.array_join(F.col("routes").cast("array<string>"), ",").alias("routes"))


_SHIFT = lambda c, s: f"round_even(({c} - ({s})[CAST(seq % 8 AS INTEGER) + 1]) * 1e7, 0) / 1e7"
_SHIFT_BOX = (51.6, 39.1, 51.7, 39.2)


@REGISTER(
    "m9_fixed_coordinates",
    f"""WITH c AS (SELECT route_id, di, seq, lat, lon, {_SHIFT('lat', network.LAT_SHIFT)} AS la, {_SHIFT('lon', network.LON_SHIFT)} AS lo FROM v_stops_seq),
d AS (SELECT *, CASE WHEN lat BETWEEN {_SHIFT_BOX[0]} AND {_SHIFT_BOX[2]} AND lon BETWEEN {_SHIFT_BOX[1]} AND {_SHIFT_BOX[3]} THEN 0
 WHEN la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 THEN 1 WHEN lat BETWEEN -90 AND 90 THEN 0 END AS k FROM c)
SELECT route_id, di, seq, CASE k WHEN 0 THEN lat WHEN 1 THEN la END AS lat, CASE k WHEN 0 THEN lon WHEN 1 THEN lo END AS lon FROM d""",
)
def _(v: Views) -> DataFrame:
    at = network.fixed_coordinate(F.col("lat"), F.col("lon"), F.col("seq"), _SHIFT_BOX)
    return v.stops_seq.select("route_id", "di", "seq", at.alias("at")).select("route_id", "di", "seq", "at.lat", "at.lon")


@REGISTER("snk14_all_stops", "SELECT route_id, di + 1 AS direction, seq + 1 AS number, trim(stop_name) AS stop_name FROM v_stops_seq")
def _(v: Views) -> DataFrame:
    return v.stops_seq.select("route_id", (F.col("di") + 1).alias("direction"), (F.col("seq") + 1).alias("number"), text.squeeze(F.col("stop_name")).alias("stop_name"))


_MIN = "CAST(regexp_extract(hhmm, '(\\d+):(\\d+)', 1) AS INTEGER) * 60 + CAST(regexp_extract(hhmm, '(\\d+):(\\d+)', 2) AS INTEGER)"


_TIMES = "CASE event_id % 9 WHEN 0 THEN '7:5' WHEN 1 THEN '24:00' WHEN 2 THEN ' 07:05 ' WHEN 3 THEN '12:60' WHEN 4 THEN '705' WHEN 5 THEN '7:055' ELSE hhmm END"


@REGISTER("p7_minutes", f"SELECT event_id, CASE event_id % 9 WHEN 2 THEN 425 WHEN 6 THEN {_MIN} WHEN 7 THEN {_MIN} WHEN 8 THEN {_MIN} END AS minute FROM v_departures")
def _(v: Views) -> DataFrame:
    return v.departures.select("event_id", text.minutes(F.expr(_TIMES)).alias("minute"))


@REGISTER("d1f_clock", f"SELECT event_id, lpad(hhmm, 5, '0') AS clock FROM v_departures")
def _(v: Views) -> DataFrame:
    return v.departures.select("event_id", text.clock(text.minutes(F.col("hhmm"))).alias("clock"))


_FLAGS = ["CASE event_id % 8 WHEN 0 THEN 'on' WHEN 1 THEN '0' WHEN 2 THEN 'No' WHEN 3 THEN '2' WHEN 4 THEN '' WHEN 5 THEN '0.0' WHEN 6 THEN ' TRUE ' ELSE 'weekly' END", "CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'off' END"]


@REGISTER("p8_service_days", "SELECT event_id, event_id % 8 IN (0, 3, 6, 7) AS weekday, event_id % 3 = 0 AS weekend FROM events")
def _(v: Views) -> DataFrame:
    no = F.lit("none")
    weekday, weekend = payloads.service_days(F.array(no, F.expr(_FLAGS[0]), no, no, no, F.expr(_FLAGS[1]), no))
    return v.events.select("event_id", weekday.alias("weekday"), weekend.alias("weekend"))


@REGISTER(
    "ag8_schedules",
    f"""WITH s AS (SELECT route_id, min({_MIN}) AS first, max({_MIN}) AS last, count(*) AS trips, count_if(weekday) AS weekday_trips, count_if(weekend) AS weekend_trips FROM v_departures GROUP BY ALL),
n AS (SELECT *, CASE WHEN weekday_trips > 0 THEN weekday_trips ELSE trips END AS n FROM s)
SELECT route_id, first, last, weekday_trips, weekend_trips, round(CASE WHEN n > 1 THEN CAST(last - first AS DOUBLE) / (n - 1) ELSE 0.0 END, 6) AS head_minutes,
CASE WHEN weekday_trips > 0 AND weekend_trips > 0 THEN 'ежедневно' WHEN weekday_trips > 0 THEN 'будни' WHEN weekend_trips > 0 THEN 'выходные' ELSE '' END AS days FROM n""",
)
def _(v: Views) -> DataFrame:
    return network.schedule_summary(v.departures).withColumn("head_minutes", F.round("head_minutes", 6))


@REGISTER("p17_section_types", f"WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, {_SECTION} AS kind FROM d")
def _(v: Views) -> DataFrame:
    return v.documents.select("doc_id", text.classify_section(F.col("text")).alias("kind"))


@REGISTER("p14_idea_types", f"WITH d AS (SELECT doc_id, lower(text) AS t, lower(source) AS h FROM documents) SELECT doc_id, coalesce({_IDEA('h')}, {_IDEA('t')}, 'bus') AS kind FROM d")
def _(v: Views) -> DataFrame:
    return v.documents.select("doc_id", text.idea_type(F.col("text"), F.col("source")).alias("kind"))


_PAYLOADS = """CASE doc_id % 7 WHEN 0 THEN '{"is_electrobus": true}' WHEN 1 THEN '{"transportTags": [{"name": "Электробус 5"}]}' WHEN 2 THEN '{"is_electrobus": false, "note": "нет", "trips": "электробус"}'
WHEN 3 THEN '{"transportClasses": [{"name": "a"}, {"name": "электробус"}]}' WHEN 4 THEN '{"company": "ЭЛЕКТРОБУС-парк"}' WHEN 5 THEN '{"is_electrobus": 0}' ELSE '{}' END"""


@REGISTER("p11_electrobus", "SELECT doc_id, doc_id % 7 IN (0, 1, 3, 4) OR contains(lower(text), 'электробус') AS electrobus FROM documents")
def _(v: Views) -> DataFrame:
    return v.documents.select("doc_id", payloads.is_electrobus(F.expr(_PAYLOADS), F.col("text")).alias("electrobus"))


@REGISTER(
    "p13_ratings",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN -round(value + 1, 1) ELSE round(value + 1, 1) END AS rating, CASE WHEN event_id % 4 > 1 THEN user_id END AS votes FROM events",
)
def _(v: Views) -> DataFrame:
    number = F.replace(F.round(F.col("value") + 1, 1).cast("decimal(20,1)").cast("string"), F.lit("."), F.lit(","))
    votes = F.concat(number, F.lit(" ("), F.col("user_id").cast("string"), F.lit(")"))
    written = F.when(F.col("event_id") % 4 == 0, "—").when(F.col("event_id") % 4 == 1, F.concat(F.lit(" -"), number)).otherwise(votes)
    rating, votes = text.idea_rating(written)
    return v.events.select("event_id", rating.alias("rating"), votes.alias("votes"))


_URLS = "CASE page_id % 5 WHEN 0 THEN '/Catalog/Kazan/?routes=1' WHEN 1 THEN '/catalog' WHEN 2 THEN '//a.example/%D0%9A%D0%B0+b/x#y' WHEN 3 THEN '?routes=5' ELSE url END"


@REGISTER("p18_city_from_url", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'kazan' WHEN 2 THEN 'ка+b' WHEN 4 THEN nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)), '') END AS city FROM pages")
def _(v: Views) -> DataFrame:
    return v.pages.select("page_id", text.city_from_url(F.expr(_URLS)).alias("city"))


@REGISTER("p19_routes_argument", "SELECT page_id, try_cast(nullif(regexp_extract(url || '&routes=' || page_id, '[?&]routes=(\\d+)(?:[&#]|$)', 1), '') AS BIGINT) AS route_id FROM pages")
def _(v: Views) -> DataFrame:
    return v.pages.select("page_id", text.routes_argument(F.concat("url", F.lit("&routes="), "page_id")).alias("route_id"))


@REGISTER("p20_city_titles", f"SELECT page_id, {_SQ('regexp_extract(html, $$(?is)<h1[^>]*>(.*?)</h1>$$, 1)')} AS title FROM pages")
def _(v: Views) -> DataFrame:
    return v.pages.select("page_id", text.city_title(F.col("html"), F.lit("")).alias("title"))


@REGISTER("src6_page_tokens", "SELECT page_id, nullif(regexp_extract('tk: ''' || md5(url) || '''', 'tk:\\s*[''\"]([a-f0-9-]+)[''\"]', 1), '') AS token FROM pages")
def _(v: Views) -> DataFrame:
    return v.pages.select("page_id", text.page_token(F.concat(F.lit("tk: '"), F.md5("url"), F.lit("'"))).alias("token"))


_COLORS = "hex(CAST(round_even(a + (b - a) * f, 0) AS BIGINT))"


@REGISTER("s11_heat_colors")
def _(v: Views) -> DataFrame:
    t = F.col("c_acctbal") / v.customer.agg(F.max("c_acctbal")).scalar()
    return v.customer.select("c_custkey", text.heat_color(t).alias("color"))


@REGISTER("s6_curvature_text", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 1 THEN '∞' ELSE printf('%.2f', l_quantity / 3) END AS shown FROM lineitem")
def _(v: Views) -> DataFrame:
    value = F.when(F.col("l_quantity") <= 1, float("inf")).otherwise(F.col("l_quantity") / 3)
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.curvature_text(value).alias("shown"))


_HITS = """seg AS (SELECT * FROM (SELECT route_id, di, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1, lat AS lat2, lon AS lon2 FROM v_points WINDOW w AS (PARTITION BY route_id, di ORDER BY seq)) WHERE lat1 IS NOT NULL),
named AS (SELECT * FROM v_pois WHERE name IS NOT NULL),
pair AS (SELECT poi_id, poi_type, route_id, di, lat, lon, lat1, lon1, lat2, lon2 FROM named JOIN seg ON abs(lat - lat1) < 0.0054 AND lon BETWEEN least(lon1, lon2) - 0.02 AND greatest(lon1, lon2) + 0.02),
v AS (SELECT *, cos(radians(lat))*cos(radians(lon)) AS px, cos(radians(lat))*sin(radians(lon)) AS py, sin(radians(lat)) AS pz,
 cos(radians(lat1))*cos(radians(lon1)) AS ax, cos(radians(lat1))*sin(radians(lon1)) AS ay, sin(radians(lat1)) AS az,
 cos(radians(lat2))*cos(radians(lon2)) AS bx, cos(radians(lat2))*sin(radians(lon2)) AS bw, sin(radians(lat2)) AS bz FROM pair),
n AS (SELECT *, ay*bz-az*bw AS nx, az*bx-ax*bz AS ny, ax*bw-ay*bx AS nz FROM v), s AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS size FROM n),
dist AS (SELECT poi_id, poi_type, route_id, di, CASE WHEN size > 1e-15 AND (ny*az-nz*ay)*px+(nz*ax-nx*az)*py+(nx*ay-ny*ax)*pz >= -1e-12*size
 AND (bw*nz-bz*ny)*px+(bz*nx-bx*nz)*py+(bx*ny-bw*nx)*pz >= -1e-12*size THEN 6371.0*abs(asin(greatest(-1.0, least(1.0, (nx*px+ny*py+nz*pz)/nullif(size, 0)))))
 ELSE least({hav lat lon lat1 lon1}, {hav lat lon lat2 lon2}) END AS km FROM s),
hits AS (SELECT DISTINCT poi_id, poi_type, route_id, di FROM dist WHERE km <= 0.4),
val AS (SELECT poi_type, count(*) AS count, greatest(1.0, 1000.0 / count(*)) AS value FROM (SELECT DISTINCT poi_id, poi_type FROM hits) GROUP BY ALL)"""


def _hits(v: Views) -> DataFrame:
    return nearby.near_segments(v.pois.where("name IS NOT NULL").select("poi_id", "poi_type", "lat", "lon"), v.points, 400.0, 55.0)


def _near(v: Views) -> DataFrame:
    return nearby.near_any(v.pois.where("name IS NOT NULL"), v.points, 400.0, 55.0)


@REGISTER("j7_pois_near_directions", f"WITH {_HITS} SELECT poi_id, route_id, di FROM hits")
def _(v: Views) -> DataFrame:
    return _hits(v).select("poi_id", "route_id", "di")


@REGISTER("j6_pois_in_corridor", f"WITH {_HITS} SELECT DISTINCT poi_id FROM hits")
def _(v: Views) -> DataFrame:
    return _near(v).select("poi_id").distinct()


@REGISTER("ag9_poi_values", f"WITH {_HITS} SELECT poi_type, count, round(value, 6) AS value FROM val")
def _(v: Views) -> DataFrame:
    return nearby.poi_values(_near(v).select("poi_id", "poi_type").distinct()).withColumn("value", F.round("value", 6))


_STATS = "SELECT {by}, round(sum(value), 6) AS total_value, count(*) AS count FROM (SELECT DISTINCT poi_id, poi_type, {by} FROM hits) JOIN val USING (poi_type) GROUP BY ALL"


def _stats(v: Views, by: list[str]) -> DataFrame:
    return nearby.near_stats(v.pois.where("name IS NOT NULL"), v.points, 400.0, by, 55.0).withColumn("total_value", F.round("total_value", 6))


@REGISTER("ag10_poi_direction_stats", f"WITH {_HITS} " + _STATS.format(by="route_id, di"))
def _(v: Views) -> DataFrame:
    return _stats(v, ["route_id", "di"]).drop("by_type")


@REGISTER("ag10_poi_route_stats", f"WITH {_HITS} " + _STATS.format(by="route_id"))
def _(v: Views) -> DataFrame:
    return _stats(v, ["route_id"]).drop("by_type")


@REGISTER(
    "snk6_poi_sheet",
    f"WITH {_HITS} SELECT route_id, count(DISTINCT poi_id) AS count, count(DISTINCT poi_id) FILTER (poi_type = 'AUTOMOBILE') AS automobile, count(DISTINCT poi_id) FILTER (poi_type = 'BUILDING') AS building FROM hits GROUP BY ALL",
)
def _(v: Views) -> DataFrame:
    of = lambda k: F.coalesce(F.try_element_at("by_type", F.lit(k)), F.lit(0)).cast("bigint").alias(k.lower())
    return _stats(v, ["route_id"]).select("route_id", "count", of("AUTOMOBILE"), of("BUILDING"))


_ELEMENTS = """c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'way' WHEN 2 THEN 'relation' ELSE 'area' END AS type,
CASE WHEN c_custkey % 11 <> 3 THEN 51.0 + c_nationkey / 100.0D END AS lat, CAST(39 AS DOUBLE) AS lon,
CASE WHEN c_custkey % 13 <> 5 THEN named_struct('lat', 52.0 + c_nationkey / 100.0D, 'lon', CAST(40 AS DOUBLE)) END AS center,
map('name', CASE WHEN c_custkey % 9 = 4 THEN '  ' ELSE concat(' ', c_name) END, 'amenity', CASE c_custkey % 5 WHEN 0 THEN 'school' WHEN 1 THEN 'kindergarten' WHEN 2 THEN 'school' ELSE 'bar' END,
 'landuse', CASE WHEN c_custkey % 17 = 1 THEN 'military' ELSE 'grass' END, 'military', CASE WHEN c_custkey % 19 = 2 THEN 'barracks' WHEN c_custkey % 19 = 3 THEN 'bunker' END,
 'access', CASE WHEN c_custkey % 3 = 0 THEN 'private' END, 'aeroway', CASE WHEN c_custkey % 7 = 0 THEN 'aerodrome' END) AS tags"""
_OSM = """SELECT c_custkey AS poi_id, CASE WHEN c_custkey % 5 = 1 THEN 'Детский сад' ELSE 'Школа' END AS poi_type, c_name AS name,
CASE WHEN c_custkey % 4 = 0 THEN 51.0 + c_nationkey / 100.0 ELSE 52.0 + c_nationkey / 100.0 END AS lat, CASE WHEN c_custkey % 4 = 0 THEN 39.0 ELSE 40.0 END::DOUBLE AS lon
FROM customer WHERE c_custkey % 9 <> 4 AND c_custkey % 5 IN (0, 1, 2) AND c_custkey % 17 <> 1 AND c_custkey % 19 <> 2 AND NOT (c_custkey % 3 = 0 AND c_custkey % 7 = 0)
AND CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 11 <> 3 WHEN c_custkey % 4 < 3 THEN c_custkey % 13 <> 5 ELSE false END"""


@REGISTER("src14_osm_pois", f"SELECT poi_id, poi_type, name, round(lat, 6) AS lat, lon FROM ({_OSM})")
def _(v: Views) -> DataFrame:
    found = nearby.osm_pois(v.customer.selectExpr(f"inline(array(struct({_ELEMENTS})))"))
    return found.select("poi_id", "poi_type", "name", F.round("lat", 6).alias("lat"), "lon")


@REGISTER("f14_osm_poi_counts", f"SELECT poi_type, count(*) AS pois FROM ({_OSM}) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    found = nearby.osm_pois(v.customer.selectExpr(f"inline(array(struct({_ELEMENTS})))"))
    return found.groupBy("poi_type").agg(F.count("*").alias("pois"))


@REGISTER("f14_named_pois", "SELECT poi_id FROM v_pois WHERE name IS NOT NULL")
def _(v: Views) -> DataFrame:
    return v.pois.where("name IS NOT NULL").select("poi_id")


@REGISTER("m10_safe_values", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS value FROM customer")
def _(v: Views) -> DataFrame:
    number = F.col("c_acctbal").cast("string").try_cast("double")
    return v.customer.select("c_custkey", F.when((number > 0) & ~F.isnan(number), number).otherwise(0.0).alias("value"))


@REGISTER("js1_event_properties", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(v: Views) -> DataFrame:
    return v.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@REGISTER("src9_loaded_tasks", "SELECT r.route_id, r.route_type, count(event_id) AS departures FROM v_routes r LEFT JOIN v_departures USING (route_id) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    loaded = v.departures.groupBy("route_id").agg(F.count("*").alias("departures"))
    tasks = v.routes.dropDuplicates(["route_type", "route_id"])
    return tasks.join(loaded, "route_id", "left").select("route_id", "route_type", F.coalesce("departures", F.lit(0)).alias("departures"))

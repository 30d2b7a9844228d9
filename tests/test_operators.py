import math
import random
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitloom import cli
from transitloom.config import ConfigError, Limits, RunConfig, parse_types, resolve_city
from transitloom.functions import geo, text
from transitloom.operators import corridor, generate, geometry, mosaic, network, overlap, raster
from transitloom.plans import batch
from transitloom.plans.network import Network
from transitloom.sources import files, payloads, workbook
from transitloom.tables import numbered


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(*x):
    return [F.lit(v) for v in x]


def test_distances(spark):
    assert one(spark, geo.haversine_km(*lit(51.0, 39.0, 51.0, 39.0))) == 0.0
    assert one(spark, geo.haversine_km(*lit(0.0, 0.0, 0.0, 1.0))) == pytest.approx(6371 * math.radians(1))
    assert one(spark, geo.segment_distance_km(*lit(0.5, 0.5, 0.0, 0.0, 0.0, 1.0))) == pytest.approx(6371 * math.radians(0.5), rel=1e-9)
    assert one(spark, geo.segment_distance_km(*lit(0.0, 2.0, 0.0, 0.0, 0.0, 1.0))) == pytest.approx(6371 * math.radians(1))
    assert one(spark, geo.segment_distance_km(*lit(1.0, 0.0, 0.0, 0.0, 0.0, 0.0))) == pytest.approx(6371 * math.radians(1))


def test_projection_keeps_short_distances(spark):
    a, b = geo.with_utm_xy(spark.createDataFrame([(51.67, 39.2, 32637), (51.67, 39.21, 32637)], "lat double, lon double, epsg int")).collect()
    # WGS84 ellipsoid: one hundredth of a degree of longitude at this latitude, times the zone's scale
    n = 6378137 / math.sqrt(1 - 0.00669437999014 * math.sin(math.radians(51.67)) ** 2)
    metres = math.radians(0.01) * n * math.cos(math.radians(51.67)) * 0.9996
    assert math.hypot(a.x - b.x, a.y - b.y) == pytest.approx(metres, rel=1e-4) and a.x == pytest.approx(513831, abs=300)


def test_text_functions(spark):
    assert [one(spark, text.minutes(F.lit(x))) for x in ("24:00", "7:05", "705", None, "23:59", "7:5", " 07:05 ")] == [None, 425, None, None, 1439, None, 425]
    number = [one(spark, text.passes_number_filter(F.lit(x), 11)) for x in ("э11", "11а", "б/н", "5 (x)", "12")]
    assert number == [True, True, False, False, False]
    assert one(spark, text.clean_terminal_name(F.lit("A (b (c) d) e"))) == "A e"
    assert one(spark, text.clean_terminal_name(F.lit("(" * 30 + "x" + ")" * 30 + " a) (b (c)"))) == "a) (b"
    assert [one(spark, text.normalize_terminal(F.lit(x))) for x in ("«Площадь’`» - ", "", None, "“a”")] == ["площадь", "", "", "“a”"]
    assert [one(spark, text.normalize_stop_name(F.lit(x))) for x in (" Площадь. ", "«A»", None)] == ["площадь", "«a»", ""]
    assert [one(spark, text.city_from_url(F.lit(x))) for x in ("/Catalog/Kazan/?a=/b", "http://a.b/x", "/catalog", "?x", None)] == ["kazan", "x", None, None, None]
    assert [tuple(one(spark, F.struct(*[c.alias(n) for c, n in zip(text.idea_rating(F.lit(x)), "ab", strict=True)]))) for x in ("4,5 (12)", "—", "-1")] == [(4.5, 12), (None, None), (-1.0, None)]
    assert one(spark, text.classify_section(F.lit("Электробусы и автобусы"))) == "electrobus"
    assert one(spark, text.classify_section(F.lit("nothing"))) is None
    assert [one(spark, text.heat_color(F.lit(t))) for t in (0.0, 0.5, 1.0)] == ["ffff0000", "ff00ff00", "ff0000ff"]


def test_limits_and_states(spark):
    points = spark.createDataFrame([(1, 0, 0, 51.0, 39.0), (1, 0, 1, 51.2, 39.0), (2, 0, 0, 51.0, 39.0), (2, 0, 1, 51.001, 39.0)], "route_id long, di int, seq long, lat double, lon double")
    reasons = dict(geometry.route_limits(points, 2.0, 1.0, 10.0, (51.0, 39.0)).select("route_id", "reason").collect())
    assert reasons == {1: "радиус", 2: "длина"}
    assert set(dict(geometry.route_limits(points).select("route_id", "reason").collect()).values()) == {None}
    loop = spark.createDataFrame([(1, 0, 0, 51.0, 39.0), (1, 0, 1, 51.0, 39.0)], points.schema)
    assert geometry.direction_km(loop).first().curvilinearity == 0.0
    routes = spark.createDataFrame([(1, "a", "bus", True, None), (2, "b", "bus", True, "download failed"), (3, "c", "tram", False, None)], "route_id long, name string, route_type string, active boolean, error string")
    assert dict(network.route_state(routes, points).select("route_id", "state").collect()) == {1: "ok", 2: "bad", 3: "empty"}


def test_grid_dedupe(spark):
    points = spark.createDataFrame([(1, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (0.004, 0.004), (0.02, 0.0), (0.021, 0.0)])], "route_id long, di int, seq long, x double, y double")
    assert [(r.x, r.y) for r in geometry.without_repeats(points).orderBy("seq").collect()] == [(0.0, 0.0), (0.02, 0.0)]


def greedy(edges, volume, k_del):
    live = {}
    for x, y, k in edges:
        if k > k_del and x != y:
            live.setdefault(x, {})[y] = k
            live.setdefault(y, {})[x] = k
    out = []
    while any(live.values()):
        node = min((n for n, e in live.items() if e), key=lambda n: (volume.get(n, 0.0), -max(live[n].values()), n))
        gone = live.pop(node)
        for other in gone:
            live[other].pop(node, None)
        out.append((node, len(gone), min(gone, key=lambda o: (-gone[o], o))))
    return out


@pytest.mark.parametrize("kinds", [1000, 4, 1])
def test_removals_against_greedy_loop(spark, kinds):
    rng = random.Random(kinds)
    nodes = range(24)
    edges = [(a, b, round(rng.random(), 2)) for a in nodes for b in nodes if a < b and rng.random() < 0.25]
    volume = {n: float(rng.randrange(kinds)) for n in nodes if n % 5}
    got = overlap.removals(spark.createDataFrame(edges, "x long, y long, kmax double"), spark.createDataFrame(list(volume.items()), "node long, volume double"), 0.4)
    assert [(r.node, r.partners, r.representative) for r in got.orderBy("step").collect()] == greedy(edges, volume, 0.4)


@pytest.mark.parametrize("grouped, rounds", [(0, 40), (0, 2), (40, 40)])
def test_tied_removals_in_rounds(spark, monkeypatch, grouped, rounds):
    """The order of the loop, whether ties go in rounds, by components, or first in rounds and then by components."""
    monkeypatch.setattr(overlap, "GROUPED_EDGES", grouped)
    monkeypatch.setattr(overlap, "ROUNDS", rounds)
    rng = random.Random(grouped + rounds)
    edges = [(a, b, rng.choice([0.5, 0.6, 0.7])) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.12]
    edges += [(100 + n, 101 + n, 0.9) for n in range(12)]  # a chain that goes one by one
    volume = {n: float(rng.randrange(3)) for n in range(30)}
    got = overlap.removals(spark.createDataFrame(edges, "x long, y long, kmax double"), spark.createDataFrame(list(volume.items()), "node long, volume double"), 0.4)
    assert [(r.node, r.partners, r.representative) for r in got.orderBy("step").collect()] == greedy(edges, volume, 0.4)


def test_equal_volumes_without_an_edge_go_by_their_edges(spark):
    edges = [(1, 10, 0.6), (2, 11, 0.9)]
    volumes = spark.createDataFrame([(1, 1.0), (2, 1.0), (10, 5.0), (11, 6.0)], "node long, volume double")
    got = overlap.removals(spark.createDataFrame(edges, "x long, y long, kmax double"), volumes, 0.4)
    assert [r.node for r in got.orderBy("step").collect()] == [n for n, *_ in greedy(edges, {1: 1.0, 2: 1.0, 10: 5.0, 11: 6.0}, 0.4)] == [2, 1]


def test_removal_examples(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges, volumes = "x long, y long, kmax double", "node long, volume double"
    got = overlap.removals(frame([(1, 2, 0.9), (2, 3, 0.8)], edges), frame([(1, 100.0), (2, 10.0), (3, 20.0)], volumes), 0.7).collect()
    assert [(r.node, r.representative, r.partners) for r in got] == [(2, 1, 2)]
    got = overlap.removals(frame([(1, 2, 0.8), (1, 3, 0.95), (1, 4, 0.9)], edges), frame([(1, 1.0), (2, 10.0), (3, 20.0), (4, 30.0)], volumes), 0.7).collect()
    assert got[0].representative == 3 and got[0].closed.startswith("3 (0.950)")
    with pytest.raises(ValueError):
        overlap.clean_edges(frame([(1, 2, 0.8)], edges), 1.2)
    with pytest.raises(ValueError):
        overlap.removals_weighted(frame([(1, 2, 0.8)], edges), frame([(1, 1.0)], volumes), frame([(1, 1.0)], "node long, distance double"), 0.7, 0.0)


def test_covered_length_against_sampling(spark):
    rng = random.Random(9)
    lines = {n: [(rng.uniform(0, 600), rng.uniform(0, 600)) for _ in range(4)] for n in range(4)}
    rows = [(n, 0, i, x, y) for n, line in lines.items() for i, (x, y) in enumerate(line)]
    segments = overlap.node_segments(spark.createDataFrame(rows, "node long, line int, seq long, x double, y double"))
    got = {(r.node, r.other): r.covered for r in overlap.covered_lengths(segments, 80.0).collect()}

    def near(p, line):
        for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
            t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            if math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay)) <= 80:
                return True
        return False

    for a in lines:
        for b in lines:
            if a != b:
                metres = 0.0
                for p, q in zip(lines[a], lines[a][1:], strict=False):
                    hits = sum(near((p[0] + (q[0] - p[0]) * (i + 0.5) / 2000, p[1] + (q[1] - p[1]) * (i + 0.5) / 2000), lines[b]) for i in range(2000))
                    metres += math.dist(p, q) * hits / 2000
                assert got.get((a, b), 0.0) == pytest.approx(metres, abs=2.0)


def test_raster_windows(spark):
    pixels = spark.createDataFrame([(0, r, c, float(r * 10 + c)) for r in range(6) for c in range(6)] + [(0, 9, 9, 4294967295.0)], "tile_id int, row_no long, col_no long, raw_value double")
    squares = spark.createDataFrame([(1, 1, 2, 1, 3), (2, 50, 60, 50, 60)], "k long, row_lo long, row_hi long, col_lo long, col_hi long")
    sums = dict(raster.window_sums(pixels, squares, "k").collect())
    assert sums == {1: float(sum(r * 10 + c for r in (1, 2) for c in (1, 2, 3))), 2: 0.0}
    prefix = {(r.row_no, r.col_no): r.total for r in raster.prefix_sums(pixels).collect()}
    assert prefix[2, 3] - prefix[0, 3] - prefix[2, 0] + prefix[0, 0] == sums[1]
    top = raster.top_share(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0)], "key string, weight double"), "weight", "key", 10.0)
    assert [r.key for r in top.collect()] == ["b"]


def test_payloads(spark):
    assert payloads.decode_text(payloads.decode_text("Улица 5 😀")) == "Улица 5 😀"
    raw = spark.createDataFrame([([[float("nan"), 1.0], [58.412, 46.25]],)], "c array<array<double>>")
    (p,) = raw.select(payloads.unshift_array(F.col("c")).alias("p")).first().p
    assert (p.lat, p.lon) == (51.6, 39.2)  # the invalid point took the first shift
    ids = [one(spark, payloads.stop_id(F.lit(x))) for x in ("true", "12.0", " 7 ", "x", None)]
    assert ids == [None, 12, 7, None, None]
    text_of = '{"trips":[{"schedules":[{"weekDays":["1","0","0","0","0","0","0"],"departureTimes":[{"actualDepartureTime":"6:30"}]}]}]}'
    got = network.schedule_summary(payloads.payload_departures(spark.createDataFrame([(1, text_of)], "route_id long, payload string"))).first()
    assert (got["first"], got.head_minutes, got.days) == (390, 0.0, "будни")
    rows = spark.createDataFrame([('a "b": [1, "]", [2]] z', 0), ("none", 0), ("[1, 2", 0)], "s string, i int")
    assert [r[0] for r in rows.select(payloads.balanced_array("s", "i")).collect()] == ['[1, "]", [2]]', None, None]
    assert one(spark, payloads.transport_class(F.lit('{"a":[{"capacityClass":{"name":"big"}}]}'))) == "big"


def test_cache_and_batch(spark, tmp_path):
    cache = files.JsonCache(spark, str(tmp_path / "cache"))
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert {r.value for r in cache.get("route", keys).collect()} == {None}
    cache.put("route", spark.createDataFrame([("a", '{"x":1}'), ("b", "{broken")], "key string, value string"))
    assert dict(cache.get("route", keys).collect()) == {"a": '{"x":1}', "b": None}
    (tmp_path / "batch.txt").write_text("﻿# comment\npython run.py voronezh --dedup\n\nkiev # trailing\nkiev\n--flag\nx --batch y\n")
    got = files.batch_commands(spark, str(tmp_path / "batch.txt")).orderBy("place")
    assert [r.command for r in got.collect()] == ["voronezh --dedup", "kiev"]
    assert files.output_base_name("voronezh.xlsx", "x") == "voronezh" and files.output_base_name(None, "Voronezh") == "voronezh_routes"


def test_exports(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, 0, 51.0, 39.0), (1, 0, 1, 51.2, 39.0), (1, 1, 0, 51.0, 39.0)], "route_id long, di int, seq long, lat double, lon double")
    routes = spark.createDataFrame([(1, "a & b", "bus")], "route_id long, name string, route_type string")
    marks = files.placemarks(points, routes)
    assert [r.di for r in marks.collect()] == [0] and "a &amp; b" in marks.first().xml
    files.write_kml(marks, str(tmp_path / "kml"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "kml")).collect()]
    assert lines[0].startswith("<Folder>") and lines[-1] == "</Folder>" and len(lines) == 3
    files.write_sheets({"routes": routes}, str(tmp_path / "sheets"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheets" / "01_routes")).count() == 1


def test_stream_upserts(spark, tmp_path):
    from transitloom.streaming.payloads import current_directions, upsert_directions

    trip = lambda n: '{"trips":[{"coords":[%s],"stops":[]}]}' % ",".join(f"[{56.9 + i / 100},46.9]" for i in range(n))
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for version, n in ((1, 2), (2, 3)):
        spark.createDataFrame([(1, trip(n), version)], "route_id long, payload string, version long").coalesce(1).write.mode("append").json(source)
        assert upsert_directions(spark, source, target, marks).awaitTermination(120)
    (row,) = current_directions(spark, target).collect()
    assert row.version == 2 and len(row.coords) == 3


def test_configuration():
    assert resolve_city("https://example.org/kyiv/catalog") == "kiev" and resolve_city(" Voronezh ") == "voronezh"
    assert parse_types(["bus,tram", "metro"]) == {"bus", "tram", "metro"}
    assert Limits(radius_km=10, center=(51.0, None)).where is None and Limits(radius_km=10, center=(51.0, 39.0)).where == (51.0, 39.0)
    for bad in ({"include": frozenset({"bus"}), "exclude": frozenset({"bus"})}, {"dedup_threshold": 1.2}, {"poi_buffer_m": -1}):
        with pytest.raises(ConfigError):
            RunConfig("x", **bad)
    with pytest.raises(ConfigError):
        parse_types(["spaceship"])


@pytest.mark.parametrize("lat", [51.6, 60.0, 70.0])
def test_corridor_pixels_at_northern_latitudes(spark, lat):
    """A north-south corridor against every pixel of the raster."""
    west, step = 30.0, 0.001
    pixels = [("t", r, c, lat + 0.02 - (r + 0.5) * step, west + (c + 0.5) * step, 1.0) for r in range(20) for c in range(60)]
    rows = spark.createDataFrame(pixels, "tile_id string, row_no long, col_no long, lat double, lon double, raw_value double")
    points = spark.createDataFrame([(1, 0, k, lat + 0.005 + 0.01 * k, west + 0.03) for k in range(2)], "route_id long, di int, seq int, lat double, lon double")
    got = raster.corridor_sums(points, rows, 400.0, north=lat + 0.02, west=west, step=step).first()
    shrink = math.cos(math.radians(lat + 0.01))
    away = lambda p: 111.0 * math.hypot((p[4] - west - 0.03) * shrink, max(lat + 0.005 - p[3], 0.0, p[3] - lat - 0.015))
    assert got.pixels == sum(away(p) <= 0.4 for p in pixels)


def hand_sum(pixels, grid, x, y, half):
    """The pixels that a square touches, one by one."""
    total = 0.0
    for (r, c), value in pixels.items():
        west, north = grid.west + c * grid.width, grid.north - r * grid.height
        if west < x + half and west + grid.width > x - half and north > y - half and north - grid.height < y + half:
            total += value
    return total


def hand_path(start, goal, stops, pixels, grid, how):
    """A path as the rule has it: the first radius with a stop, those ahead if any, the corridor of most volume."""
    at, path, metres, total = start, [], 0.0, 0.0
    while True:
        if math.dist(at, goal) <= max(how.first_radius, 400):
            return path, metres, total, generate.REACHED
        if metres >= how.longest_m:
            return path, metres, total, generate.TOO_LONG
        near, radius = [], how.first_radius
        while not near and radius <= how.last_radius:
            near = [k for k in sorted(stops) if k not in path and 30 < math.dist(at, stops[k]) <= radius]
            radius += how.step
        if not near:
            return path, metres, total, generate.NO_STOPS
        near = [k for k in near if math.dist(stops[k], goal) < math.dist(at, goal) - 1] or near
        worth = {}
        for k in near:
            n = max(1, int(math.dist(at, stops[k]) / how.corridor_m))
            samples = [tuple(a + (b - a) * (i + 0.5) / n for a, b in zip(at, stops[k], strict=True)) for i in range(n)]
            worth[k] = sum(hand_sum(pixels, grid, *s, max(50.0, how.corridor_m / 2)) for s in samples)
        best = max(near, key=lambda k: (worth[k], [-ord(x) for x in k]))
        if worth[best] <= 0:
            return path, metres, total, generate.NO_VOLUME
        metres, total, at = metres + math.dist(at, stops[best]), total + worth[best], stops[best]
        path.append(best)


@pytest.mark.parametrize("status", ["reached", "long", "volume", "stops"])
def test_generated_paths_equal_the_rule(spark, status):
    rng = random.Random(3)
    stops = {f"s{k:03d}": (rng.uniform(0, 6000), rng.uniform(0, 3000)) for k in range(300)}
    if status == "stops":  # a gap that no radius spans
        stops = {k: p for k, p in list(stops.items())[:60] if p[0] < 2500 or p[0] > 5900}
    ends = {"a": (0.0, 1500.0, 9.0), "b": (6000.0, 1400.0, 5.0), "c": (100.0, 1600.0, 7.0)}
    grid = generate.Grid(west=-500.0, north=3500.0, width=100.0, height=80.0)
    pixels = {(r, c): float(rng.randrange(50)) for r in range(50) for c in range(70 if status != "volume" else 25) if rng.random() < 0.8}
    how = generate.Growth(first_radius=500.0, last_radius=1100.0, step=200.0, corridor_m=300.0, longest_m=2000.0 if status == "long" else 20000.0)
    place = lambda p: (p[0], p[1], 51 + p[1] / 111000, 39 + p[0] / 70000)
    frame = spark.createDataFrame([(k, *place(p)) for k, p in stops.items()], "key string, x double, y double, lat double, lon double")
    found = spark.createDataFrame([(k, *place(p), p[2]) for k, p in ends.items()], "key string, x double, y double, lat double, lon double, volume double")
    found = numbered(found, "rank", generate.F.desc("volume"), "key")
    cells = spark.createDataFrame([(r, c, x) for (r, c), x in pixels.items()], "row_no long, col_no long, raw_value double")
    got = {r.origin: r for r in generate.generate_routes(frame, found, cells, grid, 2, how).collect()}
    # a is best; c lies next to it, so b is its destination; then c, and b is used: the best other terminal is a
    span = math.hypot(*(max(p[k] for p in stops.values()) - min(p[k] for p in stops.values()) for k in (0, 1)))
    assert span * 0.2 > math.dist(ends["a"][:2], ends["c"][:2])
    path, metres, total, said = hand_path(ends["a"][:2], ends["b"][:2], stops, pixels, grid, how)
    assert said == {"reached": generate.REACHED, "long": generate.TOO_LONG, "volume": generate.NO_VOLUME, "stops": generate.NO_STOPS}[status]
    row = got["a"]
    assert (row.destination, row.status, row.stops, row.n) == ("b", said, len(path), 1)
    assert row.chain == " → ".join(["a", *path, "b"]) and row.volume == pytest.approx(total)
    assert row.length_km * 1000 == pytest.approx(metres + math.dist(stops[path[-1]], ends["b"][:2]))
    assert [round(p.lat, 9) for p in row.points][1:-1] == [round(place(stops[k])[2], 9) for k in path]
    assert "c" not in got  # it stands at its destination


@pytest.mark.parametrize("copies", [5, 60])
def test_a_path_meets_places_not_stops(spark, monkeypatch, copies):
    """Few places of many stops, and a gap before the goal: the path goes to and fro until the stops or its length run out. A task gets a row a place."""
    spots = [(400.0, 1500.0), (800.0, 1500.0), (1200.0, 1500.0), (1200.0, 1900.0), (1600.0, 1700.0)]
    stops = {f"s{(k * 37) % 1000:03d}": spots[k % 5] for k in range(5 * copies)}
    ends = {"a": (0.0, 1500.0, 9.0), "b": (9000.0, 1400.0, 5.0)}
    grid = generate.Grid(west=-500.0, north=3500.0, width=100.0, height=80.0)
    pixels = {(r, c): float((r * 7 + c * 3) % 11) for r in range(50) for c in range(30)}
    how = generate.Growth(first_radius=500.0, last_radius=1100.0, step=200.0, corridor_m=300.0)
    place = lambda p: (p[0], p[1], 51 + p[1] / 111000, 39 + p[0] / 70000)
    frame = spark.createDataFrame([(k, *place(p)) for k, p in stops.items()], "key string, x double, y double, lat double, lon double")
    found = spark.createDataFrame([(k, *place(p), p[2]) for k, p in ends.items()], "key string, x double, y double, lat double, lon double, volume double")
    found = numbered(found, "rank", generate.F.desc("volume"), "key")
    cells = spark.createDataFrame([(r, c, x) for (r, c), x in pixels.items()], "row_no long, col_no long, raw_value double")
    met, grow = spark.sparkContext.accumulator(0), generate.grow
    monkeypatch.setattr(generate, "grow", lambda *a: (met.add(len(a[2])), grow(*a))[1])
    row = generate.generate_routes(frame, found, cells, grid, 1, how).first()
    path, metres, total, said = hand_path(ends["a"][:2], ends["b"][:2], stops, pixels, grid, how)
    assert said == (generate.NO_STOPS if copies == 5 else generate.TOO_LONG) and max(path.count(k) for k in path) == 1
    assert (row.status, row.stops, row.chain) == (said, len(path), " → ".join(["a", *path, "b"]))
    assert row.volume == pytest.approx(total) and row.length_km * 1000 == pytest.approx(metres + math.dist(stops[path[-1]], ends["b"][:2]))
    assert met.value == len(spots)


def test_places_keep_the_least_keys(spark):
    rows = spark.createDataFrame([(f"k{k}", float(k % 2), 0.0, 51.0, 39.0) for k in range(9)], "key string, x double, y double, lat double, lon double")
    got = {r.x: r["keys"] for r in generate.places(rows, 3).collect()}
    assert got == {0.0: ["k0", "k2", "k4"], 1.0: ["k1", "k3", "k5"]}
    assert {len(r["keys"]) for r in generate.places(rows, None).collect()} == {4, 5}
    assert generate.visits(generate.Growth(least_step=0.0)) is None and generate.visits(generate.Growth(longest_m=90.0, least_step=30.0)) >= 2


def test_stop_rows_of_generated_routes_are_read_once(spark, monkeypatch):
    from transitloom.plans import registry, surrogate

    folder, read = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0)
    rows = surrogate.Views(spark, folder).stops_seq.count()
    spark.udf.register("counted_name", lambda name: (read.add(1), name)[1])
    text = f"SELECT route_id, di, seq, stop_id, counted_name(stop_name) AS stop_name, lat, lon FROM ({surrogate.SPARK['stops_seq']}) AS rows_of_stops"
    monkeypatch.setitem(surrogate.SPARK, "stops_seq", text)
    registry.QUERIES["gen5_generated_routes"](spark, folder).collect()
    assert read.value == rows


def test_terminals_are_matched_beyond_the_busiest(spark):
    """The best terminals lie together; a destination far away comes after all of them. Origins run out and begin again."""
    rows = [(f"t{k:02d}", float(k), 0.0, 100.0 - k) for k in range(40)] + [("z", 9000.0, 0.0, 1.0)]
    found = numbered(spark.createDataFrame(rows, "key string, x double, y double, volume double"), "rank", generate.F.desc("volume"), "key")
    stops = spark.createDataFrame([(0.0, 0.0), (10000.0, 0.0)], "x double, y double")
    assert generate.matched(stops, found, 3) == [(1, "t00", "z"), (2, "t01", "t00"), (3, "t02", "t00")]
    assert [n for _, n, _ in generate.matched(stops, found, 43)][-3:] == ["z", "t00", "t00"]
    assert generate.matched(stops, found.where("rank = 1"), 3) == [] and generate.matched(stops, found, 0) == []
    with pytest.raises(ValueError):
        generate.matched(stops, found, -1)


def test_weighted_removals_equal_the_rule(spark):
    def rule(edges, volume, distance, w):
        live = {}
        for a, b, k in edges:
            live.setdefault(a, {})[b] = live.setdefault(b, {})[a] = k
        out = []
        while live:
            v, d = max(volume.get(n, 0.0) for n in live), max(distance.get(n, 0.0) for n in live)
            score = lambda n: (1 - w) * (volume.get(n, 0.0) / v if v else 0) - w * (distance.get(n, 0.0) / d if d else 0)  # noqa: E731, B023
            node = min(live, key=lambda n: (score(n), -max(live[n].values()), n))
            gone = live.pop(node)
            for o in gone:
                del live[o][node]
                if not live[o]:
                    del live[o]
            out.append((node, len(gone), min(gone, key=lambda o: (-gone[o], o))))
        return out

    def check(edges, volume, distance, w):
        frame = spark.createDataFrame(edges, "x long, y long, kmax double")
        volumes, distances = (spark.createDataFrame(list(x.items()), f"node long, {c} double") for x, c in ((volume, "volume"), (distance, "distance")))
        got = overlap.removals_weighted(frame, volumes, distances, 0.5, w).orderBy("step").collect()
        assert [(r.node, r.partners, r.representative) for r in got] == rule(edges, volume, distance, w)
        return [r.node for r in got]

    assert check([(1, 2, 0.9), (3, 4, 0.9)], {1: 0.0, 2: 1000.0, 3: 10.0, 4: 1.0}, {1: 100.0, 2: 0.0, 3: 6.0, 4: 5.0}, 0.5) == [1, 4]
    rng = random.Random(8)
    for w in (0.2, 0.7, 1.0):
        pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(50)}
        edges = [(a, b, rng.choice([0.6, 0.7, 0.8, 0.95])) for a, b in sorted(pairs)]
        check(edges, {n: float(rng.randrange(6)) for n in range(20)}, {n: float(rng.randrange(5)) for n in range(25)}, w)


def test_prefix_sums_with_holes(spark):
    rng = random.Random(2)
    cells = {(r, c): float(rng.randrange(9)) for r in range(3, 15) for c in range(-4, 9) if rng.random() < 0.4}
    pixels = spark.createDataFrame([(0, r, c, x) for (r, c), x in cells.items()], "tile_id int, row_no long, col_no long, raw_value double")
    got = {(r.row_no, r.col_no): r.total for r in raster.prefix_sums(pixels).collect()}
    assert all(got[r, c] == sum(x for (a, b), x in cells.items() if a <= r and b <= c) for r, c in got) and cells.keys() <= got.keys()
    squares = [(k, *sorted((rng.randrange(-2, 20), rng.randrange(-2, 20))), *sorted((rng.randrange(-9, 14), rng.randrange(-9, 14)))) for k in range(60)] + [(99, 5, 4, 0, 3)]
    sums = dict(raster.window_sums(pixels, spark.createDataFrame(squares, "k long, row_lo long, row_hi long, col_lo long, col_hi long"), "k").collect())
    assert sums == {k: sum(x for (r, c), x in cells.items() if a <= r <= b and d <= c <= e) for k, a, b, d, e in squares}
    assert raster.window_sums(pixels.where("false"), spark.createDataFrame([(1, 0, 1, 0, 1)], "k long, row_lo long, row_hi long, col_lo long, col_hi long"), "k").collect()[0].volume == 0


def test_long_diagonal_corridor(spark):
    """Cut into pieces it finds what the whole segment finds, without the pixels of its box."""
    points = spark.createDataFrame([(1, 0, 0, -60.0, 10.0), (1, 0, 1, -59.88, 10.2)], "route_id long, di int, seq long, lat double, lon double")
    north, west, step = -59.86, 9.98, 0.001
    rows = [(0, r, c, north - r * step, west + c * step, 1.0) for r in range(0, 160, 3) for c in range(0, 240, 3)]
    pixels = spark.createDataFrame(rows, "tile_id int, row_no long, col_no long, lat double, lon double, raw_value double")
    near = raster.planar_segment_km(raster.F.col("lat"), raster.F.col("lon"), *map(raster.F.lit, (-60.0, 10.0, -59.88, 10.2)))
    want = pixels.where(near <= 0.5).count()
    got = raster.corridor_sums(points, pixels, 500.0, north=north, west=west, step=step).first()
    assert got.pixels == want > 100


def test_union_of_overlapping_stretches(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        line = rng.randrange(3)
        a, b = sorted(rng.sample(range(0, 1000), 2))
        at = {0: lambda t: (float(t), 7.0), 1: lambda t: (3.0 * t / 5, 4.0 * t / 5), 2: lambda t: (50.0, -float(t))}[line]
        rows.append((line, float(a), float(b), *(at(a) + at(b) if k % 2 else at(b) + at(a))))
    frame = spark.createDataFrame([(x1, y1, x2, y2, math.dist((x1, y1), (x2, y2))) for _, _, _, x1, y1, x2, y2 in rows], "x1 double, y1 double, x2 double, y2 double, metres double")
    covered = sum(len({t for line, a, b, *_ in rows if line == n for t in range(int(a), int(b))}) for n in range(3))
    got = overlap.network_km(frame).first()
    assert got.unique_km * 1000 == pytest.approx(covered) and got.total_km * 1000 == pytest.approx(sum(b - a for _, a, b, *_ in rows))


def test_rows_numbered_in_an_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), k) for k in range(3000)]
    got = numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), "place", generate.F.desc("a"), "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r.place for r in got) == list(range(1, 3001))
    assert numbered(spark.createDataFrame([], "a long"), "place", "a").count() == 0


def test_batch_file_in_an_older_encoding(spark, tmp_path):
    path = tmp_path / "commands.txt"
    path.write_bytes("# список\nгород один\nгород один\n--batch x\n".encode("cp1251"))
    assert [r.command for r in files.batch_commands(spark, str(path)).collect()] == ["город один"]


def test_batch_runs_on_after_a_failure():
    done = []

    def run(command):
        if command == "bad":
            raise ValueError("no such city")
        done.append(command)

    outcomes, code = batch.run_all(["a", "bad", "b"], run)
    assert done == ["a", "b"] and code == 1 and [o.error for o in outcomes] == [None, "ValueError: no such city", None]
    assert batch.run_all([], run) == ([], 0)


def test_cached_tasks_are_not_fetched_again(spark, tmp_path):
    cache, asked = files.JsonCache(spark, str(tmp_path / "cache")), []

    def fetch(tasks):
        asked.append(sorted(r.key for r in tasks.collect()))
        return tasks.withColumn("value", F.concat(F.lit('{"k": "'), "key", F.lit('"}')))

    tasks = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    first = files.cached_or_fetched(cache, "route", tasks("a", "b"), fetch).collect()
    again = {r.key: (r.value, r.from_cache) for r in files.cached_or_fetched(cache, "route", tasks("a", "b", "c"), fetch).collect()}
    assert asked == [["a", "b"], ["c"]] and not any(r.from_cache for r in first)
    assert again == {"a": ('{"k": "a"}', True), "b": ('{"k": "b"}', True), "c": ('{"k": "c"}', False)}


def test_files_by_extension(spark, tmp_path):
    for name in ("b.tif", "a.TIFF", "c.txt", "deep/d.tif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.path.split("/")[-1] for r in files.resolved(spark, str(tmp_path), [".tif", ".tiff"]).collect()] == ["a.TIFF", "b.tif", "d.tif"]


def test_summary_of_a_network(spark):
    routes = spark.createDataFrame([(1, "5", "tram", True, None), (2, "6", "train", True, None), (3, "7", "bus", False, None), (4, "8", "bus", True, "no page"), (5, "9", "bus", True, None)], "route_id long, name string, route_type string, active boolean, error string")
    line = lambda r, di, lat, lon: [(r, di, k, lat, lon + k * 0.01) for k in range(4)]
    bent = [(5, 0, k, 51.65 + (k % 2) * 0.02, 39.15 + k * 0.002) for k in range(4)]
    points = spark.createDataFrame(line(1, 0, 51.61, 39.11) + line(1, 1, 51.61, 39.11) + line(2, 0, 51.9, 39.11) + line(3, 0, 51.62, 39.2) + bent, "route_id long, di int, seq long, lat double, lon double")
    stops = spark.createDataFrame([(r, d, k, 10 * r + k, f"S{r}{k}", 51.61, 39.11) for r, d in ((1, 0), (1, 1), (2, 0), (4, 0)) for k in range(2)], "route_id long, di int, seq long, stop_id long, stop_name string, lat double, lon double")
    pois = spark.createDataFrame([(1, "Школа", "a", 51.61, 39.12), (2, "Школа", None, 51.61, 39.12)], "poi_id long, poi_type string, name string, lat double, lon double")
    pixels = spark.createDataFrame([(0, 50, 20, 51.61, 39.12, 4000.0)], "tile_id int, row_no long, col_no long, lat double, lon double, raw_value double")
    run = Network(RunConfig("city", limits=Limits(curvilinearity=2.0), volume_buffer_m=400.0), routes, points, stops, pois, pixels)
    got = {r.measure: r.value for r in run.summary((51.6, 39.1, 51.7, 39.3), ideas=2).collect()}
    run.close()
    want = {"Маршрутов в обработке": 4, "Успешно (в отчёте)": 2, "Ошибок": 1, "Идей пассажиров": 2, "Пропущено неактивных (--active-only)": 1, "Отсечено: криволинейность": 1, "Отсечено: длина": 0, "Остановок уникальных": 4, "Конечных": 4}
    want |= {"Поездов": 0, "Трамваев": 1, "Автобусов": 0, "GHS: суммарный объём, тыс. м³": 8, "POI: суммарное value": 2000, "Маршрутный коэффициент Км": 1.5}
    assert {k: got[k] for k in want} == want
    assert got["Дедупликация: Км до"] is None and got["Плотность сети, км/км²"] == pytest.approx(got["Длина уникальной сети, км"] / (0.1 * 111 * 0.2 * 111 * math.cos(math.radians(51.65))), abs=2e-3)


def sampled_area(segments, radius, cells=1200):
    xs, ys = [x for s in segments for x in (s[0], s[2])], [y for s in segments for y in (s[1], s[3])]
    step = max(max(xs) - min(xs), max(ys) - min(ys), radius) / cells + 2 * radius / cells
    x, y = np.meshgrid(np.arange(min(xs) - radius + step / 2, max(xs) + radius, step), np.arange(min(ys) - radius + step / 2, max(ys) + radius, step))
    inside = np.zeros(x.shape, bool)
    for x1, y1, x2, y2 in segments:
        vx, vy = x2 - x1, y2 - y1
        t = np.clip(((x - x1) * vx + (y - y1) * vy) / (vx * vx + vy * vy), 0, 1)
        inside |= np.hypot(x - x1 - t * vx, y - y1 - t * vy) <= radius
    return inside.sum() * step * step


def test_corridor_areas(spark):
    """Crossing lines, streets passed twice and in part, bends, segments far shorter than the radius; of a straight one the exact area."""
    rng = random.Random(2)
    wave = [(500_000 + 20 * i + rng.uniform(-8, 8), 5_700_000 + rng.uniform(-8, 8) + 300 * math.sin(i / 9)) for i in range(120)]
    lines = {
        0: [[(0, 0), (1000, 0)]],
        1: [[(0, 0), (1000, 0), (500, 0), (1500, 0), (0, 0)]],
        2: [[(0, 0), (1000, 1000), (1000, 0), (0, 1000)], [(1000, 1000), (0, 0)]],
        3: [wave + wave[::-1]],
        4: [[(0, 0), (10, 0), (20, 1)], [(0, 0), (10, 0), (5, 5)], [(7, 7), (7, 7)]],
        5: [[(9, 9), (9, 9)]],
        **{n: [[(rng.uniform(0, 3000), rng.uniform(0, 3000)) for _ in range(12)]] for n in range(6, 10)},
    }
    points = [(n, k, i, float(x), float(y)) for n, ls in lines.items() for k, ps in enumerate(ls) for i, (x, y) in enumerate(ps)]
    segments = overlap.node_segments(spark.createDataFrame(points, "node long, line int, seq long, x double, y double"))
    got = {r.node: r.corridor_m2 for r in corridor.corridor_areas(segments, 100.0).collect()}
    assert got.keys() == lines.keys() - {5}
    assert got[0] == pytest.approx(200 * 1000 + math.pi * 10_000, rel=1e-7) and got[1] == pytest.approx(200 * 1500 + math.pi * 10_000, rel=1e-7)
    by_node = {}
    for r in segments.collect():
        by_node.setdefault(r.node, []).append((r.x1, r.y1, r.x2, r.y2))
    for node, area in got.items():
        assert area == pytest.approx(sampled_area(by_node[node], 100.0), rel=2e-3)
    with pytest.raises(ValueError):
        corridor.corridor_areas(segments, 0.0)
    assert corridor.corridor_areas(segments.where("false"), 5.0).count() == 0


def test_windows_of_a_sparse_raster(spark):
    """Pixels far apart take as many rows as their blocks; windows over many blocks, at their borders, beyond the raster and below zero."""
    rng = random.Random(6)
    pixels = {(r0 + rng.randrange(40), c0 + rng.randrange(70)): float(rng.randrange(1, 9)) for r0, c0 in ((-50, -40), (0, 0), (5000, 90_000), (3_000_000, 7)) for _ in range(60)}
    pixels[2_000, 2_000] = 4294967295.0
    frame = spark.createDataFrame([(0, r, c, v) for (r, c), v in pixels.items()], "tile_id int, row_no long, col_no long, raw_value double")
    inner, blocks = raster.block_sums(frame)
    assert inner.count() == 1024 * len({(r // 32, c // 32) for r, c in pixels}) and blocks.count() <= 6 * len(pixels)
    windows = [(-(10**7), 10**7, -(10**7), 10**7), (0, 31, 0, 31), (32, 63, 0, 31), (31, 32, 31, 64), (5, 4, 0, 9), (10**8, 10**9, 0, 5), (4990, 5100, 80_000, 99_999), (-50, 5020, -40, 90_050), (7, 7, 7, 7)]
    for _ in range(150):
        (r, c), side = rng.choice(list(pixels)), rng.choice([1, 3, 30, 64, 300, 5000])
        a, b = r - rng.randrange(side), c - rng.randrange(side)
        windows.append((a, a + rng.randrange(side), b, b + rng.randrange(side)))
    asked = spark.createDataFrame([(n, *w) for n, w in enumerate(windows)], "w long, row_lo long, row_hi long, col_lo long, col_hi long")
    got = {r.w: r.volume for r in raster.window_sums(frame, asked, "w").collect()}
    value = {k: v for k, v in pixels.items() if v <= 1e5}
    assert got == {n: sum(v for (r, c), v in value.items() if r0 <= r <= r1 and c0 <= c <= c1) for n, (r0, r1, c0, c1) in enumerate(windows)}
    assert [r.volume for r in raster.window_sums(frame.where("false"), asked.limit(1), "w").collect()] == [0.0]


def test_pyramid_keeps_the_sum(spark):
    rng = random.Random(8)
    frame = spark.createDataFrame([(0, r, c, float(rng.randrange(9))) for r in range(70) for c in range(90) if rng.random() < 0.8], "tile_id int, row_no long, col_no long, raw_value double")
    boxes = [("all", -9, 999, -9, 999), ("small", 3, 12, 5, 14), ("line", 0, 69, 4, 4), ("out", 500, 600, 0, 9)]
    rows = raster.pyramid(frame, spark.createDataFrame(boxes, "b string, row_lo long, row_hi long, col_lo long, col_hi long"), "b", 100).collect()
    pixels = frame.collect()
    levels = {r.b: r.level for r in rows}
    assert levels == {"all": 4, "small": 0, "line": 0} and all(r.scale == 2**r.level for r in rows)
    for name, r0, r1, c0, c1 in boxes:
        own = [r for r in rows if r.b == name]
        assert len(own) <= 100 and len({(r.row_no, r.col_no) for r in own}) == len(own)
        assert sum(r.raw_value for r in own) == sum(p.raw_value for p in pixels if r0 <= p.row_no <= r1 and c0 <= p.col_no <= c1)


def mollweide(lat, lon):
    t = math.radians(lat)
    for _ in range(60):
        t -= (2 * t + math.sin(2 * t) - math.pi * math.sin(math.radians(lat))) / (2 + 2 * math.cos(2 * t))
    return 2 * math.sqrt(2) / math.pi * 6378137.0 * math.radians(lon) * math.cos(t), math.sqrt(2) * 6378137.0 * math.sin(t)


def test_mollweide(spark):
    places = [(0.0, 10.0), (51.67, 39.2), (-33.0, -70.0), (84.0, 179.0), (0.0, 0.0)]
    frame = spark.createDataFrame([(n, *p, 54009) for n, p in enumerate(places)], "n int, lat double, lon double, epsg int")
    got = geo.with_projected_xy(frame).withColumn("back", F.struct(*geo.mollweide_degrees(F.col("x"), F.col("y")))).orderBy("n").collect()
    for r, (lat, lon) in zip(got, places, strict=True):
        assert (r.x, r.y) == pytest.approx(mollweide(lat, lon), abs=1e-4)
        assert tuple(r.back) == pytest.approx((lat, lon), abs=1e-9)
    poles = spark.createDataFrame([(90.0, 0.0, 54009), (-90.0, 5.0, 54009), (1.0, 1.0, 3857)], "lat double, lon double, epsg int")
    ends = geo.with_projected_xy(poles).collect()
    assert [round(r.y / (math.sqrt(2) * 6378137.0), 9) for r in ends[:2]] == [1.0, -1.0] and ends[2].x is None
    assert spark.range(1).select(geo.mollweide_degrees(F.lit(2e7), F.lit(8e6))[1].alias("x")).first().x is None


TILES = "tile_id int, epsg int, x0 double, y0 double, dx double, dy double, rows int, cols int"


def network_on_tiles(spark):
    """Four directions, one without length, over two tiles in UTM and one in Mollweide; two more tiles lie far off or nowhere."""
    rng = random.Random(12)
    points = [(r, d, k, 51.66 + 0.004 * r + rng.uniform(-0.004, 0.004), 39.18 + 0.012 * k) for r, d in ((1, 0), (1, 1), (2, 0)) for k in range(4)]
    points += [(3, 0, k, 51.67, 39.2) for k in range(2)]
    frame = spark.createDataFrame(points, "route_id long, di int, seq long, lat double, lon double")
    flat = {e: {(r.route_id, r.di, r.seq): (r.x, r.y) for r in geo.with_projected_xy(frame.withColumn("epsg", F.lit(e))).collect()} for e in (32637, 54009)}
    west, north = (min(p[0] for p in flat[32637].values()), max(p[1] for p in flat[32637].values()))
    mx, my = (min(p[0] for p in flat[54009].values()), max(p[1] for p in flat[54009].values()))
    tiles = [(1, 32637, west - 500.0, north + 500.0, 100.0, -100.0, 20, 20), (2, 32637, west + 1500.0, north + 500.0, 100.0, -100.0, 20, 30), (3, 54009, mx - 300.0, my + 300.0, 90.0, -110.0, 25, 40)]
    tiles += [(4, 32637, 0.0, 0.0, 1.0, -1.0, 30, 30), (5, 54009, 0.0, 0.0, 100.0, -100.0, 30, 30), (6, 3857, west, north, 100.0, -100.0, 30, 30), (7, None, None, None, None, None, 9, 9)]
    pixels = [(t, r, c, float(rng.choice([rng.randrange(900), -5.0, 4294967295.0, 2e5]))) for t, *_, rows, cols in tiles[:6] for r in range(rows) for c in range(cols)]
    return frame, flat, tiles, pixels


def mosaic_by_hand(flat, tiles, pixels, buffer_m):
    lines = {}
    for e, at in flat.items():
        for (r, d, k), p in sorted(at.items()):
            lines.setdefault((r, d), {}).setdefault(e, []).append(p)
    out = {}
    for key, of in lines.items():
        hits = {}
        for t, row, col, value in pixels:
            tile = next(x for x in tiles if x[0] == t)
            if t > 3 or not 0 <= value <= 1e5:
                continue
            x, y = tile[2] + (col + 0.5) * tile[4], tile[3] + (row + 0.5) * tile[5]
            for (x1, y1), (x2, y2) in zip(of[tile[1]], of[tile[1]][1:]):
                size = (x2 - x1) ** 2 + (y2 - y1) ** 2
                s = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / size)) if size else None
                if s is not None and math.hypot(x - x1 - s * (x2 - x1), y - y1 - s * (y2 - y1)) <= buffer_m:
                    hits[t, row, col] = value
                    break
        if any(a != b for a, b in zip(of[32637], of[32637][1:])):
            out[key] = (sum(hits.values()), len(hits), len({t for t, *_ in hits}), {t for t, *_ in hits})
    return out, lines


def test_mosaic_of_two_projections(spark, tmp_path):
    points, flat, tiles, pixels = network_on_tiles(spark)
    spark.createDataFrame(pixels, "tile_id int, row_no int, col_no int, raw_value double").write.partitionBy("tile_id").parquet(str(tmp_path / "pixels"))
    catalog = spark.createDataFrame(tiles, TILES)
    stored = spark.read.parquet(str(tmp_path / "pixels"))
    found = mosaic.mosaic_sums(points, stored, catalog, 250.0)
    want, lines = mosaic_by_hand(flat, tiles, pixels, 250.0)
    got = {(r.route_id, r.di): r for r in found.collect()}
    assert got.keys() == want.keys() == {(1, 0), (1, 1), (2, 0)}
    for key, (volume, count, n, met) in want.items():
        r = got[key]
        assert (r.volume, r.pixels, r.tiles) == (volume, count, n) and n == 3
        one = {e: sampled_area([(*a, *b) for a, b in zip(ps, ps[1:])], 250.0) for e, ps in lines[key].items()}
        assert r.corridor_m2 == pytest.approx(sum(one[next(t for t in tiles if t[0] == m)[1]] for m in met), rel=3e-3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    picked = re.search(r"PartitionFilters: \[[^\]]*tile_id#\d+ IN \(([^)]*)\)", plan)
    assert sorted(picked[1].split(",")) == ["1", "2", "3"]  # files of other tiles are not read
    single = {(r.route_id, r.di): r.corridor_m2 for r in mosaic.mosaic_sums(points, stored, catalog.where("epsg = 32637"), 250.0).collect()}
    assert single[1, 0] == pytest.approx(got[1, 0].corridor_m2 / 3, rel=0.2)  # once, not for each tile
    assert mosaic.mosaic_sums(points, stored, catalog.where("tile_id = 5"), 250.0).count() == 0
    assert mosaic.mosaic_sums(points.where("false"), stored, catalog, 250.0).count() == 0


def test_known_corridors_are_not_computed_again(spark, tmp_path, monkeypatch):
    points, _, tiles, pixels = network_on_tiles(spark)
    stored, catalog = spark.createDataFrame(pixels, "tile_id int, row_no int, col_no int, raw_value double"), spark.createDataFrame(tiles, TILES)
    asked, whole = [], mosaic.mosaic_sums
    monkeypatch.setattr(mosaic, "mosaic_sums", lambda p, *rest: asked.append(sorted({(r.route_id, r.di) for r in p.collect()})) or whole(p, *rest))
    cache = mosaic.CorridorCache(spark, str(tmp_path / "cache"))
    show = lambda rows: sorted((r.route_id, r.di, r.volume, r.pixels, r.tiles, round(r.corridor_m2, 3)) for r in rows.collect())
    first = show(cache.sums(points, stored, catalog, 250.0, ["a.tif"]))
    assert [x[:2] for x in first] == [(1, 0), (1, 1), (2, 0), (3, 0)] and first[3][2:] == (0.0, 0, 0, 0.0) and len(asked) == 1
    assert [x for x in first if x[3]] == show(whole(points, stored, catalog, 250.0))
    assert show(cache.sums(points, stored, catalog, 250.0, ["a.tif"])) == first and len(asked) == 1  # no pixel is read
    moved = points.withColumn("lat", F.when(F.col("route_id") == 2, F.col("lat") + 0.001).otherwise(F.col("lat")))
    cache.sums(moved, stored, catalog, 250.0, ["a.tif"]).collect()
    assert asked[1:] == [[(2, 0)]]
    cache.sums(points, stored, catalog, 250.0, ["b.tif"]).collect()
    assert len(asked) == 3 and len(asked[2]) == 4
    small = cache.table.compacted(str(tmp_path / "small"))
    assert small.rows().count() == cache.table.rows().count() == 9


def test_passes_equal_a_run_from_scratch(spark, tmp_path):
    """Three passes: the last removes nothing, the figures of what is left are those of a network without what was removed."""
    street = lambda r, d, lat, n: [(r, d, k, lat, 39.11 + 0.003 * k) for k in range(n)]
    rows = street(1, 0, 51.61, 12) + street(1, 1, 51.6101, 9) + street(2, 0, 51.6102, 12) + street(3, 0, 51.65, 6) + street(3, 1, 51.65, 5) + street(4, 0, 51.63, 8)
    points = spark.createDataFrame(rows, "route_id long, di int, seq long, lat double, lon double")
    routes = spark.createDataFrame([(r, str(r), "bus", True, None) for r in range(1, 5)], "route_id long, name string, route_type string, active boolean, error string")
    stops = spark.createDataFrame([], "route_id long, di int, seq long, stop_id long, stop_name string, lat double, lon double")
    pois = spark.createDataFrame([], "poi_id long, poi_type string, name string, lat double, lon double")
    pixels = spark.createDataFrame([(0, r, c, 51.66 - r * 0.001, 39.10 + c * 0.001, float((r * 7 + c * 3) % 50)) for r in range(60) for c in range(60)], "tile_id int, row_no long, col_no long, lat double, lon double, raw_value double")
    config = lambda **more: RunConfig("city", limits=Limits(), volume_buffer_m=200.0, **more)
    asked = []

    class Watched(Network):
        def _corridors(self, points):
            asked.append(sorted({(r.route_id, r.di) for r in points.collect()}))
            return super()._corridors(points)

    run = Watched(config(dedup=True, dedup_passes=3), routes, points, stops, pois, pixels)
    removed = [(r.step, r["pass"], r.node) for r in run.removed.orderBy("step").collect()]
    assert [s for s, *_ in removed] == list(range(1, len(removed) + 1)) and {p for _, p, _ in removed} == {1} and len(removed) >= 2
    once = Network(config(dedup=True), routes, points, stops, pois, pixels)
    assert [n for *_, n in removed] == [r.node for r in once.removed.orderBy("step").collect()]
    left = {(r.route_id, r.di) for r in run.points.select("route_id", "di").distinct().collect()}
    show = lambda df: sorted((r.route_id, r.di, r.volume, r.pixels, round(r.corridor_m2, 2)) for r in df.collect())
    scratch = Network(config(), routes, run.points, stops, pois, pixels)
    assert show(run.corridors_after) == show(scratch.corridors) and {x[:2] for x in show(run.corridors_after)} == left
    titles = run.workbook(str(tmp_path / "r.xlsx"), (51.6, 39.1, 51.7, 39.3))
    assert titles == ["Сводка", "Маршруты", "Ошибки", "Дедупликация"] and len(sheets_of(tmp_path / "r.xlsx")["Дедупликация"]) == 1 + len(removed)
    gone = {n // 65536 for *_, n in removed}
    assert len(asked) == 2 and {r for r, _ in asked[1]} <= gone and not any(4 == r for r, _ in asked[1])
    for one in (run, once, scratch):
        one.close()
    with pytest.raises(ConfigError):
        config(dedup_passes=0)


def sheets_of(path):
    with zipfile.ZipFile(path) as z:
        space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet")]
        cell = lambda c: c.findtext(f"{space}v") or c.findtext(f"{space}is/{space}t")
        rows = [[[cell(c) for c in r] for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{n}.xml")).iter(f"{space}row")] for n in range(1, len(titles) + 1)]
    return dict(zip(titles, rows, strict=True))


def test_workbook(spark, tmp_path, monkeypatch):
    path = tmp_path / "report.xlsx"
    frame = spark.createDataFrame([(k, f"<{k} & \x01co>", k / 2 if k % 3 else None, k % 2 == 0) for k in range(500)], "n long, name string, half double, even boolean").repartition(7)
    none = frame.where("false")
    one = workbook.Sheet
    assert workbook.write_workbook([one("Main", frame, (F.desc("n"),)), one("None", none), one("Errors", none, optional=False)], str(path)) == ["Main", "Errors"]
    got = sheets_of(path)
    assert list(got) == ["Main", "Errors"] and got["Errors"] == [["n", "name", "half", "even"]]
    assert got["Main"][1:3] == [["499", "<499 & co>", "249.5", "0"], ["498", "<498 & co>", None, "1"]] and [int(r[0]) for r in got["Main"][1:]] == list(range(499, -1, -1))
    before = path.read_bytes()
    broken = frame.withColumn("name", F.when(F.col("n") == 250, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        workbook.write_workbook([one("Main", frame), one("Other", broken)], str(path))
    monkeypatch.setattr(workbook, "MOST_ROWS", 400)
    with pytest.raises(ValueError, match="500 rows"):
        workbook.write_workbook([one("Main", frame)], str(path))
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["report.xlsx"]


def test_error_block(spark):
    rows = [(k, str(k), "tram", "bad" if k else "ok", f"e{k}") for k in range(8)]
    states = spark.createDataFrame(rows, "route_id long, name string, route_type string, state string, error string")
    lines = files.error_block(states).first().text.split("\n")
    assert lines[0] == "⚠ Ошибки (7):" and len(lines) == 6 and lines[1].endswith(" 1: e1")
    assert files.error_block(states.where("state = 'ok'")).first().text == ""


def test_command_line(spark, tmp_path, capsys):
    with pytest.warns(DeprecationWarning):
        args = cli.parse_arguments(["kyiv", "--clean-names", "--dedup-strategy", "old", "--type", "tram,bus", "--no-type", "train", "--dedup", "--dedup-passes", "2", "--radius", "5", "-w", "3", "--dedup-strategy=x"])
    config = cli.configured(args)
    assert (config.city, config.include, config.exclude, config.dedup_passes) == ("kiev", {"tram", "bus"}, {"train"}, 2)
    assert config.limits == Limits(2.0, 0.0, 5.0) and config.limits.where is None and config.volume_buffer_m == 800.0
    for wrong in (["--dedup-passes", "0"], ["--workers", "0"], ["--format", " , "], ["--ghs", "--ghs-buffer", "0"], ["--type", "tram", "--no-type", "tram"], ["--type", "rocket"], ["--ghs-s", "--ghs-s-max", "-1"]):
        with pytest.raises(ConfigError):
            cli.configured(cli.parse_arguments(["x", *wrong]))
    with pytest.raises(SystemExit, match="tables"):
        cli.main(["x"])


def test_command_line_runs_a_batch(spark, tmp_path, capsys):
    points, _, tiles, pixels = network_on_tiles(spark)
    tables = {
        "routes": spark.createDataFrame([(1, "1", "bus", True, None), (2, "2", "tram", True, None), (9, "9", "bus", True, "lost")], "route_id long, name string, route_type string, active boolean, error string"),
        "points": points,
        "stops": spark.createDataFrame([(1, 0, 0, 5, "A", 51.66, 39.18), (1, 0, 1, 6, "B", 51.67, 39.2)], "route_id long, di int, seq long, stop_id long, stop_name string, lat double, lon double"),
        "pois": spark.createDataFrame([], "poi_id long, poi_type string, name string, lat double, lon double"),
        "pixels": spark.createDataFrame(pixels, "tile_id int, row_no int, col_no int, raw_value double"),
        "tiles": spark.createDataFrame(tiles, TILES),
    }
    for name, frame in tables.items():
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "batch.txt").write_text(f"# two runs\nkiev --tables {tmp_path} --format xlsx --curv 0 --stops -o {tmp_path}/one.xlsx --cache-dir {tmp_path}/cache --ghs-buffer 250\nkiev --dedup-passes 0\n", encoding="utf-8")
    assert cli.main(["--batch", str(tmp_path / "batch.txt")]) == 1
    out = capsys.readouterr().out
    assert "done: kiev --tables" in out and "failed: kiev --dedup-passes 0 (ConfigError" in out and "⚠ Ошибки (1):" in out
    found = sheets_of(tmp_path / "one.xlsx")
    assert list(found)[:3] == ["Сводка", "Маршруты", "Ошибки"] and "Остановки" in found and len(found["Маршруты"]) == 4
    assert mosaic.CorridorCache(spark, str(tmp_path / "cache" / "corridors")).table.rows().count() == 3

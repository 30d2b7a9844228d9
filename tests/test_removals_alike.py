"""Removals among directions of one shape: the order of the loop, with no pair of directions made."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import greedy

from transitloom.config import Limits, RunConfig
from transitloom.operators import overlap
from transitloom.plans.network import Network


@pytest.mark.parametrize("seed, kinds, grouped", [(1, 1, 0), (2, 3, 100), (5, 3, 0), (6, 1, 100)])
def test_classes_go_as_their_nodes_would(spark, monkeypatch, seed, kinds, grouped):
    monkeypatch.setattr(overlap, "GROUPED_EDGES", grouped)
    rng = random.Random(seed)
    ids = list(range(60))
    rng.shuffle(ids)
    members, rest = {}, ids
    while rest:
        n = rng.choice([1, 1, 2, 4, 7])
        members[min(rest[:n])], rest = sorted(rest[:n]), rest[n:]
    shape = {n: s for s, of in members.items() for n in of}
    ks = [0.3, 0.5, 0.6, 0.7, 1 - 1e-15, 1.0]
    k_of = {(a, b): rng.choice(ks) for a in members for b in members if a < b and rng.random() < 0.3} | {(s, s): rng.choice([1.0, 1 - 1e-15]) if seed > 1 else 1.0 for s, of in members.items() if len(of) > 1}
    by_shape, by_node = {s: float(rng.randrange(kinds)) for s in members}, {n: float(rng.randrange(kinds)) for n in ids}
    volume = {n: by_node[n] if seed == 5 else by_shape[shape[n]] for n in ids if shape[n] % 5}
    edges = [(a, b, k_of[key]) for a in ids for b in ids if a < b and (key := (min(shape[a], shape[b]), max(shape[a], shape[b]))) in k_of]
    alike = spark.createDataFrame([(x, y, k) for (x, y), k in k_of.items()], "x long, y long, kmax double")
    rows = spark.createDataFrame(list(shape.items()), "node long, shape long")
    volumes = spark.createDataFrame(list(volume.items()) or [(-1, 1.0)], "node long, volume double")
    for active in (None, [n for n in ids if n % 4]):
        left = None if active is None else spark.createDataFrame([(n,) for n in active], "node long")
        got = overlap.removals_alike(alike, rows, volumes, 0.4, left)
        want = greedy([e for e in edges if active is None or e[0] in active and e[1] in active], volume, 0.4)
        assert [(r.node, r.partners, r.representative) for r in got.orderBy("step").collect()] == want
        plain = overlap.removals(spark.createDataFrame(edges, "x long, y long, kmax double"), volumes, 0.4, left)
        assert {(r.step, r.node, r.volume, r.best) for r in got.collect()} == {(r.step, r.node, r.volume, r.best) for r in plain.collect()}
        if active is None:
            told = overlap.closed_with(spark.createDataFrame(edges, "x long, y long, kmax double"), got, 0.4)
            assert {(r.node, r.closed) for r in told.collect()} == {(r.node, r.closed) for r in plain.collect()}


def copied(spark, copies=6):
    points = [(r + 10 * c, 0, k, 51.6 + 0.0004 * r, 39.11 + 0.003 * k) for r in range(3) for c in range(copies) for k in range(8 + r)]
    routes = [(r + 10 * c, str(r), "bus", True, None) for r in range(3) for c in range(copies)]
    pixels = [(0, r, c, 51.66 - r * 0.001, 39.10 + c * 0.001, float((r * 7 + c * 3) % 50)) for r in range(60) for c in range(60)]
    return (
        spark.createDataFrame(routes, "route_id long, name string, route_type string, active boolean, error string"),
        spark.createDataFrame(points, "route_id long, di int, seq long, lat double, lon double"),
        spark.createDataFrame([], "route_id long, di int, seq long, stop_id long, stop_name string, lat double, lon double"),
        spark.createDataFrame([], "poi_id long, poi_type string, name string, lat double, lon double"),
        spark.createDataFrame(pixels, "tile_id int, row_no long, col_no long, lat double, lon double, raw_value double"),
    )


def test_passes_make_no_pair_of_copies(spark, monkeypatch):
    made, step = [], overlap._of_nodes
    monkeypatch.setattr(overlap, "_of_nodes", lambda *args: made.append(1) or step(*args))
    run = Network(RunConfig("city", limits=Limits(), volume_buffer_m=200.0, dedup=True, dedup_passes=3), *copied(spark))
    found = run._passes[0].collect()
    assert not made and len(found) > 10
    pairs = run.overlaps.select("x", "y", "kmax").collect()
    volume = {r.node: r.volume for r in run.corridors.select((F.col("route_id") * 65536 + F.col("di")).alias("node"), "volume").collect()}
    want = greedy([tuple(r) for r in pairs], volume, 0.7)
    assert [(r.node, r.partners, r.representative) for r in sorted(found, key=lambda r: r.step)] == want
    closed = {r.node: r.closed for r in run.removed.collect()}
    assert all(len(closed[n].split(", ")) == partners for n, partners, _ in want) and run.removed.columns == ["node", "volume", "partners", "representative", "best", "closed", "pass", "step"]
    assert "Generate" not in run.removed.select("step", "node")._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001


def test_report_counts_pairs_without_making_them(spark, monkeypatch):
    run = Network(RunConfig("city", limits=Limits(), volume_buffer_m=200.0, dedup=True), *copied(spark))
    want = {name: rows.count() for name, rows in run.sheets().items()}
    monkeypatch.setattr(overlap, "_of_nodes", lambda pairs, *args: pairs.where(F.raise_error(F.lit("a pair of copies is made")).isNotNull()))
    assert {r.measure: r.value for r in run.sizes().collect()} == want and want["overlaps"] == 18 * 17 / 2

"""Removals among very many equals and around very large hubs."""

import time

from transitloom.operators import overlap


def test_copies_are_settled_in_few_rounds(spark, monkeypatch):
    """Cliques of equal nodes with equal edges take two rounds, not one a node, and no group."""
    monkeypatch.setattr(overlap, "GROUPED_EDGES", 0)
    monkeypatch.setattr(overlap, "ROUNDS", 3)
    monkeypatch.setattr(overlap, "components", lambda *args: (_ for _ in ()).throw(AssertionError("edges are left to groups")))
    edges = [(a + 100 * c, b + 100 * c, 1.0) for c in range(2) for a in range(20) for b in range(a + 1, 20)]
    volumes = spark.createDataFrame([(n + 100 * c, 7.0) for c in range(2) for n in range(20)], "node long, volume double")
    got = overlap.removals(spark.createDataFrame(edges, "x long, y long, kmax double"), volumes, 0.7).orderBy("step").collect()
    assert [(r.node, r.partners, r.representative) for r in got] == [(n + 100 * c, 19 - n, n + 1 + 100 * c) for c in range(2) for n in range(19)]


def test_weighted_removals_around_a_hub(spark):
    """A hub's largest edge is not looked for among all of its edges at each removal."""
    leaves = 100_000
    edges = spark.range(1, leaves + 1).selectExpr("0L AS x", "id AS y", "0.8D + (id % 7) / 100.0D AS kmax")
    nodes = spark.range(leaves + 1)
    began = time.monotonic()
    got = overlap.removals_weighted(edges, nodes.selectExpr("id AS node", "CASE WHEN id = 0 THEN 1e9D ELSE double(id) END AS volume"), nodes.selectExpr("id AS node", "1.0D AS distance"), 0.7, 0.3)
    rows = got.orderBy("step").select("node", "representative").collect()
    assert [tuple(r) for r in rows] == [(n, 0) for n in range(1, leaves + 1)]
    assert time.monotonic() - began < 40

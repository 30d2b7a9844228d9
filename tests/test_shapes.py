"""Directions of one shape: the costly steps see each shape once, and all directions get its results."""

import pytest
from pyspark.sql import functions as F

from transitloom.operators import corridor, nearby, overlap, raster, shapes
from transitloom.plans import registry

COPIES = 5


def lines(spark):
    """Two streets 60 m apart and one far away, each passed by five directions."""
    rows = [(s * 100 + n, 0, k, 51.6 + (0.0005 * s if s < 2 else 0.05), 39.1 + 0.002 * k) for s in range(3) for n in range(COPIES) for k in range(3 + s)]
    return spark.createDataFrame(rows, "route_id long, di int, seq long, lat double, lon double")


def segments(spark):
    flat = lines(spark).select(F.col("route_id").alias("node"), F.lit(0).alias("line"), "seq", (F.col("lon") * 69000).alias("x"), (F.col("lat") * 111000).alias("y"))
    return overlap.node_segments(flat)


@pytest.fixture
def seen(monkeypatch):
    """How many groups got to a step."""
    found = []

    def watch(module, name, by, at=0):
        step = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *args: found.append(args[at].select(*by).distinct().count()) or step(*args))
        return found

    return watch


def test_overlaps_compare_shapes_once(spark, seen):
    found = seen(overlap, "candidate_segments", ["node"])
    pairs = overlap.overlap_pairs(segments(spark), 100.0).collect()
    near = [n + s * 100 for s in range(2) for n in range(COPIES)]
    far = [200 + n for n in range(COPIES)]
    want = {(a, b) for group in (near, far) for a in group for b in group if a < b}
    assert found == [3] and len(pairs) == len(want) and {(r.x, r.y) for r in pairs} == want
    own = {r.node: r.m for r in segments(spark).groupBy("node").agg(F.sum("metres").alias("m")).collect()}
    for r in pairs:
        assert (r.len_x, r.len_y) == (own[r.x], own[r.y])
        assert r.k_xy == pytest.approx(1.0) and r.k_yx == pytest.approx(1.0 if r.y // 100 != 1 or r.x // 100 == 1 else (276 + (100**2 - 55.5**2) ** 0.5) / 414, abs=1e-6)
    row = overlap.overlap_summary(segments(spark), 100.0).first()
    assert (row.pairs, row.excess) == (len(want), sum(r.excess for r in pairs))
    both = {(a, b) for x, y in want for a, b in ((x, y), (y, x))}
    assert sorted((r.node, r.other) for r in overlap.candidates(segments(spark), 100.0).collect()) == sorted(both)
    assert sorted((r.node, r.other) for r in overlap.covered_lengths(segments(spark), 100.0).collect()) == sorted(both)


def test_corridors_are_measured_once_a_shape(spark, seen):
    found = seen(corridor, "_cells", ["node"])
    areas = {r.node: r.corridor_m2 for r in corridor.corridor_areas(segments(spark), 50.0).collect()}
    assert set(found) == {3} and len(areas) == 3 * COPIES
    for node, area in areas.items():
        assert area == pytest.approx(100 * 138 * (2 + node // 100) + 3.141592653589793 * 2500, rel=1e-6)


def test_corridor_sums_are_shared(spark, seen):
    found = seen(raster, "segments", ["route_id"])
    pixels = spark.createDataFrame([(0, r, c, 51.66 - r / 1000, 39.1 + c / 1000, 1.0) for r in range(50, 64) for c in range(12)], "tile_id int, row_no long, col_no long, lat double, lon double, raw_value double")
    sums = {r.route_id: (r.volume, r.pixels) for r in raster.corridor_sums(lines(spark), pixels, 200.0).collect()}
    assert found == [3] and len(sums) == 2 * COPIES and len({sums[n] for n in range(COPIES)}) == 1


def test_pois_meet_places_and_shapes_once(spark, seen):
    found = seen(nearby, "segments", ["route_id"])
    pois = spark.createDataFrame([(n, "ab"[n % 2], 51.6001 + (0.05 if n % 4 == 3 else 0), 39.101) for n in range(12)], "poi_id long, poi_type string, lat double, lon double")
    hits = nearby.near_segments(pois, lines(spark), 100.0)
    want = {(p, s * 100 + n) for p in range(12) for s in range(3) for n in range(COPIES) if (s == 2) == (p % 4 == 3)}
    got = [(r.poi_id, r.route_id) for r in hits.collect()]
    assert found == [3] and len(got) == len(want) and set(got) == want
    assert {r.poi_id for r in nearby.near_any(pois, lines(spark), 100.0).collect()} == set(range(12))
    for by in (["route_id"], ["route_id", "di"]):
        stats = {r.route_id: (r["count"], r.total_value, r.by_type) for r in nearby.near_stats(pois, lines(spark), 100.0, by).collect()}
        value = 1000 / 6
        assert len(stats) == 3 * COPIES and stats[0][0] == 9 and stats[0][1] == pytest.approx(9 * value) and stats[204][2] == {"b": 3}


def test_shapes_differ_by_their_order(spark):
    rows = [(1, 0, 1.0), (1, 1, 2.0), (2, 5, 1.0), (2, 9, 2.0), (3, 0, 2.0), (3, 1, 1.0), (4, 0, 1.0)]
    groups = shapes.alike(spark.createDataFrame(rows, "node long, seq long, x double"), ["node"], ["seq"], ["x"])
    assert {r.node: r.first.node for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def supplier_copies(folder, spark, suppliers):
    """Suppliers whose directions are of two shapes, and as many customers in five places beside them."""
    columns = "id * 180 AS s_suppkey, 1L AS s_nationkey, 1D AS s_acctbal"
    spark.range(suppliers).selectExpr(*columns.split(", ")).write.parquet(f"{folder}/supplier.parquet")
    spark.range(suppliers).selectExpr("id * 5600 * 9 + element_at(array(595, 742, 921, 1474, 1621), int(id % 5) + 1) AS c_custkey", "'a' AS c_mktsegment", "'b' AS c_name").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name, bytes_a_row", [("g10_matrix", 1.0), ("j8_candidates", 0.6), ("j7_pois_near_directions", 1.0)])
def test_rows_of_pairs_come_in_runs(spark, tmp_path, name, bytes_a_row):
    """All columns but one stay the same for a run, and the runs repeat, so that files of very many pairs stay small."""
    made = registry.QUERIES[name](spark, supplier_copies(tmp_path / "in", spark, 300))
    made.write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.distinct().count() >= 90_000
    assert sum(f.stat().st_size for f in files) < bytes_a_row * rows.count()


@pytest.mark.parametrize("name", ["g2_overlap_pairs", "g3_route_overlap", "g10_matrix", "j10_covered_lengths"])
def test_figures_are_computed_before_pairs_are_made(spark, tmp_path, name):
    plan = registry.QUERIES[name](spark, supplier_copies(tmp_path / "in", spark, 10))._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    above = plan[: plan.index("Generate")]
    assert "round(" not in above and "CASE" not in above


@pytest.mark.parametrize("blocks, runs", [(3, 2), (2048, 256)])
def test_all_members_meet_across_blocks_and_runs(spark, monkeypatch, blocks, runs):
    monkeypatch.setattr(shapes, "BLOCK", blocks)
    monkeypatch.setattr(shapes, "RUN", runs)
    pairs = [(r.x, r.y) for r in overlap.overlap_pairs(segments(spark), 100.0).collect()]
    groups = ([n + s * 100 for s in range(2) for n in range(COPIES)], [200 + n for n in range(COPIES)])
    assert sorted(pairs) == sorted((a, b) for g in groups for a in g for b in g if a < b)
    pois = spark.createDataFrame([(n, 51.6001, 39.101) for n in range(7)], "poi_id long, lat double, lon double")
    hits = [(r.poi_id, r.route_id) for r in nearby.near_segments(pois, lines(spark), 100.0).collect()]
    assert sorted(hits) == sorted((p, r) for p in range(7) for r in groups[0])

"""Queries of overlap analysis, removals and merges of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry, network, overlap
from .register import Register
from .surrogate import Views

REGISTER = Register()
BUFFER_M, K_DEL = 100.0, 0.7

_SEG = """pt AS (SELECT route_id * 2 + di AS node, seq, (lon - 39.1) * 111000.0 * cos(radians(51.6)) AS x, (lat - 51.6) * 111000.0 AS y FROM v_points),
seg AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS metres FROM (SELECT node, seq, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2 FROM pt WINDOW w AS (PARTITION BY node ORDER BY seq)) WHERE x1 IS NOT NULL)"""
_PAIRS = f"""{_SEG}, pr AS (SELECT a.node, a.seq, b.node AS other, b.seq AS bseq, a.metres, b.metres AS len, a.x2 - a.x1 AS ax, a.y2 - a.y1 AS ay, b.x2 - b.x1 AS bx, b.y2 - b.y1 AS bw,
 a.x1 - b.x1 AS px, a.y1 - b.y1 AS py, a.x1 - b.x2 AS qx, a.y1 - b.y2 AS qy
 FROM seg a JOIN seg b ON a.node <> b.node AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) + 100 AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 100
 AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) + 100 AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 100),
rt AS (SELECT *, pow(px*ax+py*ay, 2) - (ax*ax+ay*ay)*(px*px+py*py-10000.0) AS dp, pow(qx*ax+qy*ay, 2) - (ax*ax+ay*ay)*(qx*qx+qy*qy-10000.0) AS dq, ax*ax+ay*ay AS aa,
 (px*bx+py*bw)/len AS s0, (ax*bx+ay*bw)/len AS s1, (px*bw-py*bx)/len AS d0, (ax*bw-ay*bx)/len AS d1 FROM pr),
sl AS (SELECT *,
 CASE WHEN abs(s1) < 1e-12 THEN CASE WHEN s0 BETWEEN 0 AND len THEN -1e18 ELSE 1e18 END ELSE least(-s0/s1, (len-s0)/s1) END AS u0,
 CASE WHEN abs(s1) < 1e-12 THEN CASE WHEN s0 BETWEEN 0 AND len THEN 1e18 ELSE -1e18 END ELSE greatest(-s0/s1, (len-s0)/s1) END AS u1,
 CASE WHEN abs(d1) < 1e-12 THEN CASE WHEN d0 BETWEEN -100 AND 100 THEN -1e18 ELSE 1e18 END ELSE least((-100-d0)/d1, (100-d0)/d1) END AS w0,
 CASE WHEN abs(d1) < 1e-12 THEN CASE WHEN d0 BETWEEN -100 AND 100 THEN 1e18 ELSE -1e18 END ELSE greatest((-100-d0)/d1, (100-d0)/d1) END AS w1 FROM rt),
sp AS (SELECT node, seq, other, bseq, metres, dp >= 0 AS there, (-(px*ax+py*ay)-sqrt(greatest(0.0, dp)))/aa AS t0, (-(px*ax+py*ay)+sqrt(greatest(0.0, dp)))/aa AS t1 FROM sl
 UNION ALL SELECT node, seq, other, bseq, metres, dq >= 0, (-(qx*ax+qy*ay)-sqrt(greatest(0.0, dq)))/aa, (-(qx*ax+qy*ay)+sqrt(greatest(0.0, dq)))/aa FROM sl
 UNION ALL SELECT node, seq, other, bseq, metres, greatest(u0, w0) <= least(u1, w1), greatest(u0, w0), least(u1, w1) FROM sl),
iv AS (SELECT node, seq, other, bseq, metres, min(greatest(0.0, t0)) AS t0, max(least(1.0, t1)) AS t1 FROM sp WHERE there AND greatest(0.0, t0) <= least(1.0, t1) GROUP BY ALL HAVING max(least(1.0, t1)) > min(greatest(0.0, t0))),
fr AS (SELECT node, other, metres * greatest(0.0, t1 - greatest(t0, coalesce(max(t1) OVER (PARTITION BY node, other, seq ORDER BY t0, t1, bseq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))) AS fresh FROM iv),
cov AS (SELECT node, other, sum(fresh) AS covered FROM fr GROUP BY ALL),
ln AS (SELECT node, sum(metres) AS metres FROM seg GROUP BY ALL),
k AS (SELECT node, other, least(1.0, greatest(0.0, covered / metres)) AS k FROM cov JOIN ln USING (node)),
k2 AS (SELECT least(node, other) AS x, greatest(node, other) AS y, coalesce(max(k) FILTER (node < other), 0.0) AS k_xy, coalesce(max(k) FILTER (node > other), 0.0) AS k_yx FROM k GROUP BY ALL)"""


def _segments(v: Views) -> DataFrame:
    points = geometry.local_xy(v.points, 51.6, 39.1).select((F.col("route_id") * 2 + F.col("di")).alias("node"), F.lit(0).alias("line"), "seq", "x", "y")
    return overlap.node_segments(points)


def _volumes(v: Views) -> DataFrame:
    return v.ghs.select("node", "volume")


@REGISTER("j8_candidates", f"WITH {_SEG} SELECT DISTINCT a.node, b.node AS other FROM seg a JOIN seg b ON a.node <> b.node AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) + 100 AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 100 AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) + 100 AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 100")
def _(v: Views) -> DataFrame:
    return overlap.candidates(_segments(v), BUFFER_M)


@REGISTER("j9_overlapping_boxes", f"WITH {_SEG}, bx AS (SELECT node, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS x1, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS y1 FROM seg GROUP BY ALL) SELECT node, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM bx")
def _(v: Views) -> DataFrame:
    lo, hi = lambda c: F.round(F.min(F.least(c + "1", c + "2")), 6), lambda c: F.round(F.max(F.greatest(c + "1", c + "2")), 6)
    return _segments(v).groupBy("node").agg(lo("x").alias("x0"), hi("x").alias("x1"), lo("y").alias("y0"), hi("y").alias("y1"))


@REGISTER("j10_covered_lengths", f"WITH {_PAIRS} SELECT node, other, round(covered, 4) AS covered FROM cov")
def _(v: Views) -> DataFrame:
    return overlap.covered_lengths(_segments(v), BUFFER_M, 4)


@REGISTER("g2_overlap_pairs", f"WITH {_PAIRS} SELECT x, y, round(k_xy, 6) AS k_xy, round(k_yx, 6) AS k_yx, round(greatest(k_xy, k_yx), 6) AS kmax, greatest(k_xy, k_yx) > 0.7 AS excess, CASE WHEN greatest(k_xy, k_yx) > 0.7 THEN 'избыточное' ELSE 'допустимое' END AS status FROM k2 WHERE greatest(k_xy, k_yx) > 0")
def _(v: Views) -> DataFrame:
    found, blocks = overlap.shape_overlaps(_segments(v), BUFFER_M, K_DEL)
    return overlap.pairs_of_nodes(found.select("x", "y", *[F.round(c, 6).alias(c) for c in ("k_xy", "k_yx", "kmax")], "excess", "status"), blocks)


@REGISTER("g1_overlap_summary", f"WITH {_PAIRS} SELECT count(*) AS pairs, count_if(greatest(k_xy, k_yx) > 0.7) AS excess FROM k2 WHERE greatest(k_xy, k_yx) > 0")
def _(v: Views) -> DataFrame:
    return overlap.overlap_summary(_segments(v), BUFFER_M, K_DEL)


@REGISTER("g3_route_overlap")
def _(v: Views) -> DataFrame:
    points = geometry.local_xy(v.points, 51.6, 39.1).select(F.col("route_id").alias("node"), F.col("di").alias("line"), "seq", "x", "y")
    found, blocks = overlap.shape_overlaps(overlap.node_segments(points), BUFFER_M, K_DEL)
    return overlap.pairs_of_nodes(found.select("x", "y", F.round("kmax", 6).alias("kmax"), "excess"), blocks)


# the surrogate's streets run along parallels: a line is its y, a stretch an interval of x; every second route's stretches are moved by
# half a step, so that they overlap in part
_UNION = f"""{_SEG}, moved AS (SELECT y1, least(x1, x2) + CASE WHEN node % 4 < 2 THEN 50 ELSE 0 END AS a, greatest(x1, x2) + CASE WHEN node % 4 < 2 THEN 50 ELSE 0 END AS b FROM seg),
cut AS (SELECT y1, a AS x FROM moved UNION SELECT y1, b FROM moved), part AS (SELECT y1, x AS p, lead(x) OVER (PARTITION BY y1 ORDER BY x) AS q FROM cut),
u AS (SELECT sum(q - p) AS metres FROM part WHERE EXISTS (SELECT 1 FROM moved m WHERE m.y1 = part.y1 AND m.a <= p AND m.b >= q)), w AS (SELECT sum(b - a) AS metres FROM moved)"""


def _moved(v: Views) -> DataFrame:
    by = F.when(F.col("node") % 4 < 2, 50).otherwise(0)
    return _segments(v).withColumns({"x1": F.col("x1") + by, "x2": F.col("x2") + by})


@REGISTER("ag12_network_km", f"WITH {_UNION} SELECT round(w.metres / 1000, 4) AS total_km, round(u.metres / 1000, 4) AS unique_km, round(w.metres / u.metres, 4) AS coefficient FROM u, w")
def _(v: Views) -> DataFrame:
    return overlap.network_km(_moved(v)).select(*[F.round(c, 4).alias(c) for c in ("total_km", "unique_km", "coefficient")])


@REGISTER("ag19_density", f"WITH {_UNION} SELECT round(u.metres / 1000 / ((51.8 - 51.6) * 111.0 * (39.3 - 39.1) * 111.0 * cos(radians((51.8 + 51.6) / 2))), 3) AS density FROM u")
def _(v: Views) -> DataFrame:
    return overlap.network_km(_moved(v)).select(network.density(F.col("unique_km"), (51.6, 39.1, 51.8, 39.3)).alias("density"))


_E = "e AS (SELECT x, y, kmax FROM v_edges WHERE kmax > 0.7), b AS (SELECT x AS node, y AS other, kmax FROM e UNION ALL SELECT y, x, kmax FROM e)"
_G = f"""{_E}, vb AS (SELECT b.*, coalesce(a.volume, 0.0) AS v, coalesce(o.volume, 0.0) AS ov FROM b LEFT JOIN v_ghs a ON a.node = b.node LEFT JOIN v_ghs o ON o.node = b.other),
vic AS (SELECT node, v AS volume, count(*) AS partners, min_by(other, (-kmax, other)) AS representative, max(kmax) AS best,
 string_agg(CAST(other AS VARCHAR) || ' (' || printf('%.3f', kmax) || ')', ', ' ORDER BY -kmax, other) AS closed FROM vb WHERE ov > v GROUP BY ALL)"""


@REGISTER("j14_both_ways", f"WITH {_E} SELECT node, other, kmax FROM b")
def _(v: Views) -> DataFrame:
    return overlap.both_ways(v.edges.where("kmax > 0.7"))


@REGISTER("g7_clean_edges", f"WITH {_E} SELECT x, y, kmax FROM e")
def _(v: Views) -> DataFrame:
    return overlap.clean_edges(v.edges, K_DEL)


@REGISTER("ag14_excess_scores", f"WITH {_E}, s AS (SELECT node, sum(kmax) AS score, count(*) AS partners FROM b GROUP BY ALL) SELECT node, round(score, 6) AS score, partners, round(score / max(score) OVER (), 6) AS relative FROM s")
def _(v: Views) -> DataFrame:
    out = overlap.excess_scores(v.edges, K_DEL)
    return out.select("node", F.round("score", 6).alias("score"), "partners", F.round("relative", 6).alias("relative"))


def _removed(v: Views) -> DataFrame:
    return overlap.removals(v.edges, _volumes(v), K_DEL)


@REGISTER("g4_removals", f"WITH {_G} SELECT row_number() OVER (ORDER BY volume, node) AS step, node, volume, partners, representative, best FROM vic")
def _(v: Views) -> DataFrame:
    return _removed(v).drop("closed")


@REGISTER("g9_removal_records", f"WITH {_G} SELECT node, representative, round(best, 3) AS best, closed FROM vic")
def _(v: Views) -> DataFrame:
    return _removed(v).select("node", "representative", F.round("best", 3).alias("best"), "closed")


@REGISTER("o6_removal_order", f"WITH {_G} SELECT node, row_number() OVER (ORDER BY volume, node) AS step FROM vic")
def _(v: Views) -> DataFrame:
    return _removed(v).select("node", "step")


@REGISTER("o7_representatives", f"WITH {_G} SELECT node, representative FROM vic")
def _(v: Views) -> DataFrame:
    return _removed(v).select("node", "representative")


@REGISTER("g4_removals_tied")
def _(v: Views) -> DataFrame:
    return overlap.removals(v.edges, v.ghs.select("node", F.col("volume_tied").alias("volume")), K_DEL)


@REGISTER("g5_removals_weighted")
def _(v: Views) -> DataFrame:
    distances = v.ghs.select("node", (F.col("node") % 37).cast("double").alias("distance"))
    return overlap.removals_weighted(v.edges, _volumes(v), distances, K_DEL, 0.3)


@REGISTER("g8_residual", f"WITH {_G} SELECT count(*) AS edges FROM e WHERE x NOT IN (SELECT node FROM vic) AND y NOT IN (SELECT node FROM vic)")
def _(v: Views) -> DataFrame:
    left = overlap.survivors(overlap.both_ways(v.edges), _removed(v))
    return overlap.residual_edges(v.edges, K_DEL, left).agg(F.count("*").alias("edges"))


@REGISTER("j5_apply_removals", f"WITH {_G} SELECT p.route_id, count(DISTINCT p.di) AS directions FROM v_points p WHERE p.route_id * 2 + p.di NOT IN (SELECT node FROM vic) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    nodes = v.points.select("route_id", "di", (F.col("route_id") * 2 + F.col("di")).alias("node")).distinct()
    return overlap.survivors_of(nodes, _removed(v)).groupBy("route_id").agg(F.count("*").alias("directions"))


@REGISTER("ag21_affected_routes", f"WITH {_G} SELECT DISTINCT node // 2 AS route_id FROM vic")
def _(v: Views) -> DataFrame:
    return _removed(v).select(F.expr("node div 2").alias("route_id")).distinct()


@REGISTER("g11_network_after", f"WITH {_G}, {_SEG} SELECT round(sum(metres) / 1000, 6) AS total_km FROM seg WHERE node NOT IN (SELECT node FROM vic)")
def _(v: Views) -> DataFrame:
    left = _segments(v).join(_removed(v).select("node"), "node", "left_anti")
    return overlap.network_km(left).select(F.round("total_km", 6).alias("total_km"))


@REGISTER("j4_unit_volumes", "SELECT DISTINCT route_id, di, volume FROM v_points JOIN v_ghs ON node = route_id * 2 + di")
def _(v: Views) -> DataFrame:
    units = v.points.select("route_id", "di", (F.col("route_id") * 2 + F.col("di")).alias("node")).distinct()
    return units.join(_volumes(v), "node").select("route_id", "di", "volume")


@REGISTER("j2_stat_fallback", "SELECT DISTINCT p.route_id, p.di, coalesce(d.volume, r.volume) AS volume FROM v_points p LEFT JOIN v_ghs d ON d.node = p.route_id * 2 + p.di AND d.volume < 50000 LEFT JOIN v_ghs r ON r.node = p.route_id")
def _(v: Views) -> DataFrame:
    units = v.points.select("route_id", "di", (F.col("route_id") * 2 + F.col("di")).alias("node")).distinct()
    own = _volumes(v).where("volume < 50000").withColumnRenamed("volume", "own")
    route = _volumes(v).select(F.col("node").alias("route_id"), "volume")
    return units.join(own, "node", "left").join(route, "route_id", "left").select("route_id", "di", F.coalesce("own", "volume").alias("volume"))


@REGISTER("j15_merge_stats", "SELECT node, volume_tied AS volume FROM v_ghs WHERE volume > 50000 UNION ALL SELECT node, volume FROM v_ghs WHERE volume <= 50000")
def _(v: Views) -> DataFrame:
    fresh = v.ghs.where("volume > 50000").select("node", F.col("volume_tied").alias("volume"))
    return overlap.merge_stats(_volumes(v), fresh, fresh.select("node"), ["node"])


@REGISTER("g10_matrix", f"WITH {_PAIRS}, m AS (SELECT x, y, round(greatest(k_xy, k_yx), 3) AS k FROM k2 WHERE greatest(k_xy, k_yx) > 0) SELECT x AS node, y AS other, k FROM m UNION ALL SELECT y, x, k FROM m UNION ALL SELECT node, node, 1.0 FROM ln")
def _(v: Views) -> DataFrame:
    return overlap.matrix_of_nodes(*overlap.shape_overlaps(_segments(v), BUFFER_M, K_DEL))

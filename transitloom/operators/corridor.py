"""Areas of corridors: the union of all points within a distance of a node's lines, each counted once.

The union is one of capsules, one around each segment. Its area is an integral along its boundary, and the boundary is what
other capsules leave of each capsule's two edges and two end arcs. Segments that may touch meet by grid cells; what one capsule
covers of another's four pieces is a few intervals, by Arrow batches; a window over a piece's intervals
finds its gaps, and their integrals are added up per node. No geometry is ever held whole.

Capsules that coincide in part, as on a street that is passed twice or at a bend, would cover each other's boundary there or
not at all, so each has a radius of its own, larger by ``SPREAD`` of it at most, by a hash of its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from . import shapes
from .overlap import CELL_BUFFERS, _cells

SPREAD = 1e-8
_ENDS = ["x1", "y1", "x2", "y2"]


def capsules(segments: DataFrame, radius_m: float) -> DataFrame:
    """node, x1, y1, x2, y2, r: every segment once, whichever way it runs, with its own radius."""
    back = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    ends = [F.when(back, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(_ENDS, ["x2", "y2", "x1", "y1"], strict=True)]
    share = F.pmod(F.xxhash64(*_ENDS), F.lit(1 << 20)) / float(1 << 20)
    return segments.where("metres > 0").select("node", *ends).distinct().withColumn("r", radius_m * (1 + SPREAD * share))


def _line_in_capsule(a: tuple, b: tuple, ends: tuple, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From and to which share of the way from a to b a point is in the capsule; from > to if none is."""
    (ax, ay), (vx, vy) = a, (b[0] - a[0], b[1] - a[1])
    x1, y1, x2, y2 = ends
    size = vx * vx + vy * vy
    lo, hi = np.full(len(r), np.inf), np.full(len(r), -np.inf)

    def add(ok: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        np.minimum(lo, np.where(ok, first, np.inf), out=lo)
        np.maximum(hi, np.where(ok, last, -np.inf), out=hi)

    for px, py in ((x1, y1), (x2, y2)):
        fx, fy = ax - px, ay - py
        half = fx * vx + fy * vy
        disc = half * half - size * (fx * fx + fy * fy - r * r)
        root = np.sqrt(np.maximum(disc, 0))
        add(disc >= 0, (-half - root) / size, (-half + root) / size)
    length = np.hypot(x2 - x1, y2 - y1)
    ux, uy = (x2 - x1) / length, (y2 - y1) / length
    first, last = np.full(len(r), -np.inf), np.full(len(r), np.inf)
    for at, step, least, most in ((ux * (ax - x1) + uy * (ay - y1), ux * vx + uy * vy, 0.0, length), (ux * (ay - y1) - uy * (ax - x1), ux * vy - uy * vx, -r, r)):
        still = np.abs(step) < 1e-12
        t1, t2 = (least - at) / np.where(still, 1, step), (most - at) / np.where(still, 1, step)
        inside = (at >= least) & (at <= most)
        first = np.maximum(first, np.where(still, np.where(inside, -np.inf, np.inf), np.minimum(t1, t2)))
        last = np.minimum(last, np.where(still, np.where(inside, np.inf, -np.inf), np.maximum(t1, t2)))
    add(first <= last, first, last)
    return np.maximum(lo, 0.0), np.minimum(hi, 1.0)


def _arc_in_capsule(centre: tuple, radius: np.ndarray, start: np.ndarray, ends: tuple, r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Intervals, as shares of the half circle from the angle start on, of what is in the capsule; empty ones have from >= to."""
    px, py = centre
    x1, y1, x2, y2 = ends
    none = np.full(len(r), -1.0)
    found = []
    for cx, cy in ((x1, y1), (x2, y2)):
        d = np.hypot(cx - px, cy - py)
        whole = d + radius <= r
        meets = ~whole & (d < radius + r) & (radius < d + r)
        safe = np.where(meets, d, 1.0)
        wide = np.arccos(np.clip((safe * safe + radius * radius - r * r) / (2 * safe * radius), -1, 1))
        towards = np.arctan2(cy - py, cx - px)
        found.append((np.where(whole, start, towards - wide), np.where(whole, 2 * np.pi, np.where(meets, 2 * wide, none))))
    length = np.hypot(x2 - x1, y2 - y1)
    ux, uy = (x2 - x1) / length, (y2 - y1) / length
    along, across, turn = ux * (px - x1) + uy * (py - y1), ux * (py - y1) - uy * (px - x1), np.arctan2(uy, ux)
    cos_lo, cos_hi, sin_lo, sin_hi = -along / radius, (length - along) / radius, (-r - across) / radius, (r - across) / radius
    there = (cos_lo <= 1) & (cos_hi >= -1) & (sin_lo <= 1) & (sin_hi >= -1)
    c0, c1 = np.arccos(np.clip(cos_hi, -1, 1)), np.arccos(np.clip(cos_lo, -1, 1))
    s0, s1 = np.arcsin(np.clip(sin_lo, -1, 1)), np.arcsin(np.clip(sin_hi, -1, 1))
    sides = [((c0, c1), (s0, s1)), ((c0, c1), (np.pi - s1, np.pi - s0)), ((-c1, -c0), (s0, s1)), ((-c1, -c0), (-np.pi - s1, -np.pi - s0))]
    for (a0, a1), (b0, b1) in sides:
        lo, hi = np.maximum(a0, b0), np.minimum(a1, b1)
        found.append((lo + turn, np.where(there, hi - lo, none)))
    for lo, width in found:
        at = np.mod(lo - start, 2 * np.pi)
        some = width > 0
        yield np.where(some, at / np.pi, 1.0), np.where(some, np.minimum((at + width) / np.pi, 1.0), 0.0)
        yield np.zeros(len(r)), np.where(some, np.minimum((at + width - 2 * np.pi) / np.pi, 1.0), 0.0)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of capsules: the intervals of the first one's pieces (right edge, second end, left edge, first end) in the second one."""
    for batch in batches:
        x1, y1, x2, y2, r, *other = (batch.column(c).to_numpy() for c in [*_ENDS, "r", *(f"b_{c}" for c in _ENDS), "b_r"])
        *ends, b_r = other
        length = np.hypot(x2 - x1, y2 - y1)
        nx, ny = -(y2 - y1) / length * r, (x2 - x1) / length * r
        parts = [
            (0, [_line_in_capsule((x1 - nx, y1 - ny), (x2 - nx, y2 - ny), ends, b_r)]),
            (1, _arc_in_capsule((x2, y2), r, np.arctan2(-ny, -nx), ends, b_r)),
            (2, [_line_in_capsule((x2 + nx, y2 + ny), (x1 + nx, y1 + ny), ends, b_r)]),
            (3, _arc_in_capsule((x1, y1), r, np.arctan2(ny, nx), ends, b_r)),
        ]
        for piece, intervals in parts:
            for lo, hi in intervals:
                some = np.flatnonzero(hi - lo > 1e-15)
                if len(some):
                    own = batch.select(["node", *_ENDS, "r"]).take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(some), piece, np.int32)), pa.array(lo[some]), pa.array(hi[some])], [*own.schema.names, "piece", "lo", "hi"])


def _integral(piece: Column, lo: Column, hi: Column) -> Column:
    """Half the integral of x dy - y dx along a part of a piece."""
    x1, y1, x2, y2, r = (F.col(c) for c in [*_ENDS, "r"])
    length = F.hypot(x2 - x1, y2 - y1)
    nx, ny = (y1 - y2) / length * r, (x2 - x1) / length * r
    right, left = ((x1 - nx) * (y2 - y1) - (y1 - ny) * (x2 - x1)), ((x2 + nx) * (y1 - y2) - (y2 + ny) * (x1 - x2))
    start = F.when(piece == 1, F.atan2(-ny, -nx)).otherwise(F.atan2(ny, nx))
    cx, cy = F.when(piece == 1, x2).otherwise(x1), F.when(piece == 1, y2).otherwise(y1)
    a, b = start + lo * F.pi(), start + hi * F.pi()
    arc = r * cx * (F.sin(b) - F.sin(a)) - r * cy * (F.cos(b) - F.cos(a)) + r * r * (b - a)
    return F.when(piece == 0, right * (hi - lo)).when(piece == 2, left * (hi - lo)).otherwise(arc) / 2


def corridor_areas(segments: DataFrame, radius_m: float) -> DataFrame:
    """node, corridor_m2: the area within the radius of any of a node's segments ``(node, x1, y1, x2, y2, metres)``.

    Segments without length have no corridor; a node without others is not in the result.
    """
    if radius_m <= 0:
        raise ValueError("radius_m must be above 0")
    groups = shapes.alike(segments, ["node"], ["seg"], _ENDS)
    return shapes.for_all(written(_areas(shapes.firsts(segments, groups, ["node"]), radius_m), "areas"), groups, ["node"])


def _areas(segments: DataFrame, radius_m: float) -> DataFrame:
    """As ``corridor_areas``, node by node."""
    own = capsules(segments, radius_m)
    cell = radius_m * CELL_BUFFERS * 1.001  # capsules touch within two radii
    placed = _cells(own, cell, 0).select("node", "cx", "cy", *_ENDS, "r")
    near = _cells(own, cell, 1).select("node", "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in [*_ENDS, "r"]))
    # cells are many more than their table's size tells, so neither side is sent to every executor
    pairs = placed.join(near.hint("merge"), ["node", "cx", "cy"]).drop("cx", "cy")
    lo, hi = lambda p, c: F.least(p + c + "1", p + c + "2"), lambda p, c: F.greatest(p + c + "1", p + c + "2")
    for c in "xy":
        pairs = pairs.where((lo("", c) <= hi("b_", c) + 2.001 * radius_m) & (lo("b_", c) <= hi("", c) + 2.001 * radius_m))
    same = (F.col("x1") == F.col("b_x1")) & (F.col("y1") == F.col("b_y1")) & (F.col("x2") == F.col("b_x2")) & (F.col("y2") == F.col("b_y2"))
    kind = segments.schema["node"].dataType.simpleString()
    columns = ", ".join(f"{c} double" for c in [*_ENDS, "r"])
    covered = pairs.where(~same).distinct().mapInArrow(_covered, f"node {kind}, {columns}, piece int, lo double, hi double")
    ends = own.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("piece"), F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"))
    before = Window.partitionBy("node", *_ENDS, "r", "piece").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    gaps = covered.unionByName(ends).withColumn("reached", F.coalesce(F.max("hi").over(before), F.lit(0.0))).where("lo > reached")
    return gaps.groupBy("node").agg(F.sum(_integral(F.col("piece"), F.col("reached"), F.col("lo"))).alias("corridor_m2"))

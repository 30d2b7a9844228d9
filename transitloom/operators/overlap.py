"""Overlap of directions, and which to remove.

points: ``(node, line, seq, x, y)`` in metres; a node is what is compared (a direction, or a whole route
with its directions as lines). All of it is grid joins, windows and grouped sums; ties in the removal order take rounds.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import numbered, written
from . import shapes
from .graph import components

#: Metres between the cells of the candidate grid, in buffers; cells that a piece of a segment may be long.
CELL_BUFFERS, PIECE_CELLS = 2.0, 16


def node_segments(points: DataFrame) -> DataFrame:
    """node, seg, x1, y1, x2, y2, metres: pieces with a length."""
    order = Window.partitionBy("node", "line").orderBy("seq")
    before = points.withColumns({"x1": F.lag("x").over(order), "y1": F.lag("y").over(order)}).where("x1 IS NOT NULL")
    metres = F.sqrt(F.pow(F.col("x") - F.col("x1"), 2) + F.pow(F.col("y") - F.col("y1"), 2))
    named = before.select("node", F.struct("line", "seq").alias("seg"), "x1", "y1", F.col("x").alias("x2"), F.col("y").alias("y2"), metres.alias("metres"))
    return named.where("metres > 0")


def _cells(segments: DataFrame, cell: float, reach: int) -> DataFrame:
    """Segments with the cells of their boxes, ``reach`` cells wider; long ones piece by piece."""
    longest = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / cell
    pieces = segments.withColumn("pieces", F.greatest(F.lit(1), F.ceil(longest / PIECE_CELLS)).cast("int"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

    def span(c: str) -> Column:
        at = lambda k: F.floor((F.col(c + "1") + (F.col(c + "2") - F.col(c + "1")) * k / F.col("pieces")) / cell)
        a, b = at(F.col("piece")), at(F.col("piece") + 1)
        return F.sequence(F.least(a, b) - reach, F.greatest(a, b) + reach)

    return pieces.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y"))).drop("pieces", "piece").distinct()


def candidate_segments(segments: DataFrame, buffer_m: float) -> DataFrame:
    """Pairs of segments that may be within the buffer, of different nodes or of one with ``copied``, if there is such a column: a's and b's columns."""
    cell = max(buffer_m, 1.0) * CELL_BUFFERS
    keep = ["node", "seg", "x1", "y1", "x2", "y2", "metres"]
    near = _cells(segments.select(keep), cell, 1).select("cx", "cy", *[F.col(c).alias("b_" + c) for c in keep])
    own = _cells(segments, cell, 0)
    apart = F.col("node") != F.col("b_node")
    # cells are many more than their table's size tells, so neither side is sent to every executor
    pairs = own.join(near.hint("merge"), ["cx", "cy"]).where(apart | F.col("copied") if "copied" in segments.columns else apart)
    lo, hi = lambda p, c: F.least(p + c + "1", p + c + "2"), lambda p, c: F.greatest(p + c + "1", p + c + "2")
    for c in "xy":
        pairs = pairs.where((lo("", c) <= hi("b_", c) + buffer_m) & (lo("b_", c) <= hi("", c) + buffer_m))
    return pairs.drop("cx", "cy", "copied").distinct()


def _shapes(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The segments of the first node of each shape, with ``copied`` where the shape has more, and (node, nodes, block, of_shape), the nodes of a shape in blocks."""
    alike = shapes.alike(segments, ["node"], ["seg"], ["x1", "y1", "x2", "y2"])
    blocks = shapes.in_blocks(alike.select(F.col("first.node").alias("shape"), "node"), ["shape"], "node", "nodes").withColumnsRenamed({"shape": "node", "of_group": "of_shape"})
    blocks = written(blocks, "nodes-of-shapes")
    copied = blocks.groupBy("node").agg((F.max("of_shape") > 1).alias("copied"))
    return segments.join(copied, "node"), blocks


def _of_nodes(pairs: DataFrame, x: str, y: str, blocks: DataFrame) -> DataFrame:
    """Pairs of shapes as pairs of their nodes, a row each; a pair of a shape with itself as its nodes' pairs both ways. Nothing follows that exchanges rows."""
    sides = [blocks.select(F.col("node").alias(s), F.col("block").alias(f"{s}_block"), F.col("nodes").alias(f"{s}_nodes")) for s in (x, y)]
    dealt = pairs
    for s, side in zip((x, y), sides, strict=True):
        dealt = dealt.join(side.drop(f"{s}_nodes"), s)
    dealt = shapes.dealt(dealt, x, y, f"{x}_block", f"{y}_block")
    met = dealt.join(sides[0], [x, f"{x}_block"]).join(sides[1], [y, f"{y}_block"])
    others = [c for c in pairs.columns if c not in (x, y)]
    return shapes.product(met, x, f"{x}_nodes", y, f"{y}_nodes", others).where(F.col(x) != F.col(y)).select(pairs.columns)


def candidates(segments: DataFrame, buffer_m: float) -> DataFrame:
    """node, other: nodes with segments that may be within the buffer."""
    firsts, blocks = _shapes(segments)
    near = candidate_segments(firsts, buffer_m).select("node", F.col("b_node").alias("other")).distinct()
    return _of_nodes(written(near, "near-shapes"), "node", "other", blocks)


def with_capsule_interval(pairs: DataFrame, r: float) -> DataFrame:
    """Pairs with t0 and t1: the part of segment a within ``r`` of segment b, as shares of a's length (null if none).

    The points within r of a segment form a convex capsule, a disk at each end and a slab between,
    so the part is one interval: from the least to the greatest parameter that is in one of the three.
    Steps are columns of their own, so that no expression is evaluated twice.
    """
    at = pairs.withColumns(
        {"ax": F.col("x2") - F.col("x1"), "ay": F.col("y2") - F.col("y1"), "bx": F.col("b_x2") - F.col("b_x1"), "by": F.col("b_y2") - F.col("b_y1")}
        | {f"p{c}{end}": F.col(c + "1") - F.col(f"b_{c}{end}") for c in "xy" for end in "12"}
    )
    # disks: |p + t a| = r; slab: along b from 0 to its length, across it from -r to r
    c, dot = F.col, lambda x, y, u, v: F.col(x) * F.col(u) + F.col(y) * F.col(v)
    at = at.withColumns(
        {"aa": dot("ax", "ay", "ax", "ay")}
        | {f"b{e}": dot(f"px{e}", f"py{e}", "ax", "ay") for e in "12"}
        | {f"c{e}": dot(f"px{e}", f"py{e}", f"px{e}", f"py{e}") - r * r for e in "12"}
        | {"along": dot("px1", "py1", "bx", "by") / c("b_metres"), "along_t": dot("ax", "ay", "bx", "by") / c("b_metres")}
        | {"across": (c("px1") * c("by") - c("py1") * c("bx")) / c("b_metres"), "across_t": (c("ax") * c("by") - c("ay") * c("bx")) / c("b_metres")}
    )
    at = at.withColumns({f"d{e}": c(f"b{e}") * c(f"b{e}") - c("aa") * c(f"c{e}") for e in "12"})
    at = at.withColumns({f"r{e}": F.sqrt(F.greatest(F.lit(0.0), c(f"d{e}"))) for e in "12"})
    steps = {}
    for name, lo, hi in (("along", F.lit(0.0), c("b_metres")), ("across", F.lit(-r), F.lit(r))):
        still = F.abs(c(name + "_t")) < 1e-12
        inside = (c(name) >= lo) & (c(name) <= hi)
        t1, t2 = (lo - c(name)) / c(name + "_t"), (hi - c(name)) / c(name + "_t")
        steps[name + "_0"] = F.when(still & inside, -1e18).when(still, 1e18).otherwise(F.least(t1, t2))
        steps[name + "_1"] = F.when(still & inside, 1e18).when(still, -1e18).otherwise(F.greatest(t1, t2))
    at = at.withColumns(steps)
    spans = {f"f{e}": F.when(c(f"d{e}") >= 0, (-c(f"b{e}") - c(f"r{e}")) / c("aa")) for e in "12"} | {f"l{e}": F.when(c(f"d{e}") >= 0, (-c(f"b{e}") + c(f"r{e}")) / c("aa")) for e in "12"}
    at = at.withColumns(spans | {"f3": F.greatest("along_0", "across_0"), "l3": F.least("along_1", "across_1")})
    at = at.withColumns({f"{k}{e}": f(F.lit(x), c(f"{k}{e}")) for e in "123" for k, f, x in (("f", F.greatest, 0.0), ("l", F.least, 1.0))})
    there = {e: c(f"f{e}") <= c(f"l{e}") if e == "3" else (c(f"d{e}") >= 0) & (c(f"f{e}") <= c(f"l{e}")) for e in "123"}
    out = {"t0": F.least(*[F.when(there[e], c(f"f{e}")) for e in "123"]), "t1": F.greatest(*[F.when(there[e], c(f"l{e}")) for e in "123"])}
    return at.select(*pairs.columns, *[x.alias(n) for n, x in out.items()])


def covered_lengths(segments: DataFrame, buffer_m: float, digits: int | None = None) -> DataFrame:
    """node, other, covered: metres of a node within the buffer of another, rounded to ``digits`` where they are given."""
    firsts, blocks = _shapes(segments)
    covered = _covered(firsts, buffer_m)
    if digits is not None:
        covered = covered.withColumn("covered", F.round("covered", digits))
    return _of_nodes(written(covered, "covered"), "node", "other", blocks)


def _covered(segments: DataFrame, buffer_m: float) -> DataFrame:
    """As ``covered_lengths``, of the nodes as they are."""
    parts = with_capsule_interval(candidate_segments(segments, buffer_m), max(0.0, buffer_m)).where("t1 > t0").select("node", "b_node", "seg", "metres", "t0", "t1")
    before = Window.partitionBy("node", "b_node", "seg").orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("t1").over(before), F.lit(0.0))
    fresh = parts.withColumn("fresh", F.greatest(F.lit(0.0), F.col("t1") - F.greatest("t0", reached)) * F.col("metres"))
    return fresh.groupBy("node", F.col("b_node").alias("other")).agg(F.sum("fresh").alias("covered"))


def shape_overlaps(segments: DataFrame, buffer_m: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """As ``overlap_pairs``, of shapes (x <= y; x = y where one has several nodes), and the blocks of their nodes."""
    if buffer_m < 0 or not 0 <= threshold <= 1:
        raise ValueError("buffer_m must not be negative and threshold must be from 0 to 1")
    firsts, blocks = _shapes(segments)
    lengths = written(firsts.groupBy("node").agg(F.sum("metres").alias("metres")), "lengths")
    ratios = written(_covered(firsts, buffer_m), "covered").join(lengths, "node").withColumn("k", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("covered") / F.col("metres"))))
    there, back = F.col("node") <= F.col("other"), F.col("node") >= F.col("other")
    both = ratios.groupBy(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).agg(
        F.coalesce(F.max(F.when(there, F.col("k"))), F.lit(0.0)).alias("k_xy"), F.coalesce(F.max(F.when(back, F.col("k"))), F.lit(0.0)).alias("k_yx")
    )
    named = both.withColumn("kmax", F.greatest("k_xy", "k_yx")).where("kmax > 0")
    for side in "xy":
        named = named.join(lengths.select(F.col("node").alias(side), F.col("metres").alias(f"len_{side}")), side)
    excess = F.col("kmax") > threshold
    columns = ["x", "y", "len_x", "len_y", "k_xy", "k_yx", "kmax", excess.alias("excess"), F.when(excess, "избыточное").otherwise("допустимое").alias("status")]
    return written(named.select(columns), "overlaps-of-shapes"), blocks


def overlap_pairs(segments: DataFrame, buffer_m: float, threshold: float = 0.7) -> DataFrame:
    """x, y (x < y), len_x, len_y, k_xy, k_yx, kmax, excess, status: pairs of nodes that cover one another in part."""
    return pairs_of_nodes(*shape_overlaps(segments, buffer_m, threshold))


def pairs_of_nodes(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """The overlaps of shapes, all columns or some, as those of their nodes, a row a pair.

    Both ways are made, as then nothing else is told of a row than whether x < y. Columns computed from ``found`` are computed once a pair of shapes.
    """
    return _of_nodes(_turned(found), "x", "y", blocks).where("x < y")


def pairs_both_ways(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """As ``pairs_of_nodes``, each pair from both ends."""
    return _of_nodes(_turned(found), "x", "y", blocks)


def _turned(found: DataFrame) -> DataFrame:
    """Pairs of shapes both ways; those of a shape with itself, once, are both ways."""
    other = {"x": "y", "y": "x", "len_x": "len_y", "len_y": "len_x", "k_xy": "k_yx", "k_yx": "k_xy"}
    return found.union(found.where("x <> y").select(*(F.col(other.get(c, c)).alias(c) for c in found.columns)))


def overlap_summary(segments: DataFrame, buffer_m: float, threshold: float = 0.7) -> DataFrame:
    """One row: how many pairs of nodes cover one another in part, and how many of them in excess."""
    return count_pairs(*shape_overlaps(segments, buffer_m, threshold))


def count_pairs(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """As ``overlap_summary``, from the overlaps of shapes and how many nodes each has."""
    sizes = blocks.select("node", "of_shape").distinct()
    for side in "xy":
        found = found.join(sizes.select(F.col("node").alias(side), F.col("of_shape").alias(f"of_{side}")), side)
    pairs = F.when(F.col("x") == F.col("y"), F.expr("of_x * (of_x - 1) div 2")).otherwise(F.col("of_x") * F.col("of_y"))
    found = found.select(pairs.alias("pairs"), F.when(F.col("excess"), pairs).otherwise(0).alias("excess"))
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "excess")))


def both_ways(pairs: DataFrame) -> DataFrame:
    """node, other, kmax: every pair from both ends."""
    return pairs.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other")))).alias("e"), "kmax").select("e.node", "e.other", "kmax")


def excess_scores(pairs: DataFrame, threshold: float) -> DataFrame:
    """node, score (sum of the shares above the threshold), partners, share of the greatest score."""
    scores = both_ways(pairs.where(F.col("kmax") > threshold)).groupBy("node").agg(F.sum("kmax").alias("score"), F.count("*").alias("partners"))
    top = scores.agg(F.max("score").alias("top"))  # one row
    return scores.join(F.broadcast(top)).select("node", "score", "partners", (F.col("score") / F.col("top")).alias("relative"))


def clean_edges(edges: DataFrame, k_del: float, active: DataFrame | None = None) -> DataFrame:
    """x < y, kmax of the edges strictly above the threshold between active nodes, each pair once with its largest value."""
    if not 0 <= k_del <= 1:
        raise ValueError("k_del must be from 0 to 1")
    one = edges.where("x <> y AND NOT isnan(kmax)").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max("kmax").alias("kmax"))
    one = one.where(F.col("kmax") > k_del)
    for side in ("x", "y") if active is not None else ():
        one = one.join(active.select(F.col("node").alias(side)).distinct(), side, "left_semi")
    return one.select("x", "y", "kmax")


#: Edges between equal volumes that are left to groups, a component each; more are worked off in rounds first, at most so many.
GROUPED_EDGES, ROUNDS = 100_000, 40


def _remove_tied(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one component of one volume: removes nodes by largest live edge, then id, while they have edges; a row an edge closed."""
    live: dict = {}
    for node, other, k in zip(rows["node"], rows["other"], rows["kmax"], strict=True):
        live.setdefault(node, {})[other] = k
    queue = [(-max(e.values()), node) for node, e in live.items()]
    heapq.heapify(queue)
    out = []
    while queue:
        k, node = heapq.heappop(queue)
        edges = live.get(node)
        if not edges:
            continue
        if -max(edges.values()) != k:
            heapq.heappush(queue, (-max(edges.values()), node))
            continue
        for other, kmax in edges.items():
            out.append((node, other, kmax))
            if other in live:
                live[other].pop(node, None)
        live.pop(node)
    return pd.DataFrame(out, columns=["node", "other", "kmax"])


def _closed_in_ties(upward: DataFrame) -> DataFrame:
    """node, other, kmax of the edges that close with their node, of nodes that have an edge to one of the same volume.

    upward: ``(node, other, kmax, tied)``, every edge from such a node to one of no less volume. A node's order is that of its largest live
    edge, then its id, and can only fall back as edges close. It is sure where it comes before all its neighbours, or where its largest edge leads
    to more volume or to a later node whose largest edge it is, too, as among copies: that edge stays till the node goes. An edge whose
    earlier end is sure closes with that end, and the other end is without it by the time that it can go. So all such edges are
    settled at once, in rounds over the edge table. What a long chain of dependencies leaves is
    run through the rule itself, a group per component.
    """
    live, closed = written(upward, "tied-edges"), None
    for _ in range(ROUNDS):
        if live.where("tied").count() <= GROUPED_EDGES:
            break
        best = written(live.groupBy("node").agg(F.max("kmax").alias("best"), F.bool_or("tied").alias("any")), "tied-best")
        valued = live.join(best, "node")
        done = valued.where("NOT any").select("node", "other", "kmax")
        closed = done if closed is None else closed.union(done)
        both = valued.where("any").join(best.select(F.col("node").alias("other"), F.col("best").alias("other_best")), "other", "left")
        earlier = (F.col("other_best") > F.col("best")) | ((F.col("other_best") == F.col("best")) & (F.col("other") < F.col("node")))
        stays = (F.col("kmax") == F.col("best")) & (~F.col("tied") | ((F.col("other_best") == F.col("best")) & (F.col("other") > F.col("node"))))
        both = both.withColumns({"earlier": F.col("tied") & earlier, "stays": stays}).select("node", "other", "kmax", "tied", "earlier", "stays")
        sure = both.groupBy("node").agg((F.bool_or("stays") | ~F.bool_or("earlier")).alias("sure")).where("sure")
        sure = written(sure, "tied-sure")
        told = both.drop("stays").join(sure, "node", "left").join(sure.withColumnsRenamed({"node": "other", "sure": "other_sure"}), "other", "left")
        left = told.where("NOT earlier OR other_sure IS NULL")
        live = written(left.select("node", "other", "kmax", (F.col("tied") & (F.col("earlier") | F.col("sure").isNull())).alias("tied")), "tied-edges")
    alone = live.groupBy("node").agg(F.bool_or("tied").alias("any")).where("NOT any")
    parts = [live.join(alone, "node", "left_semi").select("node", "other", "kmax"), *([] if closed is None else [closed])]
    if not live.where("tied").isEmpty():
        clusters = components(live.where("tied").select(F.col("node").alias("a"), F.col("other").alias("b")), "tied-components")
        parts.append(live.join(clusters, "node").groupBy("comp").applyInPandas(_remove_tied, "node long, other long, kmax double"))
    return reduce(DataFrame.union, parts)


def removals(edges: DataFrame, volumes: DataFrame, k_del: float, active: DataFrame | None = None) -> DataFrame:
    """step, node, volume, partners, representative, best, closed: the nodes to remove, in order.

    The rule, applied until no edge is left: of the nodes with an edge, the one with the least volume
    goes (of equals, the one with the largest edge, then the least id), and its edges with it. A
    node is therefore there until all of less volume are gone, and goes exactly if it has an edge
    to a node of more volume that far: with distinct volumes that is a join and a rank. Nodes of equal
    volume with an edge between them go in rounds, see ``_closed_in_ties``. As a node's order can only fall back, the
    order of the removals is that of volume, largest edge closed and id. A missing volume is 0.
    """
    both = both_ways(written(clean_edges(edges, k_del, active), "clean-edges"))
    vol = _volumes(volumes)
    valued = both.join(vol, "node", "left").join(vol.withColumnsRenamed({"node": "other", "volume": "other_volume"}), "other", "left")
    valued = valued.select("node", "other", "kmax", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("other_volume", F.lit(0.0)).alias("other_volume"))
    upward = valued.where("other_volume >= volume").withColumn("tied", F.col("other_volume") == F.col("volume"))
    closed = _closed(upward).join(vol, "node", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    victims = closed.groupBy("volume", "node").agg(F.count("*").alias("partners"), *_strongest(), _told())
    return _in_order(victims).select("step", "node", "volume", "partners", "representative", "best", "closed")


def _volumes(volumes: DataFrame) -> DataFrame:
    return volumes.groupBy("node").agg(F.coalesce(F.max(F.when(~F.isnan("volume"), F.col("volume"))), F.lit(0.0)).alias("volume"))


def _closed(upward: DataFrame) -> DataFrame:
    """node, other, kmax of the edges that close with their node, of ``(node, other, kmax, tied)``: the edges to no less volume."""
    tied = written(upward.groupBy("node").agg(F.bool_or("tied").alias("tied")).where("tied").select("node"), "tied-nodes")
    if tied.isEmpty():
        return upward.select("node", "other", "kmax")
    alone = upward.join(tied, "node", "left_anti").select("node", "other", "kmax")
    return alone.union(_closed_in_ties(upward.join(tied, "node", "left_semi").select("node", "other", "kmax", "tied")))


def _strongest() -> tuple[Column, Column]:
    """representative and best of a node's closed edges."""
    strongest = F.struct(F.col("kmax").alias("k"), (-F.col("other")).alias("id"))
    return (-F.max(strongest)["id"]).alias("representative"), F.max("kmax").alias("best")


def _told() -> Column:
    """closed: a node's closed edges as text, the strongest first."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("kmax")).alias("k"), F.col("other").alias("id"))))
    one = lambda p: F.concat(p["id"].cast("string"), F.lit(" ("), F.format_string("%.3f", -p["k"]), F.lit(")"))
    return F.array_join(F.transform(ranked, one), ", ").alias("closed")


def _in_order(victims: DataFrame) -> DataFrame:
    return numbered(written(victims, "removals"), "step", F.col("volume"), F.desc("best"), F.col("node"))


def removals_alike(edges: DataFrame, members: DataFrame, volumes: DataFrame, k_del: float, active: DataFrame | None = None) -> DataFrame:
    """As ``removals`` without the text, of nodes that ``members (node, shape)`` tells the shapes of; edges are those of shapes, as ``shape_overlaps`` finds them.

    Nodes of one shape and volume are a class: they have the same edges, and those among themselves are 1 but for rounding, so few values are
    above. A value at a time from the greatest down, of a volume's nodes those go, by id, that have an edge of that value to a node of more volume,
    or of the same that is left and has a greater id: an edge to a lesser id that was passed would have taken that one. So what is left of a class is
    its nodes from an id on, which rounds over the pairs of classes find; in the end its greatest node at most. These go
    by ``_closed``, with a row a class of more volume. No pair of nodes is made: rows are the pairs of classes, and for each pair of one volume the nodes of one of them.
    """
    if not 0 <= k_del <= 1:
        raise ValueError("k_del must be from 0 to 1")
    one = edges.where("NOT isnan(kmax)").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max("kmax").alias("kmax"))
    one = written(one.where(F.col("kmax") > k_del), "clean-edges")
    own = one.where("x = y").select(F.col("x").alias("shape"), F.col("y").alias("other_shape"), "kmax")
    nodes = members if active is None else members.join(active.select("node").distinct(), "node", "left_semi")
    # nodes of a shape without edges among themselves are a class each
    nodes = nodes.join(_volumes(volumes), "node", "left").join(own.select("shape", F.lit(0).alias("of")), "shape", "left")
    nodes = written(nodes.select("node", "shape", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("of", "node").alias("of")), "nodes-of-shapes")
    classes = nodes.groupBy("shape", "volume", "of").agg(F.min("node").alias("class"), F.count("*").alias("size"), F.max("node").alias("greatest"))
    classes = written(classes, "classes")
    nodes = written(nodes.join(classes, ["shape", "volume", "of"]).select("class", "node", "volume"), "nodes-of-classes")
    met = both_ways(one.where("x <> y")).select(F.col("node").alias("shape"), F.col("other").alias("other_shape"), "kmax").unionByName(own)
    others = classes.select(*(F.col(c).alias(f"other_{c}") for c in ("shape", "volume", "class", "size", "greatest")))
    pairs = classes.join(met, "shape").join(others, "other_shape").where("other_volume >= volume AND (class <> other_class OR size > 1)")
    pairs = pairs.select("class", "other_class", "kmax", (F.col("other_volume") == F.col("volume")).alias("tied"), "other_size", "other_greatest")
    pairs = written(pairs, "pairs-of-classes")
    # what is left of each class that has edges: its nodes from an id on
    left = pairs.select("class").distinct().join(classes.select("class", "greatest"), "class").withColumn("from", F.col("class"))
    least = pairs.where("class = other_class").agg(F.min("kmax")).first()[0]
    gone = []
    for k in [] if least is None else sorted((r.kmax for r in pairs.where(F.col("kmax") >= least).select("kmax").distinct().collect()), reverse=True):
        there = left.where("from <= greatest").select(F.col("class").alias("other_class"), F.lit(True).alias("there"))
        seen = pairs.where(F.col("kmax") == k).join(there, "other_class", "left").where("NOT tied OR there")
        till = seen.groupBy("class").agg(F.max(F.when(F.col("tied"), F.col("other_greatest"))).alias("till"), F.bool_or(~F.col("tied")).alias("all"))
        now = left.join(till, "class", "left").withColumn("to", F.when(F.col("all"), F.col("greatest") + 1).otherwise(F.greatest("from", "till")))
        now = written(now.select("class", "greatest", "from", "to"), "left-of-classes")
        gone.append(now.where("from < to").select("class", "from", "to", F.lit(k).alias("best")))
        left = now.select("class", "greatest", F.col("to").alias("from"))
    last = left.where("from <= greatest").select("class", F.col("greatest").alias("last"))
    nodes = nodes.join(pairs.select("class").union(pairs.where("tied").select(F.col("other_class").alias("class"))).distinct(), "class", "left_semi")
    if gone:
        spans = reduce(DataFrame.union, gone).groupBy("class").agg(F.collect_list(F.struct("from", "to", "best")).alias("spans"))
        own_span = F.filter("spans", lambda s: (s["from"] <= F.col("node")) & (F.col("node") < s["to"]))
        nodes = nodes.join(spans, "class", "left").select("class", "node", "volume", F.get(own_span, 0)["best"].alias("best"))
    else:
        nodes = nodes.withColumn("best", F.lit(None).cast("double"))
    nodes = written(nodes, "nodes-in-turn")
    # a class's nodes among those of the classes of its volume that it has edges to, its own among them; which of them go later
    beside = pairs.where("tied AND class <> other_class").select("class", F.col("other_class").alias("of"), "kmax").join(nodes.select(F.col("class").alias("of"), "node", "best"), "of")
    within = nodes.where("best IS NOT NULL").select("class").distinct()
    mine = nodes.join(pairs.where("class = other_class").select("class", "kmax"), "class", "left")
    rows = beside.select("class", "node", "best", "kmax", F.lit(None).cast("double").alias("volume")).unionByName(mine.select("class", "node", "best", "kmax", "volume"))
    later = Window.partitionBy("class").orderBy(F.asc_nulls_first("best"), F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.when(F.col("kmax").isNotNull(), F.struct(F.col("kmax").alias("k"), (-F.col("node")).alias("id")))
    told = rows.join(within, "class", "left_semi").select("class", "node", "best", "volume", F.count("kmax").over(later).alias("later"), F.max(edge).over(later).alias("edge"))
    above = pairs.where("NOT tied").groupBy("class").agg(F.sum("other_size").alias("above"), F.max(F.struct(F.col("kmax").alias("k"), (-F.col("other_class")).alias("id"))).alias("edge_above"))
    first = told.where("volume IS NOT NULL AND best IS NOT NULL").join(above, "class", "left")
    strongest = -F.greatest("edge", "edge_above")["id"]
    first = first.select("volume", "node", (F.coalesce("above", F.lit(0)) + F.col("later")).alias("partners"), strongest.alias("representative"), "best")
    # what is left of the classes, a node each
    upward = pairs.where("class <> other_class").join(last.withColumnRenamed("last", "node"), "class").join(last.withColumnRenamed("class", "other_class"), "other_class", "left")
    upward = upward.where("NOT tied OR last IS NOT NULL")
    upward = upward.select("node", F.when(F.col("tied"), F.col("last")).otherwise(F.col("other_class")).alias("other"), "kmax", "tied", F.when(F.col("tied"), 1).otherwise(F.col("other_size")).alias("size"))
    upward = written(upward, "upward-of-classes")
    closed = _closed(upward.drop("size")).join(upward.select("node", "other", "size"), ["node", "other"])
    then = closed.groupBy("node").agg(F.sum("size").alias("partners"), *_strongest()).join(nodes.select("node", "volume"), "node")
    return _in_order(first.unionByName(then)).select("step", "node", "volume", "partners", "representative", "best")


def closed_with(edges: DataFrame, removed: DataFrame, k_del: float) -> DataFrame:
    """node, closed: the edges that closed with each node of ``removed (step, node)``, as text; as many are read as there are pairs."""
    steps = removed.select("node", "step")
    pairs = both_ways(edges.where((F.col("kmax") > k_del) & ~F.isnan("kmax"))).join(steps, "node").join(steps.withColumnsRenamed({"node": "other", "step": "other_step"}), "other", "left")
    return pairs.where("other_step IS NULL OR other_step > step").groupBy("node").agg(_told())


def survivors(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    return nodes.select("node").distinct().join(removed.select("node"), "node", "left_anti")


def survivors_of(units: DataFrame, removed: DataFrame) -> DataFrame:
    """The units, all columns, whose node was not removed."""
    return units.join(removed.select("node"), "node", "left_anti")


def residual_edges(edges: DataFrame, k_del: float, left: DataFrame) -> DataFrame:
    """Edges above the threshold that survive: none after a full run."""
    return clean_edges(edges, k_del, left)


def removals_weighted(edges: DataFrame, volumes: DataFrame, distances: DataFrame, k_del: float, center_weight: float) -> DataFrame:
    """As ``removals``, ordered by ``(1 - w) * volume / max - w * distance / max`` over the nodes left at each step.

    The nodes left are those with an edge left. The maxima change with removals, so the order is inherently sequential: one group over the
    thresholded edges, which a network's overlaps bound. The order is kept in a heap that is made anew only when a maximum changes.
    """
    if not 0 < center_weight <= 1:
        raise ValueError("center_weight must be above 0 and at most 1")
    valued = both_ways(clean_edges(edges, k_del)).join(volumes, "node", "left").join(distances, "node", "left")
    valued = valued.select(F.lit(0).alias("all"), "node", "other", "kmax", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("distance", F.lit(0.0)).alias("distance"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        live: dict = {}
        for node, other, k in zip(rows["node"], rows["other"], rows["kmax"], strict=True):
            live.setdefault(node, {})[other] = k
        # a node's neighbours by falling edges: the first that is left has the largest
        falling = {node: sorted(edges, key=edges.__getitem__) for node, edges in live.items()}

        def largest(node: int) -> float:
            edges, others = live[node], falling[node]
            while others[-1] not in edges:
                others.pop()
            return edges[others[-1]]

        volume = dict(zip(rows["node"], rows["volume"], strict=True))
        distance = dict(zip(rows["node"], rows["distance"], strict=True))
        ranked = [sorted(live, key=of.__getitem__) for of in (volume, distance)]
        heap: list[tuple] = []
        scale = None
        out = []
        while live:
            for nodes in ranked:
                while nodes[-1] not in live:
                    nodes.pop()
            greatest = (volume[ranked[0][-1]] or 1.0, distance[ranked[1][-1]] or 1.0)
            entry = lambda n: ((1 - center_weight) * volume[n] / greatest[0] - center_weight * distance[n] / greatest[1], -largest(n), n)  # noqa: E731, B023
            if greatest != scale:
                scale, heap = greatest, [entry(n) for n in live]
                heapq.heapify(heap)
            _, strongest, node = heapq.heappop(heap)
            if node not in live or -strongest != largest(node):
                continue  # a newer entry tells of it
            gone = live.pop(node)
            for other, k in gone.items():
                del live[other][node]
                if not live[other]:
                    del live[other]
                elif k > largest(other):
                    heapq.heappush(heap, entry(other))
            out.append((len(out) + 1, node, len(gone), min(gone, key=lambda o: (-gone[o], o))))
        return pd.DataFrame(out, columns=["step", "node", "partners", "representative"])

    return valued.groupBy("all").applyInPandas(run, "step long, node long, partners long, representative long")


def overlap_matrix(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, other, k: the symmetric matrix with its unit diagonal, sparse; an export of few nodes can pivot it."""
    return _with_diagonal(both_ways(pairs).select("node", "other", F.round("kmax", 3).alias("k")), nodes)


def matrix_of_nodes(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """As ``overlap_matrix``, from the overlaps of shapes and the nodes of each; nodes without segments have no row."""
    cells = pairs_both_ways(found.select("x", "y", F.round("kmax", 3).alias("k")), blocks).withColumnsRenamed({"x": "node", "y": "other"})
    return _with_diagonal(cells, blocks.select(F.explode("nodes").alias("node")))


def _with_diagonal(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    return cells.unionByName(nodes.select("node", F.col("node").alias("other"), F.lit(1.0).alias("k")))


def unique_metres(segments: DataFrame, grid: float = 0.01, turn: float = 1e-6) -> DataFrame:
    """line, metres: the length of the union of the segments on each straight line.

    Segments lie on one line when its direction and distance from the origin agree on ``turn`` and ``grid``, whichever way they
    run. On a line equal stretches are merged first; then each adds what is beyond all that begin before it.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    back = (dx < 0) | ((dx == 0) & (dy < 0))
    ux, uy = (F.when(back, -d).otherwise(d) / F.col("metres") for d in (dx, dy))
    placed = segments.where("metres > 0").withColumns({"ux": ux, "uy": uy})
    along = [F.col("ux") * F.col(f"x{k}") + F.col("uy") * F.col(f"y{k}") for k in (1, 2)]
    line = F.struct(F.rint(F.col("ux") / turn).alias("ux"), F.rint(F.col("uy") / turn).alias("uy"), F.rint((F.col("uy") * F.col("x1") - F.col("ux") * F.col("y1")) / grid).alias("off"))
    stretches = placed.select(line.alias("line"), F.least(*along).alias("t1"), F.greatest(*along).alias("t2"))
    once = stretches.groupBy("line", F.rint(F.col("t1") / grid).alias("a"), F.rint(F.col("t2") / grid).alias("b")).agg(F.min("t1").alias("t1"), F.max("t2").alias("t2"))
    before = F.max("t2").over(Window.partitionBy("line").orderBy("t1", "t2").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col("t2") - F.greatest(F.col("t1"), F.coalesce(F.col("before"), F.col("t1"))))
    return once.withColumn("before", before).select("line", fresh.alias("fresh")).groupBy("line").agg(F.sum("fresh").alias("metres"))


def network_km(segments: DataFrame, grid: float = 0.01) -> DataFrame:
    """One row: total_km, unique_km (of the union of all segments, total_km at most), coefficient."""
    sums = segments.agg((F.sum("metres") / 1000).alias("total_km")).join(unique_metres(segments, grid).agg((F.sum("metres") / 1000).alias("unique_km")))  # a row each
    return sums.withColumn("unique_km", F.least("unique_km", "total_km")).withColumn("coefficient", F.when(F.col("unique_km") > 0, F.col("total_km") / F.col("unique_km")))


def merge_stats(stats: DataFrame, fresh: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics with those of affected keys replaced by fresh ones; affected keys without fresh ones vanish."""
    gone = affected.select(*keys).unionByName(fresh.select(*keys)).distinct()
    return stats.join(gone, keys, "left_anti").unionByName(fresh)

"""Rasters of several tiles in several projections: their catalog, and sums along directions.

tiles: ``(tile_id, epsg, x0, y0, dx, dy, rows, cols)``, a tile's projection, the outer corner of its first pixel, the steps from column to column and from
row to row, and its size. pixels: ``(tile_id, row_no, col_no, raw_value)``; a Parquet folder partitioned by tile_id is read for the
tiles that a network meets, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import MOLLWEIDE, is_utm, with_projected_xy
from ..sources.files import ResultTable, source_signature
from ..tables import written
from . import shapes
from .corridor import corridor_areas
from .geometry import DIRECTION, network_bbox, signatures
from .overlap import CELL_BUFFERS, _cells, node_segments
from .raster import GREATEST, NODATA

#: Tiles whose numbers go into the filter of the pixel files; beyond, a join alone picks them.
NAMED_TILES = 10_000


def georeferenced(tiles: DataFrame) -> DataFrame:
    """The tiles that can be placed, with their bounds: those with a transform other than the identity and a projection that is known."""
    steps = [F.col(c) for c in ("x0", "y0", "dx", "dy")]
    identity = (steps[0] == 0) & (steps[1] == 0) & (steps[2] == 1) & (F.abs(steps[3]) == 1)
    usable = F.lit(True)
    for s in steps:
        usable = usable & s.isNotNull()
    placed = tiles.where(usable & ~identity & (F.col("dx") != 0) & (F.col("dy") != 0) & (is_utm(F.col("epsg")) | (F.col("epsg") == MOLLWEIDE)))
    far = {c: F.col(f"{c}0") + F.col(f"d{c}") * F.col(n) for c, n in (("x", "cols"), ("y", "rows"))}
    bounds = {f"{c}_{e}": f(F.col(f"{c}0"), far[c]) for c in "xy" for e, f in (("lo", F.least), ("hi", F.greatest))}
    return placed.withColumns(bounds)


def tiles_meeting(tiles: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The tiles whose bounds meet a box (south, west, north, east), by the box's corners in the tile's projection."""
    south, west, north, east = box
    corners = F.array(*[F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon")) for lat in (south, north) for lon in (west, east)])
    placed = georeferenced(tiles)
    at = with_projected_xy(placed.select("tile_id", "epsg", F.inline(corners)))
    spans = at.groupBy("tile_id").agg(*[f(c).alias(f"box_{c}_{e}") for c in "xy" for e, f in (("lo", F.min), ("hi", F.max))])
    met = placed.join(spans, "tile_id")
    for c in "xy":
        met = met.where((F.col(f"{c}_lo") <= F.col(f"box_{c}_hi")) & (F.col(f"{c}_hi") >= F.col(f"box_{c}_lo")))
    return met.select(placed.columns)


def _believed(value: Column, nodata: float, greatest: float) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value != nodata) & (value >= 0) & (value <= greatest)


def mosaic_sums(points: DataFrame, pixels: DataFrame, tiles: DataFrame, buffer_m: float, nodata: float = NODATA, greatest: float = GREATEST) -> DataFrame:
    """route_id, di, volume, pixels, tiles, corridor_m2 of every direction ``(route_id, di, seq, lat, lon)`` that has a length.

    The buffer is drawn in each tile's own projection, and a tile's pixel counts whose centre is in it. Directions of the same shape share their
    sums. The area is that of the buffer where the tiles have one projection; with several it is added up over the tiles that had a pixel, each in its own projection.
    """
    names = ["route_id", "di", "volume", "pixels", "tiles", "corridor_m2"]
    box = network_bbox(points).first()  # one row
    empty = points.sparkSession.createDataFrame([], "route_id long, di int, volume double, pixels long, tiles long, corridor_m2 double")
    if box.south is None:
        return empty
    near = written(tiles_meeting(tiles, (box.south, box.west, box.north, box.east)), "near-tiles")
    epsgs = sorted(r.epsg for r in near.select("epsg").distinct().collect())  # some of 121
    if not epsgs:
        return empty
    ids = [r.tile_id for r in near.select("tile_id").limit(NAMED_TILES + 1).collect()]
    wanted = pixels.where(F.col("tile_id").isin(ids)) if len(ids) <= NAMED_TILES else pixels

    groups = shapes.alike(points, DIRECTION, ["seq"], ["lat", "lon"])
    points = shapes.firsts(points, groups, DIRECTION)
    flat = with_projected_xy(points.select(*DIRECTION, "seq", "lat", "lon", F.explode(F.array(*map(F.lit, epsgs))).alias("epsg")))
    node = F.struct(*DIRECTION, "epsg").alias("node")
    lines = node_segments(flat.select(node, F.lit(0).alias("line"), "seq", "x", "y"))
    cell = max(buffer_m, 1.0) * CELL_BUFFERS
    pieces = _cells(lines.select("node", "seg", "x1", "y1", "x2", "y2", "metres"), cell, 1).withColumn("epsg", F.col("node.epsg"))
    placed = wanted.join(near.select("tile_id", "epsg", "x0", "y0", "dx", "dy"), "tile_id").where(_believed(F.col("raw_value"), nodata, greatest))
    placed = placed.withColumns({"x": F.col("x0") + (F.col("col_no") + 0.5) * F.col("dx"), "y": F.col("y0") + (F.col("row_no") + 0.5) * F.col("dy")})
    placed = placed.select("tile_id", "epsg", "row_no", "col_no", "raw_value", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * bx + (F.col("y") - F.col("y1")) * by) / (bx * bx + by * by)))
    apart = F.hypot(F.col("x") - F.col("x1") - share * bx, F.col("y") - F.col("y1") - share * by)
    # cells are many more than their table's size tells, so they are not sent to every executor
    hits = placed.join(pieces.hint("merge"), ["epsg", "cx", "cy"]).where(apart <= buffer_m).select("node", "tile_id", "row_no", "col_no", "raw_value").distinct()
    by_tile = hits.groupBy("node", "tile_id").agg(F.sum("raw_value").alias("volume"), F.count("*").alias("pixels"))
    by_node = by_tile.groupBy("node").agg(F.sum("volume").alias("volume"), F.sum("pixels").alias("pixels"), F.count("*").alias("tiles"))
    areas = corridor_areas(lines, buffer_m) if buffer_m > 0 else lines.select("node").distinct().withColumn("corridor_m2", F.lit(0.0))
    both = areas.join(by_node, "node", "left").na.fill(0, ["pixels", "tiles"]).na.fill(0.0, ["volume"])
    area = F.max("corridor_m2") if len(epsgs) == 1 else F.sum(F.col("corridor_m2") * F.col("tiles"))
    sums = both.groupBy("node.route_id", "node.di").agg(F.sum("volume").alias("volume"), F.sum("pixels").alias("pixels"), F.sum("tiles").alias("tiles"), area.alias("corridor_m2"))
    return shapes.for_all(sums.select(names), groups, DIRECTION)


class CorridorCache:
    """Volumes and areas of directions, kept by the signatures of their geometry and of the rasters that they were made with."""

    COLUMNS = ("volume", "pixels", "tiles", "corridor_m2")

    def __init__(self, spark: SparkSession, folder: str, read: bool = True, write: bool = True):
        self.table = ResultTable(spark, folder, "volume double, pixels long, tiles long, corridor_m2 double", read, write)

    def sums(self, points: DataFrame, pixels: DataFrame, tiles: DataFrame, buffer_m: float, paths: list[str]) -> DataFrame:
        """As ``mosaic_sums``; directions whose signature is known are not computed, and if all are, no pixel is read.

        paths: the rasters' names. Directions of equal geometry share a result.
        """
        source = source_signature(F.array(*map(F.lit, paths)), F.lit(float(buffer_m)))
        keys = written(signatures(points).select(*DIRECTION, F.concat_ws("_", "signature", source).alias("key")), "corridor-keys")

        def compute(unknown: DataFrame) -> DataFrame:
            one = unknown.groupBy("key").agg(F.min(F.struct(*DIRECTION)).alias("d")).select("key", "d.*")
            found = mosaic_sums(points.join(one, DIRECTION, "left_semi"), pixels, tiles, buffer_m)
            # a direction without length, or beyond all tiles, has a result, too
            return one.join(found, DIRECTION, "left").na.fill(0, ["pixels", "tiles"]).na.fill(0.0, ["volume", "corridor_m2"])

        return self.table.of(keys, compute).select(*DIRECTION, *self.COLUMNS)

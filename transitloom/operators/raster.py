"""Rasters as pixel tables: ``(tile_id, row_no, col_no, raw_value)``, and sums of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import planar_segment_km
from ..functions.text import heat_color
from ..tables import numbered, written
from . import shapes
from .geometry import DIRECTION, segments

# What stands for no data, and the largest value that is believed.
NODATA, GREATEST = 4294967295.0, 1e5
#: Rows and columns of a piece of a segment.
PIECE = 32


def clean_value(value: Column, nodata: float = NODATA, greatest: float = GREATEST) -> Column:
    """0 for no data, nulls, what is not finite, negative or too large."""
    believed = value.isNotNull() & ~F.isnan(value) & (value != nodata) & (value >= 0) & (value <= greatest)
    return F.when(believed, value).otherwise(0.0)


def extents(pixels: DataFrame) -> DataFrame:
    """row_lo, row_hi, col_lo, col_hi of a raster: one row."""
    return pixels.agg(F.min("row_no").alias("row_lo"), F.max("row_no").alias("row_hi"), F.min("col_no").alias("col_lo"), F.max("col_no").alias("col_hi"))


def prefix_sums(pixels: DataFrame) -> DataFrame:
    """row_no, col_no, total: the sum of all values at or before a row and column, for every cell of the raster's extents.

    Two running sums, by row and by column, over the filled grid, so no task sees a whole raster. Absent pixels
    count 0; of pixels in the same place, as where tiles overlap, the values add up.
    """
    cells = pixels.groupBy("row_no", "col_no").agg(F.sum(clean_value(F.col("raw_value"))).alias("value"))
    rows = extents(pixels).select(F.explode(F.sequence("row_lo", "row_hi")).alias("row_no"), "col_lo", "col_hi")
    grid = rows.repartition("row_no").select("row_no", F.explode(F.sequence("col_lo", "col_hi")).alias("col_no"))
    along = Window.partitionBy("row_no").orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(cells, ["row_no", "col_no"], "left").fillna(0.0, ["value"])
    return filled.withColumn("along", F.sum("value").over(along)).withColumn("total", F.sum("along").over(down)).select("row_no", "col_no", "total")


#: Rows and columns of a block of pixels; the blocks of a level are so many times as wide as those of the level below, up to so many levels.
BLOCK, FANOUT, LEVELS = 32, 8, 6


def block_sums(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A summed-area table in blocks: (row_no, col_no, total) and (level, i, j, total).

    The first holds, for every cell of a block that has pixels, the sum of the block's values at or before its row and column; the second
    the sums of whole blocks, of ``BLOCK * FANOUT ** level`` rows and columns. Rows are in proportion to the blocks that have pixels.
    """
    return _block_sums(_cell_sums(pixels))


def _cell_sums(pixels: DataFrame) -> DataFrame:
    """row_no, col_no, value of every pixel's place, written: all that follows reads it several times."""
    return written(pixels.groupBy("row_no", "col_no").agg(F.sum(clean_value(F.col("raw_value"))).alias("value")), "cell-sums")


def _block_sums(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    cells = cells.withColumns({"i": F.floor(F.col("row_no") / BLOCK), "j": F.floor(F.col("col_no") / BLOCK)})
    steps = F.sequence(F.lit(0), F.lit(BLOCK - 1))
    grid = cells.select("i", "j").distinct().withColumn("r", F.explode(steps)).withColumn("c", F.explode(steps))
    grid = grid.select("i", "j", (F.col("i") * BLOCK + F.col("r")).alias("row_no"), (F.col("j") * BLOCK + F.col("c")).alias("col_no"))
    filled = grid.join(cells, ["i", "j", "row_no", "col_no"], "left").fillna(0.0, ["value"])
    along = Window.partitionBy("i", "j", "row_no").orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("i", "j", "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    inner = filled.withColumn("along", F.sum("value").over(along)).select("row_no", "col_no", F.sum("along").over(down).alias("total"))
    lowest = cells.groupBy("i", "j").agg(F.sum("value").alias("total"))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    width = F.pow(F.lit(FANOUT), F.col("level"))
    up = lowest.withColumn("level", level).select("level", *(F.floor(F.col(c) / width).alias(c) for c in "ij"), "total")
    return inner, up.groupBy("level", "i", "j").agg(F.sum("total").alias("total"))


def _around(by: str, squares: DataFrame, outer: tuple[Column, ...], inner: tuple[Column, ...], *more: str) -> DataFrame:
    """by, i, j of the cells from outer = (i_lo, i_hi, j_lo, j_hi) that are not in inner; along its edges, so to say."""
    i_lo, i_hi, j_lo, j_hi, p_lo, p_hi, q_lo, q_hi = (F.col(c) for c in ("o0", "o1", "o2", "o3", "p0", "p1", "p2", "p3"))
    named = squares.withColumns({f"{k}{n}": c for k, cs in (("o", outer), ("p", inner)) for n, c in enumerate(cs)})
    rows = named.where((i_lo <= i_hi) & (j_lo <= j_hi)).withColumn("i", F.explode(F.sequence(i_lo, i_hi)))
    none = F.array().cast("array<bigint>")
    some = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(none)
    beside = F.col("i").between(p_lo, p_hi) & (q_lo <= q_hi)
    columns = F.when(beside, F.concat(some(j_lo, q_lo - 1), some(q_hi + 1, j_hi))).otherwise(some(j_lo, j_hi))
    return rows.withColumn("j", F.explode(columns)).select(by, *more, "i", "j")


def window_sums(pixels: DataFrame, squares: DataFrame, by: str) -> DataFrame:
    """Sum of the values in each square ``(by, row_lo, row_hi, col_lo, col_hi)``, ends included; 0 outside the raster.

    A square, cut at the raster's extents, is covered by the largest blocks that lie in it, whose sums are looked up, and by parts of the blocks
    along its edge, of which the four corners are. The lookups of a square grow with its edge, not with its area.
    """
    cells = _cell_sums(pixels)
    ends = F.broadcast(extents(cells).select(*(F.col(c).alias(f"raster_{c}") for c in ("row_lo", "row_hi", "col_lo", "col_hi"))))  # one row
    cut = {c: (F.greatest if c.endswith("lo") else F.least)(F.col(c), F.col(f"raster_{c}")).cast("bigint") for c in ("row_lo", "row_hi", "col_lo", "col_hi")}
    asked = squares.select(by, "row_lo", "row_hi", "col_lo", "col_hi").join(ends).withColumns(cut).where("row_lo <= row_hi AND col_lo <= col_hi")
    asked = asked.select(by, "row_lo", "row_hi", "col_lo", "col_hi")

    def inside(width: Column) -> tuple[Column, ...]:
        """The blocks that lie in the square."""
        spans = ((F.ceil(F.col(f"{c}_lo") / width), F.floor((F.col(f"{c}_hi") + 1) / width) - 1) for c in ("row", "col"))
        return tuple(x.cast("bigint") for span in spans for x in span)

    touched = tuple(F.floor(F.col(c) / BLOCK).cast("bigint") for c in ("row_lo", "row_hi", "col_lo", "col_hi"))
    edge = _around(by, asked, touched, inside(F.lit(BLOCK)), "row_lo", "row_hi", "col_lo", "col_hi")
    parts = edge.select(
        by,
        *(f(F.col(f"{c}_{e}"), F.col(k) * BLOCK + add).alias(f"{c}_{e}") for c, k in (("row", "i"), ("col", "j")) for e, f, add in (("lo", F.greatest, 0), ("hi", F.least, BLOCK - 1))),
        (F.col("i") * BLOCK).alias("top"),
        (F.col("j") * BLOCK).alias("left"),
    )
    corners = F.array(
        *[
            F.struct(r.alias("row_no"), c.alias("col_no"), F.lit(row_sign * col_sign).alias("sign"))
            for r, row_sign in ((F.col("row_hi"), 1.0), (F.col("row_lo") - 1, -1.0))
            for c, col_sign in ((F.col("col_hi"), 1.0), (F.col("col_lo") - 1, -1.0))
        ]
    )
    looked = parts.select(by, "top", "left", F.explode(corners).alias("corner")).select(by, "top", "left", "corner.*").where("row_no >= top AND col_no >= left")
    width = F.pow(F.lit(FANOUT), F.col("level")).cast("bigint") * BLOCK
    above = tuple(F.when(F.col("level") < LEVELS - 1, x * FANOUT + add).otherwise(bound) for x, add, bound in zip(inside(width * FANOUT), (0, FANOUT - 1) * 2, (1, 0) * 2, strict=True))
    levels = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    whole = _around(by, levels, inside(width), above, "level")
    inner, blocks = _block_sums(cells)
    found = looked.join(inner, ["row_no", "col_no"]).select(by, (F.col("sign") * F.col("total")).alias("part"))
    found = found.union(whole.join(blocks, ["level", "i", "j"]).select(by, "total")).groupBy(by).agg(F.sum("part").alias("volume"))
    return squares.select(by).join(found, by, "left").select(by, F.coalesce("volume", F.lit(0.0)).alias("volume"))


def shared_window_sums(pixels: DataFrame, squares: DataFrame, by: str) -> DataFrame:
    """``window_sums`` where many squares are equal, as those of stops at one place are: each is summed once."""
    edges = ["row_lo", "row_hi", "col_lo", "col_hi"]
    square = F.struct(*edges).alias("square")
    sums = written(window_sums(pixels, squares.select(*edges).distinct().select(square, *edges), "square"), "square-sums")
    return squares.select(by, square).join(sums, "square").select(by, "volume")


def pyramid(pixels: DataFrame, boxes: DataFrame, by: str, most: int = 2048 * 2048) -> DataFrame:
    """by, level, scale, row_no, col_no, raw_value: the part of the raster in each box ``(by, row_lo, row_hi, col_lo, col_hi)``, as fine as ``most`` cells allow.

    A box is cut at the raster's extents. Its level is the least whose cells, ``scale = 2 ** level`` pixels wide and counted from the box's corner,
    are ``most`` at most; a cell has the sum of its pixels, so that a box's sum is the same at every level. Cells without pixels are left out,
    boxes without any, too.
    """
    ends = F.broadcast(extents(pixels).select(*(F.col(c).alias(f"raster_{c}") for c in ("row_lo", "row_hi", "col_lo", "col_hi"))))  # one row
    cut = {c: (F.greatest if c.endswith("lo") else F.least)(F.col(c), F.col(f"raster_{c}")).cast("bigint") for c in ("row_lo", "row_hi", "col_lo", "col_hi")}
    own = boxes.select(by, "row_lo", "row_hi", "col_lo", "col_hi").join(ends).withColumns(cut).where("row_lo <= row_hi AND col_lo <= col_hi")
    high, wide = F.col("row_hi") - F.col("row_lo") + 1, F.col("col_hi") - F.col("col_lo") + 1
    fits = lambda k: F.ceil(high / F.pow(F.lit(2), k)) * F.ceil(wide / F.pow(F.lit(2), k)) <= most
    level = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(62)), fits), 1)
    own = own.withColumn("level", level).withColumn("scale", F.pow(F.lit(2), F.col("level")).cast("bigint"))
    reach = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BLOCK), F.floor(F.col(hi) / BLOCK)))
    spread = own.withColumn("i", reach("row_lo", "row_hi")).withColumn("j", reach("col_lo", "col_hi"))
    cells = pixels.select(F.floor(F.col("row_no") / BLOCK).alias("i"), F.floor(F.col("col_no") / BLOCK).alias("j"), "row_no", "col_no", clean_value(F.col("raw_value")).alias("value"))
    met = cells.join(spread, ["i", "j"]).where("row_no BETWEEN row_lo AND row_hi AND col_no BETWEEN col_lo AND col_hi")
    coarse = [F.floor((F.col(f"{c}_no") - F.col(f"{c}_lo")) / F.col("scale")).cast("bigint").alias(f"{c}_no") for c in ("row", "col")]
    return met.groupBy(by, "level", "scale", *coarse).agg(F.sum("value").alias("raw_value"))


def point_squares(points: DataFrame, by: str, half: int, north: float = 51.66, west: float = 39.10, step: float = 0.001) -> DataFrame:
    """The squares of ``2 half + 1`` pixels around points; a point without coordinates has none."""
    row, col = F.rint((F.lit(north) - F.col("lat")) / step).cast("bigint"), F.rint((F.col("lon") - F.lit(west)) / step).cast("bigint")
    return points.where("lat IS NOT NULL AND lon IS NOT NULL").select(by, (row - half).alias("row_lo"), (row + half).alias("row_hi"), (col - half).alias("col_lo"), (col + half).alias("col_hi"))


def corridor_sums(points: DataFrame, pixels: DataFrame, buffer_m: float, north: float = 51.66, west: float = 39.10, step: float = 0.001) -> DataFrame:
    """route_id, di, volume, pixels, tiles: the pixels whose centre is within the buffer of a direction, each once.

    A segment is cut into pieces of at most ``PIECE`` rows and columns; a piece meets the pixels of its rows and columns, a buffer wider, by an
    equi-join, and the distance to the whole segment decides. Directions of the same shape share their sums.
    """
    groups = shapes.alike(points, DIRECTION, ["seq"], ["lat", "lon"])
    points = shapes.firsts(points, groups, DIRECTION)
    high = buffer_m / 111_000.0
    reach = F.greatest(F.abs(F.col("lat2") - F.col("lat1")), F.abs(F.col("lon2") - F.col("lon1"))) / (step * PIECE)
    seg = segments(points).withColumn("pieces", F.greatest(F.ceil(reach), F.lit(1)))
    seg = seg.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    ends = {f"{c}_{e}": F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * ((F.col("piece") + k) / F.col("pieces")) for c in ("lat", "lon") for k, e in enumerate("ab")}
    seg = seg.withColumns(ends)
    # as the distance shrinks longitudes, at the segment's middle latitude
    wide = F.lit(high) / F.least(F.lit(0.6), F.cos(F.radians((F.col("lat1") + F.col("lat2")) / 2)))
    rows = [F.floor((F.lit(north) - x) / step).cast("bigint") for x in (F.greatest("lat_a", "lat_b") + high, F.least("lat_a", "lat_b") - high)]
    cols = [F.floor((x - F.lit(west)) / step).cast("bigint") for x in (F.least("lon_a", "lon_b") - wide, F.greatest("lon_a", "lon_b") + wide)]
    seg = seg.withColumn("row_no", F.explode(F.sequence(rows[0], rows[1] + 1))).withColumn("col_no", F.explode(F.sequence(cols[0], cols[1] + 1)))
    cells = pixels.select("tile_id", "row_no", "col_no", "lat", "lon", clean_value(F.col("raw_value")).alias("value"))
    near = planar_segment_km(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= buffer_m / 1000
    # rows and columns are many more than the points' size tells, so they are not sent to every executor
    hits = seg.hint("merge").join(cells, ["row_no", "col_no"]).where(near).select(*DIRECTION, "tile_id", "row_no", "col_no", "value").distinct()
    by_tile = hits.groupBy(*DIRECTION, "tile_id").agg(F.sum("value").alias("volume"), F.count("*").alias("pixels"))
    sums = by_tile.groupBy(*DIRECTION).agg(F.sum("volume").alias("volume"), F.sum("pixels").alias("pixels"), F.count("*").alias("tiles"))
    return shapes.for_all(written(sums, "corridor-sums"), groups, DIRECTION)


def route_totals(directions: DataFrame) -> DataFrame:
    """Routes as plain sums of their directions."""
    return directions.groupBy("route_id").agg(*[F.sum(c).alias(c) for c in ("volume", "pixels", "tiles")])


def top_share(rows: DataFrame, weight: str, key: str, percent: float) -> DataFrame:
    """The ``ceil(n * percent / 100)`` rows of most weight, one at least; ties by key."""
    rows = written(rows, "share-of")  # counted, sampled for its ranges and exchanged
    least = F.greatest(F.lit(1), F.ceil(rows.agg(F.count("*")).scalar() * percent / 100))
    return numbered(rows, "rank_of_row", F.desc(weight), F.col(key)).where(F.col("rank_of_row") <= least).drop("rank_of_row")


def heat_cells(stops: DataFrame, bbox: tuple[float, float, float, float], cell_km: float = 0.1, percent: float = 35.0) -> DataFrame:
    """i, j, value: weights of the top stops ``(key, lat, lon, weight)`` summed by cell; stops without weight add no cell."""
    import math

    south, west, north, east = bbox
    dlat = cell_km / 111.0
    dlon = dlat / math.cos(math.radians((south + north) / 2))
    inside = stops.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    cell = lambda x, lo, d: F.expr(f"bigint(({x} - {lo!r}D) / {d!r}D)")
    placed = top_share(inside, "weight", "key", percent).where("weight > 0")
    return placed.groupBy(cell("lat", south, dlat).alias("i"), cell("lon", west, dlon).alias("j")).agg(F.sum("weight").alias("value"))


def smoothed(cells: DataFrame) -> DataFrame:
    """Half a cell's own value and an eighth of each of its four neighbours'; no new cells."""
    shares = [(0, 0, 0.5), (1, 0, 0.125), (-1, 0, 0.125), (0, 1, 0.125), (0, -1, 0.125)]
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("share")) for a, b, c in shares])
    spread = cells.withColumn("s", F.explode(steps)).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), (F.col("value") * F.col("s.share")).alias("value"))
    return spread.join(cells.select("i", "j"), ["i", "j"], "left_semi").groupBy("i", "j").agg(F.sum("value").alias("value"))


def heat_levels(cells: DataFrame, gamma: float = 0.6, levels: int = 32) -> DataFrame:
    """Cells with t (share of the greatest), the level after the gamma, and the level's colour."""
    t = F.col("value") / cells.agg(F.max("value")).scalar()
    level = F.rint(F.pow("t", F.lit(gamma)) * (levels - 1)).cast("bigint")
    return cells.withColumn("t", t).withColumn("level", level).withColumn("color", heat_color(F.col("level") / (levels - 1)))


def heat_placemarks(levels: DataFrame, south: float, west: float, dlat: float, dlon: float, gamma: float = 0.6, tallest_m: float = 400.0, flat: bool = False) -> DataFrame:
    """i, j, style, altitude, extrude, altitude_mode, coordinates of the heat map's cells as blocks, or on the ground when ``flat``.

    levels: ``(i, j, t, level)``; cell (i, j) has its corner i and j steps from (south, west).
    """
    lat, lon = ([F.lit(o) + (F.col(c) + k) * step for k in (0, 1)] for c, o, step in (("i", south, dlat), ("j", west, dlon)))
    altitude = F.lit(0.0) if flat else tallest_m * F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("t"))), F.lit(gamma))
    corner = lambda y, x: F.format_string("%.7f,%.7f,%.1f", lon[x], lat[y], altitude)
    ring = F.concat_ws(" ", *(corner(y, x) for y, x in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))))
    return levels.select(
        "i",
        "j",
        F.concat(F.lit("heat"), F.col("level").cast("string")).alias("style"),
        altitude.alias("altitude"),
        F.lit(0 if flat else 1).alias("extrude"),
        F.lit("clampToGround" if flat else "relativeToGround").alias("altitude_mode"),
        ring.alias("coordinates"),
    )


def clipped(pixels: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """The pixels whose centre is in a box (south, west, north, east)."""
    south, west, north, east = bbox
    return pixels.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def downsampled(pixels: DataFrame, factor: int) -> DataFrame:
    """row_no, col_no, raw_value of a grid ``factor`` times as coarse; a cell has the sum of its pixels, so that no volume is lost."""
    coarse = [F.floor(F.col(c) / factor).cast("bigint").alias(c) for c in ("row_no", "col_no")]
    return pixels.groupBy(*coarse).agg(F.sum(clean_value(F.col("raw_value"))).alias("raw_value"))


def corridor_volumes(ways: DataFrame, pixels: DataFrame, by: str, corridor: int) -> DataFrame:
    """Volume along straight ways ``(by, row1, col1, row2, col2)`` in pixels, by squares around samples.

    A way of length d has ``max(1, d div corridor)`` samples, in the middle of equal parts; their squares may overlap and then count twice.
    """
    length = F.hypot(F.col("row2") - F.col("row1"), F.col("col2") - F.col("col1"))
    parts = ways.withColumn("parts", F.greatest(F.lit(1), F.floor(length / corridor).cast("int")))
    samples = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    share = (F.col("k") + 0.5) / F.col("parts")
    at = lambda c: F.rint(F.col(c + "1") + (F.col(c + "2") - F.col(c + "1")) * share).cast("bigint")
    half = max(1, corridor // 2)
    squares = samples.select(by, "k", at("row").alias("r"), at("col").alias("c")).select(F.struct(by, "k").alias("sample"), *[e.alias(n) for n, e in (("row_lo", F.col("r") - half), ("row_hi", F.col("r") + half), ("col_lo", F.col("c") - half), ("col_hi", F.col("c") + half))])
    return window_sums(pixels, squares, "sample").groupBy(F.col(f"sample.{by}").alias(by)).agg(F.sum("volume").alias("volume"))


def tile_bounds(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("tile_id").agg(F.min("row_no").alias("row_lo"), F.max("row_no").alias("row_hi"), F.min("col_no").alias("col_lo"), F.max("col_no").alias("col_hi"))


def first_tile(points: DataFrame, tiles: DataFrame, by: str, cell: int = 64) -> DataFrame:
    """by, tile_id: the first tile whose bounds hold a point ``(by, row_no, col_no)``; tiles meet points by coarse cells."""
    reach = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    spread = tiles.withColumn("cr", reach("row_lo", "row_hi")).withColumn("cc", reach("col_lo", "col_hi"))
    placed = points.withColumns({"cr": F.floor(F.col("row_no") / cell), "cc": F.floor(F.col("col_no") / cell)})
    inside = placed.join(spread, ["cr", "cc"]).where("row_no BETWEEN row_lo AND row_hi AND col_no BETWEEN col_lo AND col_hi")
    return inside.groupBy(by).agg(F.min("tile_id").alias("tile_id"))

"""New routes between terminals, grown stop by stop towards the most built-up corridor.

Pairs of terminals are matched first; the paths of different pairs do not
depend on one another, so each is grown in a task of its own over the places and pixels that it can reach.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import curvature_text
from ..tables import numbered
from .raster import clean_value

# How a path ends, the least number of stops of a network, of stops of a path, and the least distance in km of a ratio.
REACHED, TOO_LONG, NO_STOPS, NO_VOLUME = "достигнута конечная", "лимит длины", "нет остановок в радиусе", "коридор без застройки"
LEAST_STOPS, LEAST_PATH, LEAST_BASE_KM = 10, 3, 0.05

COLUMNS = ["n", "origin", "destination", "stops", "length_km", "ratio", "volume", "status", "chain", "points"]
SCHEMA = (
    "n long, origin string, destination string, stops long, length_km double, ratio double, volume double, status string, "
    "chain string, points array<struct<lat: double, lon: double>>"
)


@dataclass(frozen=True)
class Growth:
    first_radius: float = 500.0
    last_radius: float = 5000.0
    step: float = 200.0
    least_step: float = 30.0
    longest_m: float = 20_000.0
    corridor_m: float = 400.0

    def __post_init__(self) -> None:
        if self.longest_m <= 0 or self.corridor_m <= 0:
            raise ValueError("the greatest length and the corridor must be positive")
        if self.first_radius <= 0 or self.last_radius < self.first_radius or self.step <= 0:
            raise ValueError("the radius must begin above 0, not end below its beginning, and grow")


@dataclass(frozen=True)
class Grid:
    """Where a raster lies on the plane of x and y: its west and north edges, and a pixel's width and height, in metres."""

    west: float
    north: float
    width: float
    height: float


def terminals(ends: DataFrame, volumes: DataFrame) -> DataFrame:
    """From ``(key, route_id, di, x, y, ...)``: a row a terminal, its first occurrence, with its volume and rank."""
    order = F.struct("route_id", "di")
    others = [c for c in ends.columns if c not in ("key", "route_id", "di")]
    one = ends.groupBy("key").agg(F.min_by(F.struct(*others), order).alias("first")).select("key", "first.*")
    valued = one.join(volumes.select("key", "volume"), "key", "left").select("key", *others, F.coalesce("volume", F.lit(0.0)).alias("volume"))
    return numbered(valued, "rank", F.desc("volume"), F.col("key"))


def origins(found: DataFrame, count: int) -> DataFrame:
    """n, key, x, y and the like of the n-th route's origin: the n-th terminal, the first again when there are no more."""
    top = found.where(F.col("rank") <= count)
    numbers = found.sparkSession.range(1, count + 1).withColumnRenamed("id", "n")
    many = F.least(F.lit(count), found.agg(F.count("*")).scalar())
    place = F.when(F.col("n") <= many, F.col("n")).otherwise(1)
    return numbers.select("n", place.alias("rank")).join(top, "rank")


def matched(stops: DataFrame, found: DataFrame, count: int) -> list[tuple[int, str, str]]:
    """``(n, origin, destination)``: each time the best unused origin, and the best unused destination a fifth of the stops' span away.

    All terminals are looked at. An origin meets at most ``count - 1`` destinations that are taken, so its ``count`` best tell which it gets;
    those, ``count`` times ``count`` rows at most, are what the driver sees. Without one far away that is unused, the best other terminal is taken.
    """
    if count < 0:
        raise ValueError("count must not be negative")
    box = stops.agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in enumerate((F.min, F.max)))).first()
    if count == 0:
        return []
    best_two = [r.key for r in found.where("rank <= 2").orderBy("rank").select("key").collect()]
    if len(best_two) < 2 or box.x0 is None:
        return []
    span = math.hypot(box.x1 - box.x0, box.y1 - box.y0)
    first = [tuple(r) for r in origins(found, count).orderBy("n").select("n", "key", "x", "y").collect()]  # ``count`` rows
    starts = found.sparkSession.createDataFrame(sorted({r[1:] for r in first}), "origin string, ox double, oy double")
    # the origins, ``count`` at most, against all terminals
    far = found.join(F.broadcast(starts), (F.col("key") != F.col("origin")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) >= 0.2 * span))
    best = F.row_number().over(Window.partitionBy("origin").orderBy("rank"))
    choices: dict[str, list[str]] = {}
    for r in far.withColumn("place", best).where(F.col("place") <= count).select("origin", "key", "rank").orderBy("rank").collect():
        choices.setdefault(r.origin, []).append(r.key)
    used: set[str] = set()
    out = []
    for n, origin, *_ in first:
        other = next(k for k in best_two if k != origin)
        destination = next((k for k in choices.get(origin, []) if k not in used), other)
        used.add(destination)
        out.append((n, origin, destination))
    return out


def integral(grid: Grid, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[Grid, np.ndarray]:
    """The grid of the rows and columns that occur, and its prefix sums with a row and a column of 0 in front."""
    if not len(row):
        return grid, np.zeros((1, 1))
    total = np.zeros((row.max() - row.min() + 2, col.max() - col.min() + 2))
    np.add.at(total, (row - row.min() + 1, col - col.min() + 1), value)
    return Grid(grid.west + col.min() * grid.width, grid.north - row.min() * grid.height, grid.width, grid.height), total.cumsum(0).cumsum(1)


def corridor_volume(grid: Grid, total: np.ndarray, start: tuple[float, float], x: np.ndarray, y: np.ndarray, corridor_m: float) -> np.ndarray:
    """The volume along straight ways from ``start`` to each (x, y): the sums of the pixels that squares around samples touch."""
    way = np.hypot(x - start[0], y - start[1])
    parts = np.where(way > 1, np.maximum(1, (way / corridor_m).astype(int)), 1)
    of = np.repeat(np.arange(len(x)), parts)
    share = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 0.5) / parts[of]
    at_x, at_y = start[0] + (x[of] - start[0]) * share, start[1] + (y[of] - start[1]) * share
    half = max(50.0, corridor_m / 2)
    rows, cols = total.shape[0] - 1, total.shape[1] - 1
    edge = lambda at, size, f, n: np.clip(f(at / size), 0, n).astype(int)
    c0, c1 = edge(at_x - half - grid.west, grid.width, np.floor, cols), edge(at_x + half - grid.west, grid.width, np.ceil, cols)
    r0, r1 = edge(grid.north - at_y - half, grid.height, np.floor, rows), edge(grid.north - at_y + half, grid.height, np.ceil, rows)
    return np.maximum(0, np.bincount(of, total[r1, c1] - total[r0, c1] - total[r1, c0] + total[r0, c0], len(x)))


def visits(how: Growth) -> int | None:
    """How often a path can come to one place at most: it leaves for another one between, and each way is longer than the least; None without such a bound."""
    return math.ceil(how.longest_m / how.least_step) // 2 + 2 if how.least_step > 0 else None


def places(stops: DataFrame, most: int | None) -> DataFrame:
    """x, y, lat, lon, keys: a row a place, with the ``most`` least keys of its stops in order.

    Stops of one place differ in their keys alone, and a path takes these in order, so more than it has visits cannot matter.
    """
    place = ["x", "y", "lat", "lon"]
    least = stops.select(*place, "key")
    if most is not None:
        turn = Window.partitionBy(*place).orderBy("key")
        least = least.withColumn("turn_of_key", F.row_number().over(turn)).where(F.col("turn_of_key") <= most)
    return least.groupBy(*place).agg(F.sort_array(F.collect_list("key")).alias("keys"))


def grow(start: tuple[float, float], goal: tuple[float, float], x: np.ndarray, y: np.ndarray, keys: list, volume_to, how: Growth) -> tuple[list[tuple[int, str]], float, float, str]:
    """``(stops, metres, volume, status)`` of one path over places, a stop as its place and key; ``volume_to(at, x, y)`` values the ways from a place."""
    left, taken = np.array([len(k) for k in keys]), np.zeros(len(x), int)
    at, path, metres, volume = start, [], 0.0, 0.0
    while True:
        to_goal = math.hypot(goal[0] - at[0], goal[1] - at[1])
        if to_goal <= max(how.first_radius, 400.0):
            return path, metres, volume, REACHED
        if metres >= how.longest_m:
            return path, metres, volume, TOO_LONG
        away = np.hypot(x - at[0], y - at[1])
        free = (left > 0) & (away > how.least_step)
        radius, near = how.first_radius, np.zeros(0, int)
        while radius <= how.last_radius and not len(near):
            near = np.flatnonzero(free & (away <= radius))
            radius += how.step
        if not len(near):
            return path, metres, volume, NO_STOPS
        ahead = near[np.hypot(x[near] - goal[0], y[near] - goal[1]) < to_goal - 1]
        pool = ahead if len(ahead) else near
        worth = volume_to(at, x[pool], y[pool])
        if worth.max() <= 0:
            return path, metres, volume, NO_VOLUME
        key, chosen = min((keys[k][taken[k]], int(k)) for k in pool[worth == worth.max()])
        left[chosen] -= 1
        taken[chosen] += 1
        metres += float(away[chosen])
        volume += float(worth.max())
        path.append((chosen, key))
        at = (float(x[chosen]), float(y[chosen]))


def _great_circle_km(a: pd.Series, b: pd.Series) -> float:
    dlat, dlon = math.radians(b.lat - a.lat), math.radians(b.lon - a.lon)
    h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(dlon / 2) ** 2
    return 12742.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def generate_routes(stops: DataFrame, found: DataFrame, pixels: DataFrame, grid: Grid, count: int, how: Growth = Growth()) -> DataFrame:
    """n, origin, destination, stops, length_km, ratio, volume, status, chain, points; paths of under three stops are dropped, n counts the others.

    stops: ``(key, x, y, lat, lon)``; found: terminals with the same, volume and rank; pixels: ``(row_no, col_no, raw_value)`` on ``grid``.
    A pair meets the places and pixels within the greatest length and one radius of its origin: more it cannot reach. Stops of one
    place are one row, so a task grows with the places in reach, not with the stops. A network of under ten stops or two terminals
    has no new routes. Of ways of equal volume that to the least key is taken.
    """
    spark = stops.sparkSession
    pairs = matched(stops, found, count) if stops.count() >= LEAST_STOPS else []
    if not pairs:
        return spark.createDataFrame([], SCHEMA)
    ends = found.select("key", "x", "y", "lat", "lon")
    table = spark.createDataFrame(pairs, "n long, origin string, destination string")
    for name in ("origin", "destination"):
        side = ends.select(F.col("key").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("x", "y", "lat", "lon")))
        table = table.join(side, name)
    table = table.persist()  # a row a pair
    known = {r.n: r for r in table.collect()}
    spots = table.select("n", "origin_x", "origin_y")
    # the pairs, ``count`` at most, against all places and all pixels
    reach = how.longest_m + how.last_radius
    near = lambda x, y, more: F.hypot(x - F.col("origin_x"), y - F.col("origin_y")) <= reach + more
    around = places(stops, visits(how)).join(F.broadcast(spots), near(F.col("x"), F.col("y"), 0.0)).drop("origin_x", "origin_y")
    px, py = grid.west + (F.col("col_no") + 0.5) * grid.width, grid.north - (F.col("row_no") + 0.5) * grid.height
    cells = pixels.groupBy("row_no", "col_no").agg(F.sum(clean_value(F.col("raw_value"))).alias("value")).where("value > 0")
    wide = how.corridor_m + 50 + math.hypot(grid.width, grid.height)
    cells = cells.join(F.broadcast(spots.withColumnRenamed("n", "pair")), near(px, py, wide)).select("pair", "row_no", "col_no", "value")

    def path(rows: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=COLUMNS)
        one = known[int(rows.n.iloc[0])]
        own, total = integral(grid, ground.row_no.to_numpy(), ground.col_no.to_numpy(), ground.value.to_numpy())
        value = lambda at, x, y: corridor_volume(own, total, at, x, y, how.corridor_m)
        start, goal = (pd.Series({c: one[f"{e}_{c}"] for c in ("x", "y", "lat", "lon")}) for e in ("origin", "destination"))
        picked, metres, volume, status = grow((start.x, start.y), (goal.x, goal.y), rows.x.to_numpy(), rows.y.to_numpy(), rows["keys"].tolist(), value, how)
        if len(picked) < LEAST_PATH:
            return pd.DataFrame([], columns=COLUMNS)
        last = rows.iloc[picked[-1][0]]
        length = (metres + math.hypot(last.x - goal.x, last.y - goal.y)) / 1000
        base = _great_circle_km(start, goal)
        points = [{"lat": float(p.lat), "lon": float(p.lon)} for p in (start, *(rows.iloc[k] for k, _ in picked), goal)]
        names = " → ".join([one.origin, *(key for _, key in picked), one.destination])
        ratio = length / base if base > LEAST_BASE_KM else math.inf
        return pd.DataFrame([(one.n, one.origin, one.destination, len(picked), length, ratio, volume, status, names, points)], columns=COLUMNS)

    grown = around.groupBy("n").cogroup(cells.groupBy("pair")).applyInPandas(path, SCHEMA)
    return grown.withColumn("n", F.row_number().over(Window.orderBy("n")).cast("long"))  # a row a pair


def sheet(routes: DataFrame) -> DataFrame:
    """Generated routes as they are shown: lengths in km, volumes in thousands, by kilometre too (null without a length)."""
    thousands = F.col("volume") / 1000
    return routes.select(
        "n",
        "origin",
        "destination",
        F.round("length_km", 2).alias("length_km"),
        "stops",
        curvature_text(F.col("ratio")).alias("ratio"),
        F.round(thousands, 1).alias("volume"),
        F.when(F.col("length_km") > 0, F.round(thousands / F.col("length_km"), 1)).alias("volume_per_km"),
        "status",
        "chain",
    )

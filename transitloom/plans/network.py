"""The whole analysis as one graph of lazy DataFrames."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import corridor, geometry, mosaic, nearby, network, overlap, raster
from ..sources.workbook import Sheet, write_workbook
from ..tables import numbered, written


def _node(name: str) -> Column:
    """A direction's number, ``route_id * 2**16 + di``."""
    return (F.col("route_id") * (1 << 16) + F.col("di")).alias(name)


def _direction(node: str) -> tuple[Column, Column]:
    return F.expr(f"{node} div {1 << 16}").alias("route_id"), F.expr(f"int({node} % {1 << 16})").alias("di")


def _flat(points: DataFrame) -> DataFrame:
    """The points in metres, by node."""
    return geometry.without_repeats(geometry.projected(points)).select(_node("node"), F.lit(0).alias("line"), "seq", "x", "y")


class Network:
    """Results of a run by name; each is a DataFrame that is computed when it is asked for.

    What several results build on is written, so that it is computed once, survives lost executors and plans stay small; the tables
    stay in the shared folder.

    routes: ``(route_id, name, route_type, active, error)``; points: ``(route_id, di, seq, lat, lon)``; stops:
    ``(route_id, di, seq, stop_id, stop_name, lat, lon)``; pois: ``(poi_id, poi_type, name, lat, lon)``; pixels:
    ``(tile_id, row_no, col_no, lat, lon, raw_value)``.

    tiles: the catalog of rasters whose pixels have no coordinates of their own, in any of the projections that
    ``operators.mosaic`` knows; cache: what is known of directions from earlier runs over the rasters named ``paths``.
    """

    def __init__(
        self,
        config: RunConfig,
        routes: DataFrame,
        points: DataFrame,
        stops: DataFrame,
        pois: DataFrame,
        pixels: DataFrame,
        tiles: DataFrame | None = None,
        cache: mosaic.CorridorCache | None = None,
        paths: tuple[str, ...] = (),
    ):
        self.tiles, self.cache, self.paths = tiles, cache, list(paths)
        self.config, self.all_routes, self.all_points, self.all_stops, self.pois, self.pixels = config, routes, points, stops, pois, pixels

    def _keep(self, df: DataFrame) -> DataFrame:
        return written(df, "network")

    def close(self) -> None:
        """Nothing is held in memory; callers that end a run say so here."""

    @cached_property
    def states(self) -> DataFrame:
        c = self.config
        tasks = network.route_tasks(network.split_active(self.all_routes, c.active_only), set(c.include), set(c.exclude), c.only, c.most_number)
        return self._keep(network.route_state(tasks, self.all_points))

    @cached_property
    def excluded(self) -> DataFrame:
        limits = self.config.limits
        ok = self.all_points.join(self.states.where("state = 'ok'").select("route_id"), "route_id", "left_semi")
        return geometry.route_limits(ok, limits.curvilinearity, limits.min_km, limits.radius_km, limits.where)

    @cached_property
    def kept_points(self) -> DataFrame:
        kept = self.excluded.where("reason IS NULL").select("route_id")
        return self._keep(self.all_points.join(kept, "route_id", "left_semi"))

    def _corridors(self, points: DataFrame) -> DataFrame:
        """Volume, pixels and tiles within the buffer of each direction that has any, and the area within it."""
        buffer_m = self.config.volume_buffer_m
        if self.tiles is not None:
            found = self.cache.sums(points, self.pixels, self.tiles, buffer_m, self.paths) if self.cache else mosaic.mosaic_sums(points, self.pixels, self.tiles, buffer_m)
            return found.where("pixels > 0")
        sums = raster.corridor_sums(points, self.pixels, buffer_m)
        if buffer_m <= 0:
            return sums.withColumn("corridor_m2", F.lit(0.0))
        own = points.select(_node("node")).distinct()
        areas = corridor.corridor_areas(overlap.node_segments(self.flat.join(own, "node", "left_semi")), buffer_m)
        return sums.join(areas.select(*_direction("node"), "corridor_m2"), ["route_id", "di"], "left")

    @cached_property
    def corridors(self) -> DataFrame:
        return self._keep(self._corridors(self.kept_points))

    @cached_property
    def flat(self) -> DataFrame:
        """The kept points in metres, by node, in one projection."""
        return self._keep(_flat(self.kept_points))

    @cached_property
    def _shapes(self) -> tuple[DataFrame, DataFrame]:
        """The overlaps of the shapes of directions, and the directions of each; both are written."""
        return overlap.shape_overlaps(overlap.node_segments(self.flat), self.config.dedup_buffer_m, self.config.dedup_threshold)

    @cached_property
    def overlaps(self) -> DataFrame:
        """Pairs of overlapping directions; a node is ``route_id * 2**16 + di``. They grow with the square of the directions of a shape, so they are made when asked for."""
        return overlap.pairs_of_nodes(*self._shapes)

    @cached_property
    def _passes(self) -> tuple[DataFrame, DataFrame]:
        """What is removed, pass after pass, and the corridors of what is left.

        Before another pass, and at the end, the directions of routes that lost some are measured again, the others' figures stay. Each pass leaves
        its tables written; the passes end with one that removes nothing.
        """
        c = self.config
        stats, active, passes = self.corridors, None, []
        shapes, blocks = self._shapes
        members = blocks.select(F.explode("nodes").alias("node"), F.col("node").alias("shape"))
        names = self.kept_points.select(F.col("route_id"), F.col("di")).distinct()
        nodes = names.select(_node("node"))
        for number in range(1, c.dedup_passes + 1):
            volumes = stats.select(_node("node"), "volume")
            if c.center_weight > 0:
                distances = geometry.network_center(self.kept_points).select(_node("node"), F.col("center_km").alias("distance"))
                edges = self.overlaps.select("x", "y", "kmax")
                left = edges if active is None else overlap.clean_edges(edges, c.dedup_threshold, active)
                found = overlap.removals_weighted(left, volumes, distances, c.dedup_threshold, c.center_weight)
            else:
                found = overlap.removals_alike(shapes.select("x", "y", "kmax"), members, volumes, c.dedup_threshold, active)
            found = written(found.withColumn("pass", F.lit(number)), "pass")
            passes.append(found)
            if found.isEmpty():
                break
            active = written(overlap.survivors(nodes if active is None else active, found), "pass-active")
            routes = found.select(*_direction("node")).select("route_id").distinct()
            touched = names.join(routes, "route_id", "left_semi")
            kept = self.kept_points.join(active.select(*_direction("node")), ["route_id", "di"], "left_semi").join(routes, "route_id", "left_semi")
            stats = written(overlap.merge_stats(stats, self._corridors(kept), touched, ["route_id", "di"]), "pass-corridors")
        removed = reduce(DataFrame.unionByName, passes).withColumnRenamed("step", "step_of_pass")
        removed = numbered(removed, "step", "pass", "step_of_pass").drop("step_of_pass")
        return self._keep(removed), stats

    @property
    def removed(self) -> DataFrame:
        """What is removed; the text of the edges that close with a node is made where it is asked for."""
        removed = self._passes[0]
        if self.config.center_weight > 0:
            return removed
        closed = overlap.closed_with(self.overlaps, removed, self.config.dedup_threshold)
        return removed.join(closed, "node", "left").select("node", "volume", "partners", "representative", "best", "closed", "pass", "step")

    @property
    def corridors_after(self) -> DataFrame:
        """The corridors of the directions that are left."""
        return self._passes[1] if self.config.dedup else self.corridors

    @cached_property
    def points(self) -> DataFrame:
        """What is left after removals; directions keep their numbers."""
        if not self.config.dedup:
            return self.kept_points
        gone = self._passes[0].select(*_direction("node"))
        return self._keep(self.kept_points.join(gone, ["route_id", "di"], "left_anti"))

    @cached_property
    def poi_stats(self) -> DataFrame:
        return nearby.near_stats(self.pois.where("name IS NOT NULL"), self.points, self.config.poi_buffer_m, ["route_id", "di"])

    @cached_property
    def stops(self) -> DataFrame:
        left = self.points.select("route_id", "di").distinct()
        return self._keep(network.unique_stops(self.all_stops.join(left, ["route_id", "di"], "left_semi"), self.all_routes))

    @cached_property
    def heat(self) -> DataFrame:
        c = self.config
        weighted = self.stops.where("lat IS NOT NULL AND lon IS NOT NULL").select("key", "lat", "lon", F.size("routes").cast("double").alias("weight"))
        box = geometry.network_bbox(self.points).first()  # one row
        if box.south is None:
            return raster.heat_levels(raster.heat_cells(weighted, (0.0, 0.0, 0.0, 0.0), c.heat_cell_km, c.heat_percent), c.heat_gamma)
        return raster.heat_levels(raster.heat_cells(weighted, tuple(box), c.heat_cell_km, c.heat_percent), c.heat_gamma)

    @cached_property
    def terminals(self) -> DataFrame:
        left = self.points.select("route_id", "di").distinct()
        return network.terminal_groups(self.all_stops.join(left, ["route_id", "di"], "left_semi"))

    def lengths(self, points: DataFrame) -> DataFrame:
        """total_km, unique_km and coefficient of a network's lines."""
        return overlap.network_km(overlap.node_segments(_flat(points)))

    def sheets(self) -> dict[str, DataFrame]:
        """The results as tables by name; those of removals only where they are asked for."""
        found = {
            "states": self.states,
            "excluded": self.excluded.where("reason IS NOT NULL"),
            "directions": geometry.direction_km(self.points),
            "corridors": self.corridors,
            "stops": self.stops.drop("types", "routes"),
            "terminals": self.terminals,
            "poi": self.poi_stats.drop("by_type"),
            "heat": self.heat,
        }
        return found | ({"overlaps": self.overlaps, "removed": self.removed} if self.config.dedup else {})

    def sizes(self) -> DataFrame:
        """measure, value: the number of rows of each of the sheets. Pairs and removals are counted without their making."""
        counted = self.sheets()
        if self.config.dedup:
            counted |= {"removed": self._passes[0]}
        named = {name: rows.agg(F.count("*").alias("value")) for name, rows in counted.items() if name != "overlaps"}
        if self.config.dedup:
            named |= {"overlaps": overlap.count_pairs(*self._shapes).select(F.col("pairs").alias("value"))}
        return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("measure"), F.col("value").cast("double").alias("value")) for name, df in named.items()))

    def workbook(self, path: str, bbox: tuple[float, float, float, float] | None = None, all_stops: bool = False, generated: DataFrame | None = None) -> list[str]:
        """Writes the report and returns its sheets: summary and errors always, the others where they have rows, all stops where they are asked for."""
        one = lambda title, rows, *order, optional=True: Sheet(title, rows, order, optional)
        shown = self.points.select("route_id").distinct()
        directions = geometry.direction_km(self.points).join(self.corridors_after, ["route_id", "di"], "left")
        routes = directions.join(self.all_routes.select("route_id", "name", "route_type"), "route_id")
        bad = self.states.where("state = 'bad'").select("route_id", "name", "route_type", "error")
        # The sheets' titles.
        sheets = [
            one("Сводка", self.summary(bbox, generated=generated.count() if generated is not None else 0), "place", optional=False),
            one("Маршруты", routes, "route_type", "name", "route_id", "di"),
            one("Ошибки", bad, "route_id", optional=False),
            one("Отфильтрованные", self.excluded.where("reason IS NOT NULL"), "route_id"),
            one("Уникальные остановки", self.stops.select("key", "name", "lat", "lon", F.array_join(F.col("routes").cast("array<string>"), ", ").alias("routes")), "key"),
            one("POI", self.poi_stats.drop("by_type"), "route_id", "di"),
            *([one("Дедупликация", self.removed, "step")] if self.config.dedup else []),
            *([one("Сгенерированные", generated, generated.columns[0])] if generated is not None else []),
            one("Тепловая карта", self.heat, "i", "j"),
            *([one("Остановки", self.all_stops.join(shown, "route_id", "left_semi"), "route_id", "di", "seq")] if all_stops else []),
        ]
        return write_workbook(sheets, path)

    def summary(self, bbox: tuple[float, float, float, float] | None = None, ideas: int = 0, generated: int = 0) -> DataFrame:
        """place, measure, value: the summary sheet's figures; null where a figure was not asked for or there is nothing to measure.

        Built from one-row aggregates, joined and turned into rows.
        """
        c, limits = self.config, self.config.limits
        one = lambda df, *values: df.agg(*values)
        count = lambda name, when=None: (F.count("*") if when is None else F.count_if(F.expr(when))).alias(name)
        reasons = {"curvature": "криволинейность", "length": "длина", "radius": "радиус"}
        kept = self.points.select("route_id").distinct()
        types = network.type_counts(self.states.where("state = 'ok'").join(kept, "route_id", "left_semi"), self.points, bbox)
        parts = [
            one(self.states, count("processed"), count("errors", "state = 'bad'")),
            one(self.all_routes, count("inactive", "NOT active")),
            one(kept, count("ok")),
            one(self.excluded, *(count(f"cut_{k}", f"reason = '{r}'") for k, r in reasons.items())),
            self.lengths(self.points).select("total_km", "unique_km", F.col("coefficient").alias("km")),
            self.lengths(self.kept_points).select(F.col("coefficient").alias("km_before")),
            one(self.stops, count("stops")),
            one(self.terminals, count("terminals")),
            one(self.corridors.join(self.points.select("route_id", "di").distinct(), ["route_id", "di"], "left_semi"), F.sum("volume").alias("volume")),
            one(self.poi_stats, F.sum("total_value").alias("poi_value")),
            one(types, *(F.max(F.when(F.col("title") == t, F.col("routes"))).alias(f"type_{k}") for t, k in network.TYPE_TITLES.items())),
        ]
        if c.dedup:
            parts.append(one(self._passes[0], count("removed")))
        row = parts[0]
        for more in parts[1:]:
            row = row.join(more)  # a row each
        col, lit, blank = F.col, F.lit, F.lit(None)
        density = network.density(col("unique_km"), bbox) if bbox else blank
        # The figures' names.
        figures = [
            ("Маршрутов в обработке", col("processed")),
            ("Успешно (в отчёте)", col("ok")),
            ("Ошибок", col("errors")),
            ("Идей пассажиров", lit(ideas)),
            ("Пропущено неактивных (--active-only)", col("inactive") if c.active_only else lit(0)),
            ("Отсечено: криволинейность", col("cut_curvature")),
            ("Отсечено: длина", col("cut_length")),
            ("Отсечено: радиус", col("cut_radius")),
            ("Дедупликация: удалено направлений", col("removed") if c.dedup else lit(0)),
            ("Дедупликация: Км до", F.round("km_before", 2) if c.dedup else blank),
            ("Маршрутный коэффициент Км", F.round("km", 2)),
            ("Суммарная длина трасс, км", F.round("total_km", 2)),
            ("Длина уникальной сети, км", F.round("unique_km", 2)),
            ("Плотность сети, км/км²", density),
            ("Макс. коэфф. непрямолинейности (0=без лимита)", lit(limits.curvilinearity)),
            ("Мин. длина маршрута, км (0=без лимита)", lit(limits.min_km)),
            ("Радиус от центра, км (0=без лимита)", lit(limits.radius_km)),
            ("Маршрутов на карте (KML)", col("ok")),
            ("Остановок уникальных", col("stops")),
            ("Конечных", col("terminals")),
            ("Сгенерировано маршрутов (Якимов)", lit(generated) if generated else blank),
            *((title, col(f"type_{kind}")) for title, kind in network.TYPE_TITLES.items()),
            ("GHS: буфер, м", lit(c.volume_buffer_m)),
            ("GHS: суммарный объём, тыс. м³", F.round(col("volume") / 1000, 1)),
            ("POI: буфер, м", F.when(col("poi_value").isNotNull(), lit(c.poi_buffer_m))),
            ("POI: суммарное value", F.round("poi_value", 1)),
        ]
        rows = F.array(*[F.struct(lit(n).alias("place"), lit(name).alias("measure"), value.cast("double").alias("value")) for n, (name, value) in enumerate(figures, 1)])
        return row.select(F.inline(rows))

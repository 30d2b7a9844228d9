"""The command line: a city's tables in, its workbook and map out.

The tables are Parquet files in a folder: ``routes points stops pois pixels``, and ``tiles`` where the rasters have projections
of their own; see ``plans.network.Network`` for their columns. They stand for what is loaded from the network elsewhere; flags
for that are accepted and have no effect.
"""

from __future__ import annotations

import argparse
import os
import shlex
import sys
import warnings
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .config import ConfigError, Limits, RunConfig, parse_types, resolve_city

# The flags by name with their kind and default; those of the last group change nothing here.
SWITCHES = "--stops --active-only --heatmap --heat-flat --heat-volume --heat-smooth --ghs --ghs-s --poi --dedup --generate --no-cache --refresh".split()
NUMBERS = {
    "--curv": 2.0, "--minlen": None, "--radius": None, "--center-lat": None, "--center-lon": None, "--bbox-buffer": None, "--heat-cell": 0.1, "--heat-gamma": 0.6, "--heat-top": 35.0,
    "--heat-max-height": 400.0, "--heat-vol-radius": 800.0, "--ghs-buffer": 800.0, "--ghs-s-buffer": 800.0, "--ghs-s-max": 1e12, "--poi-buffer": 800.0, "--dedup-buffer": 100.0,
    "--dedup-threshold": 0.70, "--dedup-center-weight": 0.0, "--gen-population": None, "--gen-transfer": 1.15, "--gen-maxlen": 20.0, "--gen-corridor": 400.0,
}
WHOLE = {"--max-route-number": 0, "--dedup-passes": 1, "--gen-count": 10}
TEXTS = {"--city": None, "--route": None, "--format": "xlsx,kml", "--output": None, "--heat-alpha": "ff", "--batch": None, "--cache-dir": "transit_cache", "--ghs-file": None, "--ghs-s-file": None}
LOADING = {
    "--url": None, "--workers": "8", "--ideas-max-pages": None, "--ideas-search": None, "--ideas-sort": None, "--overture-file": None, "--overture-buffer": "800", "--overture-theme": "building", "--overture-release": None,
}
LOADING_SWITCHES = ("--ideas", "--overture", "--no-bbox-filter")
#: Flags that are no more, with how many values they had.
DROPPED = {"--clean-names": 0, "--dedup-strategy": 1}


def parse_arguments(argv: Sequence[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="transitloom", description=__doc__.splitlines()[0])
    parser.add_argument("city_arg", nargs="?")
    parser.add_argument("--tables", help="the folder with the city's tables")
    parser.add_argument("--type", action="append", default=[])
    parser.add_argument("--no-type", action="append", default=[])
    for names, kind in ((NUMBERS, float), (WHOLE, int), (TEXTS, str), (LOADING, str)):
        for name, default in names.items():
            short = {"--output": ["-o"], "--workers": ["-w"]}.get(name, [])
            parser.add_argument(*short, name, type=kind, default=default)
    for name in (*SWITCHES, *LOADING_SWITCHES):
        parser.add_argument(name, action="store_true")
    kept, left = [], list(argv)
    while left:
        word = left.pop(0)
        name, *value = word.split("=", 1)
        if name not in DROPPED:
            kept.append(word)
            continue
        warnings.warn(f"{name} has no effect any more", DeprecationWarning, stacklevel=2)
        if DROPPED[name] and not value:
            del left[:1]
    return parser.parse_args(kept)


def configured(args: argparse.Namespace) -> RunConfig:
    """The run's settings; ``ConfigError`` where they make no sense."""
    for flag, on in (("ghs_buffer", args.ghs), ("poi_buffer", args.poi), ("ghs_s_buffer", args.ghs_s), ("ghs_s_max", args.ghs_s)):
        if on and getattr(args, flag) <= 0:
            raise ConfigError(f"--{flag.replace('_', '-')} must be positive")
    if not args.workers.lstrip("-").isdigit() or int(args.workers) <= 0:
        raise ConfigError("--workers must be positive")
    if not formats(args):
        raise ConfigError("no output format")
    limits = Limits(args.curv or 0.0, args.minlen or 0.0, args.radius or 0.0, (args.center_lat, args.center_lon))
    return RunConfig(
        resolve_city(args.city or args.city_arg or "voronezh"),
        include=frozenset(parse_types(args.type)),
        exclude=frozenset(parse_types(args.no_type)),
        only=args.route or "",
        most_number=args.max_route_number,
        active_only=args.active_only,
        limits=limits,
        volume_buffer_m=args.ghs_buffer,
        poi_buffer_m=args.poi_buffer,
        dedup=args.dedup,
        dedup_buffer_m=args.dedup_buffer,
        dedup_threshold=args.dedup_threshold,
        dedup_passes=args.dedup_passes,
        center_weight=args.dedup_center_weight,
        heat_cell_km=args.heat_cell,
        heat_percent=args.heat_top,
        heat_gamma=args.heat_gamma,
        generate=args.gen_count if args.generate else 0,
    )


def formats(args: argparse.Namespace) -> set[str]:
    return {f.strip().lower() for f in args.format.split(",") if f.strip()}


def run(args: argparse.Namespace, spark: SparkSession) -> list[str]:
    """One run: the paths of what was written."""
    from pyspark.sql import functions as F

    from .operators import geometry, mosaic
    from .plans.network import Network
    from .sources import files

    config = configured(args)
    if not args.tables:
        raise ConfigError("--tables must name the folder with the city's tables")
    read = lambda name: spark.read.parquet(os.path.join(args.tables, f"{name}.parquet"))
    tiles = read("tiles") if os.path.exists(os.path.join(args.tables, "tiles.parquet")) else None
    cache = None
    if tiles is not None and not args.no_cache:
        cache = mosaic.CorridorCache(spark, os.path.join(os.path.abspath(args.cache_dir), "corridors"), read=not args.refresh)
    network = Network(config, *map(read, ("routes", "points", "stops", "pois", "pixels")), tiles=tiles, cache=cache, paths=(os.path.abspath(args.tables),))
    base, done = args.output or f"{config.city}_routes", []
    base = base[:-5] if base.lower().endswith(".xlsx") else base
    try:
        if "xlsx" in formats(args):
            network.workbook(f"{base}.xlsx", all_stops=args.stops)
            done.append(f"{base}.xlsx")
        if "kml" in formats(args):
            lines = geometry.direction_km(network.points).select("route_id", "di", F.round("km", 2).alias("km"))
            files.placemarks(network.points, network.all_routes, lines).write.mode("overwrite").json(f"{base}.kml.json")
            done.append(f"{base}.kml.json")
        text = files.error_block(network.states).first().text
        if text:
            print(text)
    finally:
        network.close()
    return done


def main(argv: Sequence[str] | None = None) -> int:
    """The exit code: 0, or 1 where a command of a batch failed. Settings that make no sense end with their text."""
    from .plans import batch
    from .sources import files

    args = parse_arguments(sys.argv[1:] if argv is None else argv)
    session = lambda: SparkSession.builder.appName("transitloom").getOrCreate()
    if args.batch:
        commands = [r.command for r in files.batch_commands(session(), args.batch).orderBy("place").collect()]  # a small file
        outcomes, code = batch.run_all(commands, lambda command: run(parse_arguments(shlex.split(command)), session()))
        for one in outcomes:
            print(f"{'failed' if one.error else 'done'}: {one.command}" + (f" ({one.error})" if one.error else ""))
        return code
    try:
        configured(args)
        for path in run(args, session()):
            print(path)
    except ConfigError as wrong:
        sys.exit(str(wrong))
    return 0

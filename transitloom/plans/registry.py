"""Registered queries of the engine, by operator id, and their DuckDB SQL."""

from __future__ import annotations

from . import geometry_queries, network_queries, overlap_queries, raster_queries, small_queries, source_queries

_MODULES = (geometry_queries, network_queries, overlap_queries, raster_queries, source_queries, small_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.REGISTER.queries.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.REGISTER.sql.items()}
FLAGSHIP = "f7_route_limits"

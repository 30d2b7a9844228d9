"""How a module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .surrogate import Views, with_views


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        """Registers a function of ``Views`` under a name, with the SQL that gives the same rows."""

        def add(build: Callable[[Views], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
            if sql:
                self.sql[name] = with_views(sql)
            return build

        return add

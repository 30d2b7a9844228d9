"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def components(edges: DataFrame, label: str) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a long, b long)``: comp is the smallest node linked to it.

    Alternating large-star and small-star rounds; each is a grouped minimum (combined before the
    shuffle), written, and an equi-join of two tables as they are exchanged, which AQE splits where one centre has very many neighbours. The
    number of edges never grows over twice the nodes plus edges, and each round ends as a table.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )

    def star(both: DataFrame) -> DataFrame:
        least = written(both.groupBy("u").agg(F.min("v").alias("m")), f"{label}-least")
        return both.join(least.hint("merge"), "u")

    before = None
    while True:
        either = now.union(now.select("v", "u"))
        large = written(star(either).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), label)
        small = (
            star(large)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = written(small, label)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())

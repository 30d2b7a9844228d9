"""Groups of equal rows, such as directions along the same streets: what is found for one of them holds for all.

Costly steps run over the first group of each shape, and an equi-join gives the others its results. No group is left out, and
groups of shapes of their own are as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written

#: Members of a group that go as one row until pairs of groups become pairs of members, about so many; of the inner ones, those that repeat in a run.
BLOCK, RUN = 2048, 256


def alike(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """by, first: every group with the least group of the same shape, that is with equal ``columns``, to the last bit, in the same order."""
    line = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("order"), *columns)))
    text = F.to_json(F.transform(line, lambda p: F.struct(*(p[c].alias(c) for c in columns))))
    shapes = written(rows.groupBy(*by).agg(F.sha2(text, 256).alias("shape")), "shapes")
    first = shapes.groupBy("shape").agg(F.min(F.struct(*by)).alias("first"))
    return written(shapes.join(first, "shape").select(*by, "first"), "alike")


def firsts(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the first group of each shape."""
    return rows.join(groups.where(F.struct(*by) == F.col("first")).select(*by), by, "left_semi")


def for_all(results: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Results ``(by, ...)`` of first groups as results of all."""
    return results.withColumn("first", F.struct(*by)).drop(*by).join(groups, "first").select(*results.columns)


def in_blocks(members: DataFrame, by: list[str], member: str | Column, name: str) -> DataFrame:
    """by, block, of_group, and the members of a group in lists of about ``BLOCK``."""
    sizes = members.groupBy(*by).agg(F.count("*").alias("of_group"))
    one = members.select(*by, (F.col(member) if isinstance(member, str) else member).alias("member"))
    block = F.pmod(F.xxhash64("member"), F.ceil(F.col("of_group") / BLOCK)).alias("block")
    return one.join(sizes, by).groupBy(*by, block, "of_group").agg(F.collect_list("member").alias(name)).select(*by, name, "block", "of_group")


def dealt(items: DataFrame, *by: str) -> DataFrame:
    """Items, of few bytes but many rows each to come, over all tasks; a given number, as by their bytes tasks would be merged."""
    spark = items.sparkSession
    return items.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def product(items: DataFrame, x: str, xs: str, y: str, ys: str, others: list[str]) -> DataFrame:
    """A row for each x of the list ``xs`` with each y of ``ys``, for each item.

    By runs of ``RUN`` ys: x and all else stay the same for a run, and the run repeats for each x, so that a file of the rows is a small part of what it would be in another order.
    """
    runs = F.transform(F.sequence(F.lit(0), (F.size(ys) - 1).cast("int"), F.lit(RUN)), lambda k: F.slice(ys, k + 1, RUN))
    cut = items.select(xs, F.explode(runs).alias("run"), *others)
    return cut.select(F.explode(xs).alias(x), "run", *others).select(x, F.explode("run").alias(y), *others)

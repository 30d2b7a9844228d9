"""Written intermediate tables and rows numbered in an order, at any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a session on this machine alone may leave it unset, and gets a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-transitloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/transitloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, a lost executor costs nothing.

    The tables stay until whoever owns the shared folder clears it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with a column of the rows' places from 1 on in an order, which must leave no ties.

    The rows are exchanged by ranges of the order and written; a place is the number of rows in the ranges
    before plus the place in the range. Nothing but a count per range is brought together.
    """
    placed = df.repartitionByRange(*order).withColumn("range_of_row", F.spark_partition_id())
    within = Window.partitionBy("range_of_row").orderBy(*order)
    placed = written(placed, "ranges").withColumn("place_in_range", F.row_number().over(within))
    before = Window.orderBy("range_of_row").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("range_of_row").agg(F.count("*").alias("rows_in_range"))  # a row a range
    firsts = counts.select("range_of_row", F.coalesce(F.sum("rows_in_range").over(before), F.lit(0)).alias("rows_before"))
    place = (F.col("rows_before") + F.col("place_in_range")).cast("bigint")
    return placed.join(firsts, "range_of_row").withColumn(name, place).select(*df.columns, name)

"""New payload files parsed as they arrive; a route's latest version replaces its directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.payloads import parse_payloads


def payload_stream(spark: SparkSession, folder: str) -> DataFrame:
    """route_id, payload, version from JSON files with those fields."""
    return spark.readStream.schema("route_id long, payload string, version long").json(folder)


def upsert_directions(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parses each batch's latest payload of a route and adds it to ``target`` under its version; started with what is there."""

    def add(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("route_id").agg(F.max_by("payload", "version").alias("payload"), F.max("version").alias("version"))
        parsed = parse_payloads(latest.select("route_id", "payload")).join(latest.select("route_id", "version"), "route_id")
        parsed.write.mode("append").parquet(target)

    return payload_stream(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_directions(spark: SparkSession, target: str) -> DataFrame:
    """The directions of each route's latest version."""
    every = spark.read.parquet(target)
    last = every.groupBy("route_id").agg(F.max("version").alias("version"))
    return every.join(last, ["route_id", "version"], "left_semi")

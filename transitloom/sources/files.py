"""Key-value caches, command files and the written results: tables, map files, a workbook's sheets."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import type_label
from ..tables import written

#: Longest value that a cache keeps, in bytes.
GREATEST_ENTRY = 8 * 1024 * 1024
# What a batch line may begin with.
COMMAND_PREFIX = r"^(?:python(?:3)?\s+)?(?:-m\s+\S+\s+|\S+\.py\s+)?"


def source_signature(paths: Column, buffer_m: Column) -> Column:
    """Of the files and the buffer that a result was made with."""
    return F.substring(F.md5(F.concat(F.array_join(paths, ";"), F.lit("|"), F.format_string("%.0f", buffer_m.cast("double")))), 1, 12)


def cache_key(kind: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind + ":"), key), 256)


class JsonCache:
    """Values by kind and key in a Parquet folder, one version a key: the last that was put."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, kind: str, rows: DataFrame) -> None:
        """Appends ``(key, value)``; values that are no JSON or too long are not kept."""
        fit = (F.octet_length("value") <= GREATEST_ENTRY) & F.try_parse_json("value").isNotNull()
        kept = rows.where(fit).select(cache_key(kind, F.col("key")).alias("digest"), "value", F.current_timestamp().alias("put_at"))
        kept.write.mode("append").parquet(f"{self.folder}/kind={kind}")

    def get(self, kind: str, keys: DataFrame) -> DataFrame:
        """``keys(key)`` with their value, null where there is none."""
        try:
            stored = self.spark.read.parquet(f"{self.folder}/kind={kind}")
        except Exception as missing:  # a kind that was never put has no folder
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return keys.withColumn("value", F.lit(None).cast("string"))
        last = stored.groupBy("digest").agg(F.max(F.struct("put_at", "value"))["value"].alias("value"))  # of two put at once the larger
        return keys.withColumn("digest", cache_key(kind, F.col("key"))).join(last, "digest", "left").drop("digest")


    def compacted(self, folder: str, kinds: Sequence[str]) -> JsonCache:
        """The last versions of these kinds in another folder; this one stays until its owner clears it."""
        for kind in kinds:
            last = self.spark.read.parquet(f"{self.folder}/kind={kind}").groupBy("digest").agg(F.max(F.struct("put_at", "value")).alias("last"))
            last.select("digest", "last.value", "last.put_at").write.parquet(f"{folder}/kind={kind}")
        return JsonCache(self.spark, folder)


class ResultTable:
    """Results under the digest of what they were made of, ``(key string, columns)``, in a Parquet folder.

    A key is never made anew: whoever asks for rows names their keys, and only keys that are not there are computed. Rows
    that two writers add at once under a key are equal, as they were made of the same, and are read once.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, read: bool = True, write: bool = True):
        self.spark, self.folder, self.read, self.write = spark, folder, read, write
        self.schema = f"key string, {schema}"

    def rows(self) -> DataFrame:
        try:
            stored = self.spark.read.schema(self.schema).parquet(self.folder)
        except Exception as missing:  # nothing was added yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            stored = self.spark.createDataFrame([], self.schema)
        return stored.dropDuplicates(["key"])

    def of(self, keys: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``keys(key, ...)`` with the columns of the results; ``compute`` gets the rows of keys that are not there and returns ``key`` and the columns."""
        known = self.rows() if self.read else self.rows().limit(0)
        unknown = written(keys.join(known.select("key"), "key", "left_anti"), "unknown-results")
        if not unknown.isEmpty():
            fresh = written(compute(unknown).select(*known.columns).dropDuplicates(["key"]), "fresh-results")
            if self.write:
                fresh.join(self.rows().select("key"), "key", "left_anti").write.mode("append").parquet(self.folder)
            known = known.unionByName(fresh).dropDuplicates(["key"])
        return keys.join(known, "key", "left")

    def compacted(self, folder: str) -> ResultTable:
        """The same results, each once, in another folder; this one stays until its owner clears it."""
        self.rows().repartition("key").write.parquet(folder)
        return ResultTable(self.spark, folder, self.schema.split(", ", 1)[1])


def batch_commands(spark: SparkSession, path: str) -> DataFrame:
    """place, command: the command lines of a batch file, each once, in order.

    The file is UTF-8, or else windows-1251. Blank lines, comments, lines that begin with an option and lines that start a batch again are skipped.
    """

    def decode(raw: bytes) -> str:  # a small file
        try:
            return raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            return raw.decode("cp1251")

    whole = spark.read.format("binaryFile").load(path).select(F.pandas_udf(lambda raw: raw.map(decode), "string")("content").alias("value"))
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("place", "line"))
    body = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\x{FEFF}", ""), r"\s+#.*$", ""))
    commands = lines.select("place", F.trim(F.regexp_replace(body, COMMAND_PREFIX, "")).alias("command"), body.alias("body"))
    kept = commands.where((F.col("body") != "") & ~F.startswith("body", F.lit("#")) & ~F.startswith("body", F.lit("-")) & ~F.col("command").rlike(r"(^|\s)--batch\b"))
    return kept.groupBy("command").agg(F.min("place").alias("place")).select("place", "command")


def output_base_name(output: str | None, slug: str) -> str:
    """A file name's stem, or one made of the city's slug."""
    if output:
        return re.sub(r"\.(xlsx|kml)$", "", output, flags=re.I)
    return re.sub(r"\W+", "_", slug.lower()).strip("_") + "_routes"


def xml_text(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def placemarks(points: DataFrame, routes: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """folder, route_id, di, xml: a KML placemark for each direction of two or more points, with its statistics' lines."""
    at = F.concat_ws(",", F.format_string("%.6f", "lon"), F.format_string("%.6f", "lat"), F.lit("0"))
    lines = points.groupBy("route_id", "di").agg(F.array_sort(F.collect_list(F.struct("seq", at.alias("at")))).alias("line")).where(F.size("line") >= 2)
    named = lines.join(routes.select("route_id", "name", "route_type"), "route_id")
    text = F.lit("")
    if stats is not None:
        extra = [c for c in stats.columns if c not in ("route_id", "di")]
        named = named.join(stats, ["route_id", "di"], "left")
        text = F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in extra])
    way = F.when(F.col("di") == 0, "туда").otherwise("обратно")
    xml = F.concat(
        F.lit("<Placemark><name>"), xml_text(F.concat("name", F.lit(" ("), way, F.lit(")"))), F.lit("</name><styleUrl>#"), F.col("route_type"), F.lit("</styleUrl><description>"), xml_text(text),
        F.lit("</description><LineString><coordinates>"), F.array_join(F.transform("line", lambda p: p["at"]), " "), F.lit("</coordinates></LineString></Placemark>"),
    )
    return named.select(type_label(F.col("route_type")).alias("folder"), "route_id", "di", xml.alias("xml"))


def kml_lines(marks: DataFrame) -> DataFrame:
    """place, line: a KML document of the placemarks, a folder a type, in order."""
    order = Window.partitionBy("folder").orderBy("route_id", "di")
    body = marks.select(F.col("folder"), F.lit(1).alias("part"), F.row_number().over(order).alias("n"), F.col("xml").alias("line"))
    folders = marks.select("folder").distinct()
    heads = folders.select("folder", F.lit(0).alias("part"), F.lit(0).alias("n"), F.concat(F.lit("<Folder><name>"), xml_text(F.col("folder")), F.lit("</name>")).alias("line"))
    feet = folders.select("folder", F.lit(2).alias("part"), F.lit(0).alias("n"), F.lit("</Folder>").alias("line"))
    return body.unionByName(heads).unionByName(feet)


def write_kml(marks: DataFrame, folder: str) -> None:
    """A text file for each type of transport under ``folder``, sorted within."""
    kml_lines(marks).repartition("folder").sortWithinPartitions("folder", "part", "n").select("folder", "line").write.mode("overwrite").partitionBy("folder").text(folder)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """A CSV folder with a header for each sheet of a workbook, in their order by number."""
    for n, (name, rows) in enumerate(sheets.items(), 1):
        rows.write.mode("overwrite").option("header", True).csv(f"{folder}/{n:02d}_{name}")


def resolved(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """path: the files at or below a path with one of the extensions, in order; only their names are read."""
    glob = "*{" + ",".join(e.lower() for e in extensions) + "," + ",".join(e.upper() for e in extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path").orderBy("path")


def cached_or_fetched(cache: JsonCache, kind: str, tasks: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, value, from_cache of ``tasks(key)``: what the cache has, and of the others what ``fetch(tasks)`` brings, which the cache then keeps."""
    known = cache.get(kind, tasks.select("key").distinct())
    fetched = written(fetch(known.where("value IS NULL").select("key")).select("key", "value"), "fetched")
    had = known.where("value IS NOT NULL").select("key", "value", F.lit(True).alias("from_cache"))
    out = written(had.unionByName(fetched.withColumn("from_cache", F.lit(False))), "loaded")  # before the cache changes
    cache.put(kind, fetched)
    return out


def error_block(states: DataFrame, limit: int = 5) -> DataFrame:
    """One row, text: how many routes failed and the first of them by number, a line each; empty where none did."""
    bad = states.where("state = 'bad'")
    first = bad.orderBy("route_id").limit(limit).agg(F.array_sort(F.collect_list(F.struct("route_id", F.concat(F.lit("    "), type_label(F.col("route_type")), F.lit(" "), "name", F.lit(": "), "error").alias("line")))).alias("l"))
    total = bad.agg(F.count("*").alias("n"))  # a row each
    head = F.concat(F.lit("⚠ Ошибки ("), F.col("n").cast("string"), F.lit("):"))
    return first.join(total).select(F.when(F.col("n") == 0, "").otherwise(F.array_join(F.concat(F.array(head), F.transform("l", lambda x: x["line"])), "\n")).alias("text"))

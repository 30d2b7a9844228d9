"""Deterministic transport tables over the driver's tables, in Spark and, as CTEs, in DuckDB.

One definition serves both engines where they agree; ``{name}`` stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_POINTS = """
SELECT s_suppkey AS route_id, di, seq,
       51.6 + CAST(100 * (s_suppkey % 6) + 3 * (s_suppkey % 4) + di AS DOUBLE) / 10000 AS lat,
       39.1 + CAST(20 * ((s_suppkey * 7) % 20 + CASE WHEN di = 0 THEN seq ELSE 6 + s_suppkey % 9 - seq END) AS DOUBLE) / 10000 AS lon
FROM """

SPARK = {
    "routes": """
SELECT s_suppkey AS route_id,
       concat(CASE WHEN s_suppkey % 7 = 3 THEN 'э' ELSE '' END, CAST(s_suppkey AS STRING),
              CASE WHEN s_suppkey % 11 = 5 THEN ' (экспресс)' ELSE '' END) AS name,
       CASE s_nationkey % 10 WHEN 0 THEN 'trolleybus' WHEN 1 THEN 'tram' WHEN 2 THEN 'water' WHEN 3 THEN 'bus'
            WHEN 4 THEN 'minibus' WHEN 5 THEN 'metro' WHEN 6 THEN 'train' WHEN 7 THEN 'funicular'
            WHEN 8 THEN 'cable' ELSE 'electrobus' END AS route_type,
       s_acctbal >= 0 AS active,
       CASE WHEN s_suppkey % 13 = 12 THEN 'no geometry' END AS error
FROM {supplier}""",
    "points": _POINTS
    + """(SELECT s_suppkey, d AS di, q AS seq FROM {supplier}
      LATERAL VIEW explode(array(0, 1)) AS d LATERAL VIEW explode(sequence(0L, 6 + s_suppkey % 9)) AS q)""",
    "zigzag": """
SELECT l_orderkey AS route_id, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS di,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_linestatus
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS BIGINT) AS seq,
       51.6 + CAST((l_partkey * 7919) % 2000 AS DOUBLE) / 10000 AS lat,
       39.1 + CAST((l_partkey * 104729) % 2000 AS DOUBLE) / 10000 AS lon
FROM {lineitem}""",
    "stops_seq": """
SELECT l_suppkey AS route_id, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS di,
       CAST(row_number() OVER (PARTITION BY l_suppkey, l_linestatus
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS BIGINT) AS seq,
       CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS stop_id,
       concat('  ', upper(p_name), ' (', p_brand, ') ') AS stop_name,
       CASE WHEN l_linenumber % 4 <> 0 THEN 51.6 + CAST((l_partkey * 7919) % 2000 AS DOUBLE) / 10000 END AS lat,
       CASE WHEN l_linenumber % 4 <> 0 THEN 39.1 + CAST((l_partkey * 104729) % 2000 AS DOUBLE) / 10000 END AS lon
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "departures": """
SELECT user_id AS route_id, event_id,
       concat(CAST(hour(ts) AS STRING), ':', lpad(CAST(minute(ts) AS STRING), 2, '0')) AS hhmm,
       event_type IN ('view', 'click', 'purchase') AS weekday,
       event_type IN ('purchase', 'signup') AS weekend
FROM {events}""",
    "pois": """
SELECT c_custkey AS poi_id, c_mktsegment AS poi_type,
       CASE WHEN c_custkey % 9 <> 4 THEN c_name END AS name,
       51.59 + CAST((c_custkey * 7919) % 700 AS DOUBLE) / 10000 AS lat,
       39.09 + CAST((c_custkey * 104729) % 800 AS DOUBLE) / 10000 AS lon
FROM {customer}""",
    "pixels": """
SELECT (r % 2) * 2 + c % 2 AS tile_id, r AS row_no, c AS col_no,
       51.66 - CAST(r AS DOUBLE) / 1000 AS lat, 39.10 + CAST(c AS DOUBLE) / 1000 AS lon,
       CASE WHEN (r * 31 + c * 17) % 50 = 0 THEN CAST(4294967295 AS DOUBLE) ELSE CAST((r * 31 + c * 17) % 1000 AS DOUBLE) END AS raw_value
FROM (SELECT DISTINCT l_partkey % 64 AS r, l_orderkey % 64 AS c FROM {lineitem}) AS cells""",
    "edges": """
SELECT DISTINCT least(l_suppkey, l_partkey % 50) AS x, greatest(l_suppkey, l_partkey % 50) AS y,
       CAST(50 + (least(l_suppkey, l_partkey % 50) * 7 + greatest(l_suppkey, l_partkey % 50) * 13) % 50 AS DOUBLE) / 100 AS kmax
FROM {lineitem} WHERE l_suppkey <> l_partkey % 50""",
    "ghs": """
SELECT p_partkey AS node, CAST((p_partkey * 7919) % 100003 AS DOUBLE) AS volume,
       CAST((p_partkey * 7919) % 4 AS DOUBLE) AS volume_tied
FROM {part}""",
}

DUCKDB = {name: re.sub(r"\{(\w+)\}", r"\1", text.replace("AS STRING", "AS VARCHAR")) for name, text in SPARK.items()} | {
    "points": _POINTS + "(SELECT s_suppkey, unnest([0, 1]) AS di, seqs FROM (SELECT s_suppkey, range(0, 7 + s_suppkey % 9) AS seqs FROM supplier) AS a) AS b, unnest(seqs) AS u(seq)"
}


class Views:
    """``views.points`` and the like as DataFrames; a name that is no surrogate is a base table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SPARK:
            return self.base(name)
        text = SPARK[name]
        return self.spark.sql(text, **{t: self.base(t) for t in set(re.findall(r"\{(\w+)\}", text))})


def with_views(sql: str) -> str:
    """The SQL with the CTEs of every ``v_...`` that it names; ``{hav a b c d}`` becomes a great-circle distance."""

    def distance(m: re.Match) -> str:
        a, b, c, d = m[1].split()
        h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
        return f"(12742.0 * asin(sqrt(least(1.0, greatest(0.0, {h})))))"

    sql = re.sub(r"\{hav ([^}]*)\}", distance, sql)
    names = [n for n in DUCKDB if re.search(rf"\bv_{n}\b", sql)]
    ctes = ",\n".join(f"v_{n} AS ({DUCKDB[n]})" for n in names)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"

"""The geographic and text rules as SQL functions, which the optimiser sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DEFINITIONS = {
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": (
        "12742.0D * asin(sqrt(least(1.0D, greatest(0.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))))"
    ),
    "valid_point(lat DOUBLE, lon DOUBLE) RETURNS BOOLEAN": "coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false)",
    "in_box(lat DOUBLE, lon DOUBLE, south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE) RETURNS BOOLEAN": "coalesce(lat BETWEEN south AND north AND lon BETWEEN west AND east, false)",
    "hhmm_minutes(hhmm STRING) RETURNS INT": (
        "CASE WHEN trim(hhmm) RLIKE '^[0-9]{1,2}:[0-9]{2}$' AND int(split(trim(hhmm), ':')[0]) <= 23 AND int(split(trim(hhmm), ':')[1]) <= 59 "
        "THEN int(split(trim(hhmm), ':')[0]) * 60 + int(split(trim(hhmm), ':')[1]) END"
    ),
    "route_number(name STRING) RETURNS BIGINT": "try_cast(regexp_extract(name, '[0-9]+', 0) AS BIGINT)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    for head, body in _DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in _DEFINITIONS]

"""Route payloads: obfuscated JSON to typed routes, stops and schedules.

Values are decoded and parsed in Arrow batches where JSON has no fixed depth; everything with a
known shape is ``from_json`` and column functions.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import valid_point
from ..functions.text import mentions_electrobus, squeeze
from ..operators.network import unshifted

# The key that strings are obfuscated with.
XOR_KEY = (41, 17, 83, 29, 61, 7, 53, 97, 13, 71, 37, 89, 23, 67, 11, 79)

#: What a payload is read as; fields that do not fit become null.
PAYLOAD = (
    "name string, company string, note string, trips array<struct<"
    "coords: array<array<double>>, stops: array<struct<id: string, name: string, lat: string, lon: string>>, "
    "schedules: array<struct<weekDays: array<string>, departureTimes: array<struct<actualDepartureTime: string, sourceTime: string>>>>>>"
)


def decode_text(text: str) -> str:
    """Each UTF-16 unit's code combined with the key at its place."""
    units = text.encode("utf-16-le", "surrogatepass")
    out = bytearray()
    for i in range(0, len(units), 2):
        out += ((int.from_bytes(units[i : i + 2], "little") ^ XOR_KEY[i // 2 % len(XOR_KEY)]) & 0xFFFF).to_bytes(2, "little")
    return out.decode("utf-16-le", "surrogatepass")


def _decoded(value: Any) -> Any:
    if isinstance(value, str):
        return decode_text(value)
    if isinstance(value, list):
        return [_decoded(x) for x in value]
    return {k: _decoded(x) for k, x in value.items()} if isinstance(value, dict) else value


def _decode_batch(raw: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return json.dumps(_decoded(json.loads(text)), ensure_ascii=False) if text is not None else None
        except ValueError:
            return None

    return raw.map(one)


def decode_payload(raw: Column) -> Column:
    """JSON with every string value decoded, keys as they are; null where the text is no JSON."""
    return F.pandas_udf(_decode_batch, "string")(raw)


_CLASS_WORDS = ("class", "capacity")


def _find_class(value: Any) -> Any:
    """The first value, in document order, under a key that names a class or capacity."""
    stack = [value]
    while stack:
        at = stack.pop()
        if isinstance(at, tuple):
            key, inner = at
            if any(w in key.lower() for w in _CLASS_WORDS) and inner not in (None, "", [], {}):
                return inner
            stack.append(inner)
        elif isinstance(at, dict):
            stack += reversed(list(at.items()))
        elif isinstance(at, list):
            stack += reversed(at)
    return None


def _class_text(value: Any) -> str | None:
    if isinstance(value, dict):
        return _class_text(value.get("name") or value.get("title")) or json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return ", ".join(t for t in map(_class_text, value) if t) or None
    return None if value is None or isinstance(value, bool) else str(value).strip() or None


def _class_batch(raw: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return _class_text(_find_class(json.loads(text))) if text is not None else None
        except ValueError:
            return None

    return raw.map(one)


def transport_class(raw: Column) -> Column:
    """What a payload says of its transport class, as text; null without it."""
    return F.pandas_udf(_class_batch, "string")(raw)


def _array_batch(text: pd.Series, start: pd.Series) -> pd.Series:

    def one(s: str | None, at: int) -> str | None:
        at = (s or "").find("[", int(at))
        if at < 0:
            return None
        try:
            _, end = json.JSONDecoder().raw_decode(s[at:])
        except ValueError:
            return None
        return s[at : at + end]

    return pd.Series([one(s, a) for s, a in zip(text, start, strict=True)])


def balanced_array(text: Column, start: Column) -> Column:
    """The JSON array that begins at or after a place, brackets in strings ignored; null if it does not end."""
    return F.pandas_udf(_array_batch, "string")(text, start)


def stop_id(raw: Column) -> Column:
    """Ids that are whole numbers, written as such or with a fraction of zero."""
    return F.regexp_extract(F.trim(raw), r"^(\d+)(?:\.0+)?$", 1).try_cast("bigint")


def stop_of(raw: Column) -> Column:
    """A stop struct with what is valid of id, name and coordinates; null if nothing is."""
    lat, lon = raw["lat"].try_cast("double"), raw["lon"].try_cast("double")
    ident, name = stop_id(raw["id"]), squeeze(F.coalesce(raw["name"], F.lit("")))
    la, lo = F.when(valid_point(lat, F.lit(0.0)), lat), F.when(valid_point(F.lit(0.0), lon), lon)
    empty = ident.isNull() & (name == "") & la.isNull() & lo.isNull()
    return F.when(~empty, F.struct(ident.alias("id"), name.alias("name"), la.alias("lat"), lo.alias("lon")))


def unshift_array(raw: Column) -> Column:
    """Valid points of an array of ``[lat, lon]``: each less the shift of its place, which invalid ones take too."""

    def point(p: Column, i: Column) -> Column:
        lat, lon = unshifted(F.get(p, F.lit(0)), F.get(p, F.lit(1)), i)
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return F.filter(F.transform(raw, point), lambda p: valid_point(p["lat"], p["lon"]))


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """From ``(route_id, payload)``: route_id, di, name, coords, stops.

    Directions with equal coordinates count once, the first; di is the place among those that stay.
    """
    trips = payloads.select("route_id", F.from_json("payload", PAYLOAD).alias("p")).select("route_id", F.posexplode("p.trips").alias("pos", "trip"))
    shaped = trips.select("route_id", "pos", unshift_array(F.col("trip.coords")).alias("coords"), F.filter(F.transform("trip.stops", stop_of), lambda s: s.isNotNull()).alias("stops")).where(F.size("coords") >= 2)
    first = Window.partitionBy("route_id", "coords").orderBy("pos")
    once = shaped.withColumn("turn", F.row_number().over(first)).where("turn = 1")
    di = (F.row_number().over(Window.partitionBy("route_id").orderBy("pos")) - 1).alias("di")
    named = lambda s: F.coalesce(F.nullif(s["name"], F.lit("")), F.lit("?"))
    ends = F.concat(named(F.get("stops", F.lit(0))), F.lit(" → "), named(F.element_at("stops", -1)))
    return once.select("route_id", di, F.when(F.size("stops") > 0, ends).otherwise("? → ?").alias("name"), "coords", "stops")


def service_days(flags: Column) -> tuple[Column, Column]:
    """Whether one of the first five, and of the two flags after them, is on.

    Flags are texts of what the payload has: a number other than 0, true, or a text that does not say no.
    """
    # The texts that say no.
    says_no = ["", "0", "false", "no", "off", "none"]
    plain = lambda d: F.lower(F.trim(d))
    on = lambda d: F.coalesce(~plain(d).isin(*says_no) & ~F.coalesce(plain(d).try_cast("double") == 0, F.lit(False)), F.lit(False))
    days = F.coalesce(flags, F.array().cast("array<string>"))
    return F.exists(F.slice(days, 1, 5), on), F.exists(F.slice(days, 6, 2), on)


def payload_departures(payloads: DataFrame) -> DataFrame:
    """From ``(route_id, payload)``: route_id, hhmm, weekday, weekend of every departure, for ``schedule_summary``."""
    trips = payloads.select("route_id", F.explode(F.from_json("payload", PAYLOAD)["trips"]).alias("t")).select("route_id", F.explode("t.schedules").alias("s"))
    weekday, weekend = service_days(F.col("s.weekDays"))
    times = trips.select("route_id", weekday.alias("weekday"), weekend.alias("weekend"), F.explode("s.departureTimes").alias("d"))
    return times.select("route_id", F.coalesce(F.nullif("d.actualDepartureTime", F.lit("")), "d.sourceTime").alias("hhmm"), "weekday", "weekend")


def lng_lat_pairs(text: Column) -> Column:
    """Valid points of ``[lng, lat]`` pairs in a text, as lat and lon."""
    pair = r"\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]"
    lng, lat = (F.transform(F.regexp_extract_all(text, F.lit(pair), k), lambda x: x.cast("double")) for k in (1, 2))
    return F.filter(F.zip_with(lat, lng, lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))), lambda p: valid_point(p["lat"], p["lon"]))


def idea_line(pages: DataFrame) -> DataFrame:
    """From ``(idea_id, html)``: the longest coordinate array of each page, without repeats and the closing point."""
    lists = F.regexp_extract_all("html", F.lit(r'"coordinates"\s*:\s*(\[(?:\s*\[[^\[\]]*\]\s*,?)*\s*\])'), 1)
    lines = pages.select("idea_id", F.explode_outer(F.transform(lists, lng_lat_pairs)).alias("line"))
    longest = lines.groupBy("idea_id").agg(F.max_by("line", F.struct(F.size("line"), "line")).alias("line"))
    open_line = F.when((F.size("line") > 2) & (F.get("line", F.lit(0)) == F.element_at("line", -1)), F.slice("line", 1, F.greatest(F.size("line") - 1, F.lit(0)))).otherwise(F.col("line"))
    opened = longest.select("idea_id", open_line.alias("line"))
    return opened.select("idea_id", F.filter("line", lambda p, i: (i == 0) | (p != F.get("line", i - 1))).alias("line"))


def is_electrobus(payload: Column, page_text: Column | None = None) -> Column:
    """Whether a payload's flag, name, company, note, transport classes or tags, or its page's text, tell of an electrobus."""
    # Where a payload may tell it.
    places = ["$.name", "$.company", "$.note", "$.transportClasses[*].name", "$.transportTags[*].name"]
    flag = F.lower(F.get_json_object(payload, "$.is_electrobus"))
    flagged = F.coalesce(~flag.isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))
    return flagged | mentions_electrobus(*(F.get_json_object(payload, p) for p in places), F.lit(None).cast("string") if page_text is None else page_text)


class _Texts(HTMLParser):
    """The texts of a page, each with the elements that it is in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.texts: list[tuple[str, tuple[int, ...]]] = []
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in ("br", "hr", "img", "input", "link", "meta"):
            self.count += 1
            self.open.append((tag, self.count))

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), -1)
        if at >= 0:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.texts.append((data, tuple(n for _, n in self.open)))


def _labelled_class(page: str | None) -> str:
    # Fixed value: the label of transport classes; how far above it their text may be.
    label, levels = re.compile(r"Классы\s+транспорта"), 4
    parser = _Texts()
    parser.feed(page or "")
    parser.close()
    within = next((path for text, path in parser.texts if label.search(text)), None)
    if within is None or len(within) + 1 < levels:  # the document itself is the uppermost
        return ""
    around = within[: len(within) + 1 - levels]
    pieces = [" ".join(text.split()) for text, path in parser.texts if path[: len(around)] == around]
    found = re.search(r"Классы\s+транспорта:?\s*(.+)", " ".join(p for p in pieces if p))
    value = found[1].strip() if found else ""
    return "" if value == "-" else value


def labelled_class(html: Column) -> Column:
    """What a page says behind the label of transport classes, up to the end of the element three above the label's own; else empty."""
    return F.pandas_udf(lambda pages: pages.map(_labelled_class), "string")(html)


def metadata(payload: Column, page: Column) -> Column:
    """A struct: transport_class of the payload, else of the page's label; is_electrobus by both."""
    own = F.coalesce(transport_class(payload), F.lit(""))
    said = F.when(own != "", own).otherwise(labelled_class(page))
    return F.struct(said.alias("transport_class"), is_electrobus(payload, page).alias("is_electrobus"))

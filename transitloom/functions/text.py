"""Text functions on columns: names, labels, markers, numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of transport types, and the words that tell types in titles, in the order they are tried.
TYPE_LABELS = {
    "trolleybus": "Троллейбус",
    "tram": "Трамвай",
    "water": "Водный транспорт",
    "bus": "Автобус",
    "minibus": "Маршрутное такси",
    "metro": "Метро",
    "train": "Поезд",
    "funicular": "Фуникулёр",
    "cable": "Канатная дорога",
    "electrobus": "Электробус",
}
SECTION_WORDS = [
    ("metro", ["метро", "metro", "subway", "underground"]),
    ("funicular", ["фуникул", "funicular"]),
    ("cable", ["канат", "cable", "ropeway", "гондол", "подвесн", "кресельн"]),
    ("train", ["поезд", "электрич", "ж/д", "rail", "train", "пригород"]),
    ("electrobus", ["электробус", "electrobus"]),
    ("trolleybus", ["троллейбус", "trolleybus"]),
    ("tram", ["трамва", "tram"]),
    ("water", ["водн", "катер", "теплоход", "речн", "паром", "причал", "water", "ferry", "boat", "ship"]),
]
MINIBUS_WORDS = ["маршрут", "minibus", "marshrut"]
IDEA_WORDS = [
    ("trolleybus", ["троллейбус", "трол."]),
    ("bus", ["автобус", "электробус", "авто."]),
    ("minibus", ["маршрутка", "маршрутки", "маршруток", "маршрутное такси", "марш."]),
    ("tram", ["трамвай", "трамваи", "трамваев", "трам."]),
]

_SPACES = r"(?U)\s+"


def squeeze(x: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, _SPACES, " "), "^ | $", "")


def _bare(x: Column) -> Column:
    """Without punctuation and spaces at the ends."""
    return F.regexp_replace(x, r"^[ ,;:!?.\-]+|[ ,;:!?.\-]+$", "")


def normalize_terminal(name: Column) -> Column:
    """Lower case without quotation marks, the apostrophe and the backtick among them; empty for null."""
    # The marks.
    plain = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "[«»\"'’`]", ""))
    return _bare(squeeze(plain))


def clean_terminal_name(name: Column) -> Column:
    """Without balanced parentheses, nested to any depth: a round for each that opens."""
    opened = F.length(name) - F.length(F.replace(name, F.lit("("), F.lit("")))
    rounds = F.array_repeat(F.lit(0), F.coalesce(opened, F.lit(0)))
    return squeeze(F.aggregate(rounds, name, lambda x, _: F.regexp_replace(x, r"\([^()]*\)", "")))


def normalize_stop_name(name: Column) -> Column:
    """Lower case, white space squeezed, without punctuation at the ends; empty for null."""
    return _bare(squeeze(F.lower(F.coalesce(name, F.lit("")))))


def route_number(name: Column) -> Column:
    """The first run of digits as a number; null without one or beyond a long."""
    return F.regexp_extract(name, r"\d+", 0).try_cast("bigint")


def passes_number_filter(name: Column, most: int) -> Column:
    if most <= 0:
        return F.lit(True)
    plain = ~F.contains(name, F.lit("(")) & ~F.contains(name, F.lit(")"))
    return F.coalesce(plain & (route_number(name) <= most), F.lit(False))


def type_label(route_type: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, route_type), route_type)


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def classify_section(title: Column) -> Column:
    text = F.lower(title)
    kind = F.when(F.lit(False), F.lit(""))
    for name, words in SECTION_WORDS:
        kind = kind.when(_any(text, words), name)
    bus = F.contains(text, F.lit("автобус")) | (F.contains(text, F.lit("bus")) & ~F.contains(text, F.lit("trolley")))
    return kind.when(bus, "bus").when(_any(text, MINIBUS_WORDS), "minibus")


def idea_type(title: Column, heading: Column) -> Column:
    """From the heading, else the title, else bus."""

    def of(x: Column) -> Column:
        kind = F.when(F.lit(False), F.lit(""))
        for name, words in IDEA_WORDS:
            kind = kind.when(_any(F.lower(x), words), name)
        return kind

    return F.coalesce(of(heading), of(title), F.lit("bus"))


def mentions_electrobus(*texts: Column) -> Column:
    return F.exists(F.array(*texts), lambda x: F.coalesce(F.contains(F.lower(x), F.lit("электробус")), F.lit(False)))


def idea_rating(text: Column) -> tuple[Column, Column]:
    """``4,5 (12)`` to 4.5 and 12; nulls where there is no number."""
    pattern = r"^\s*(-?\d+(?:[.,]\d+)?)\s*(?:\((\d+)\))?"
    value = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("."))
    return value.try_cast("double"), F.regexp_extract(text, pattern, 2).try_cast("bigint")


def minutes(value: Column) -> Column:
    """``H:MM`` or ``HH:MM`` of a day as minutes; null for anything else."""
    pattern = r"^\s*(\d{1,2}):(\d{2})\s*$"
    h, m = (F.regexp_extract(value, pattern, k).try_cast("int") for k in (1, 2))
    return F.when((h <= 23) & (m <= 59), h * 60 + m)


def clock(value: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(value / 60).cast("int"), (value % 60).cast("int"))


def unit_name(name: Column, di: Column) -> Column:
    way = F.when(di == 0, "туда").when(di == 1, "обратно").otherwise(F.concat(F.lit("направление "), (di + 1).cast("string")))
    return F.concat(name, F.lit(" ("), way, F.lit(")"))


def curvature_text(value: Column) -> Column:
    return (
        F.when(value.isNull() | F.isnan(value), "")
        .when(value == float("inf"), "∞")
        .otherwise(F.format_string("%.2f", value))
    )


def heat_color(t: Column, alpha: str = "ff") -> Column:
    """aabbggrr of a value from 0 to 1 on a scale of five colours."""
    # Blue, cyan, green, yellow, red.
    scale = [(0, 0, 255), (0, 255, 255), (0, 255, 0), (255, 255, 0), (255, 0, 0)]
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (len(scale) - 1)
    i = F.least(F.floor(x), F.lit(len(scale) - 2)).cast("int")
    part = x - i
    channels = []
    for k in (2, 1, 0):
        lo, hi = (F.get(F.array(*[F.lit(float(c[k])) for c in scale]), j) for j in (i, i + 1))
        channels.append(F.lower(F.lpad(F.hex(F.rint(lo + (hi - lo) * part).cast("bigint")), 2, "0")))
    return F.concat(F.lit(alpha), *channels)


def city_from_url(url: Column, default: Column | None = None) -> Column:
    """The first part of the path, unquoted, that is not "catalog", in lower case; else the default, or null."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    parts = F.filter(F.split(F.lower(plain), "/"), lambda p: (p != "") & (p != "catalog"))
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(None).cast("string") if default is None else default)


def task_url(city: Column, route_id: Column) -> Column:
    """The address of a route's page."""
    return F.concat(F.lit("/"), city, F.lit("?routes="), route_id.cast("string"))


def routes_argument(href: Column) -> Column:
    """The number in a link's ``routes`` argument."""
    return F.regexp_extract(href, r"[?&]routes=(\d+)(?:[&#]|$)", 1).try_cast("bigint")


def page_token(html: Column) -> Column:
    # Fixed value: how a page states its token.
    return F.nullif(F.regexp_extract(html, r"tk:\s*['\"]([a-f0-9-]+)['\"]", 1), F.lit(""))


def city_title(html: Column, slug: Column) -> Column:
    """Text of the first h1, else of the title, else the slug."""

    def tag(name: str) -> Column:
        inner = F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
        return F.nullif(squeeze(F.regexp_replace(inner, "<[^>]*>", " ")), F.lit(""))

    return F.coalesce(tag("h1"), tag("title"), slug)

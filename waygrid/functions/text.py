"""Text expressions: typed lines, keywords, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet of packed numbers.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def way_line(line: Column) -> Column:
    """``[/way] [#id or zone] x y [text]`` as a struct ``map_id, zone, x, y, text``; null where the line is something else.

    The coordinates are the first two numbers in a row, from 0 to 100; a comma may follow the zone and each number.
    """
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"(?i)^\s*(?:/t?way\s+)?(?:#(\d+),?\s+|([^/\s].*?),?\s+)??{number}(?:,\s*|\s+){number},?(?:\s+(.*?))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    x, y = part(3).cast("double"), part(4).cast("double")
    fields = F.struct(part(1).cast("int").alias("map_id"), part(2).alias("zone"), x.alias("x"), y.alias("y"), part(5).alias("text"))
    return F.when(line.rlike(pattern) & x.between(0, 100) & y.between(0, 100), fields)


def way_text(map_id: Column, x: Column, y: Column, name: Column) -> Column:
    return F.format_string("/way #%d %.2f %.2f %s", map_id, x, y, name)


def clean_name(name: Column, most: int = 40) -> Column:
    """Control characters and bars out, blanks single, at most ``most`` characters; null if nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1f|]", " "), r"\s+", " ")), 1, most), F.lit(""))


def first_keyword(text: Column, kinds: list[tuple[str, str]], default: str) -> Column:
    """The kind of the first keyword in list order that the text contains."""
    low = F.lower(text)
    out = F.lit(default)
    for word, kind in reversed(kinds):
        out = F.when(low.contains(word), kind).otherwise(out)
    return out


def is_included(text: Column, deny: list[str], allow: list[str], exclude: list[str], include: list[str]) -> Column:
    """Exact denials first, then exact permissions, then any excluding keyword, then any including one."""
    low = F.lower(text)
    holds = lambda words: F.coalesce(F.greatest(*[low.contains(w) for w in words], F.lit(False)), F.lit(False))
    return F.when(low.isin(deny), False).when(low.isin(allow), True).when(holds(exclude), False).otherwise(holds(include))


def packed_pair(number: Column) -> Column:
    """A number below 4096 as two digits of base 64."""
    digits = F.array(*[F.lit(c) for c in DIGITS])
    return F.concat(F.element_at(digits, (F.floor(number / 64) % 64 + 1).cast("int")), F.element_at(digits, (number % 64 + 1).cast("int")))


def unpacked_pair(pair: Column) -> Column:
    at = lambda i: F.instr(F.lit(DIGITS), F.substring(pair, i, 1)) - 1
    return at(1) * 64 + at(2)


def distance_text(yards: Column) -> Column:
    return F.when(yards < 1000, F.format_string("%d yd", F.floor(yards + 0.5).cast("bigint"))).otherwise(F.format_string("%d.%d k", F.floor(yards / 1000).cast("bigint"), F.floor(yards % 1000 / 100).cast("bigint")))


def turn_text(degrees: Column) -> Column:
    """A turn in words; positive angles are to the left, as headings turn with x north and y west."""
    size, side = F.abs(degrees), F.when(degrees > 0, "left").otherwise("right")
    return F.when(size < 20, "straight on").when(size < 60, F.concat(F.lit("bear "), side)).when(size < 120, F.concat(F.lit("turn "), side)).when(size < 160, F.concat(F.lit("sharp "), side)).otherwise("turn around")


def clock(seconds: Column) -> Column:
    """Minutes and seconds, as ``m:ss``."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("bigint"), whole % 60)


def number_token(token: Column) -> Column:
    """The number of a typed token, which may carry one comma in front and one behind; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(token, "^,", ""), ",$", "")
    return F.when(bare.rlike(r"^-?\d+\.?\d*$"), bare.try_cast("double"))


def map_pin(link: Column) -> Column:
    """A linked map pin ``worldmap:id:u:v`` as a struct ``map_id, u, v`` with fractions of the map; null if it lies off the map."""
    part = lambda i: F.regexp_extract(link, r"^worldmap:(\d+):(\d+):(\d+)", i).try_cast("bigint")
    u, v = part(2) / 10000, part(3) / 10000
    return F.when((u <= 1) & (v <= 1), F.struct(part(1).alias("map_id"), u.alias("u"), v.alias("v")))


def route_tag(name: Column, stops: Column) -> Column:
    return F.format_string("[Route %s: %d %s]", name, stops, F.when(stops == 1, "stop").otherwise("stops"))


def linked_routes(text: Column) -> Column:
    """Tags of routes in a text as links that carry the route's name and its number of stops."""
    return F.regexp_replace(text, r"\[Route ([0-9a-f]+): (\d+) stops?\]", "<route:$1:$2>")


def clean_icon(icon: Column) -> Column:
    """An icon's number, path or name without blanks; null for anything else."""
    bare = F.regexp_replace(icon, r"\s", "")
    return F.when(bare.rlike(r"^[A-Za-z0-9_.\\/-]{1,200}$"), bare)


def shared_message(line: Column, version: str = "1", most: int = 8, limit: float = 30000, levels: tuple[int, ...] = (0, 1)) -> Column:
    """One part of a shared route, ``version, id, i, n, level, x, y, name`` between tabs, as a struct; null where any of it is out of range."""
    pattern = r"^(\d+)\t(\w+)\t(\d+)\t(\d+)\t(-?\d+)\t(-?[\d.]+)\t(-?[\d.]+)\t(.*)$"
    part = lambda i, kind="string": F.regexp_extract(line, pattern, i).try_cast(kind)
    i, n, level, x, y = part(3, "int"), part(4, "int"), part(5, "int"), part(6, "double"), part(7, "double")
    good = line.rlike(pattern) & (part(1) == version) & n.between(1, most) & i.between(1, n) & (F.abs(x) <= limit) & (F.abs(y) <= limit) & level.isin(*levels)
    return F.when(good, F.struct(part(2).alias("id"), i.alias("i"), n.alias("n"), level.alias("level"), x.alias("x"), y.alias("y"), F.nullif(part(8), F.lit("")).alias("name")))

"""Path functions as columns: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_indices(p: Column) -> Column:
    """Without empty and purely numeric segments: a/0/b -> a/b."""
    return F.array_join(F.filter(F.split(p, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), "/")


def flat_name(p: Column) -> Column:
    """One leading slash dropped, the others as ampersands."""
    return F.translate(F.regexp_replace(p, "^/", ""), "/", "&")


def last_segment(p: Column) -> Column:
    return F.regexp_extract(p, "[^/&]*$", 0)


def untensor(p: Column) -> Column:
    """a[]&b -> a/b."""
    return F.translate(p, "&[]", "/")


def split_name(p: Column) -> Column:
    """name[:occurrence][/path] as struct(name, occurrence, path); no occurrence: 0."""
    occurrence = F.regexp_extract(p, "^[^:/]*:([0-9]+)", 1)
    return F.struct(
        F.regexp_extract(p, "^([^:/]*)", 1).alias("name"),
        F.when(occurrence == "", F.lit(0)).otherwise(occurrence.try_cast("int")).alias("occurrence"),
        F.regexp_extract(p, "^[^/]*/(.*)$", 1).alias("path"),
    )


def parent(p: Column) -> Column:
    return F.regexp_extract(p, "^(.*)/[^/]*$", 1)


def with_index(prefix: Column, index: Column, rest: Column) -> Column:
    """prefix[index]/rest."""
    return F.concat(prefix, F.lit("["), index.cast("string"), F.lit("]/"), rest)


def colon_name(p: Column) -> Column:
    return F.replace(p, F.lit("/"), F.lit(":"))


def local_name(full: str, parent: str = "") -> str:
    """The name of an array level below its parent, with & for /."""
    return (full[len(parent) + 1 :] if parent and full.startswith(parent + "/") else full).replace("/", "&")


def chain(levels: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """(local name, index) of open arrays (cumulative path, index), from the root down."""
    above = ["", *[p for p, _ in levels]]
    return [(local_name(p, a), i) for (p, i), a in zip(levels, above)]


def sanitize(path: str, open_arrays: list[str] = ()) -> str:
    """A path below the deepest open array (deepest first) as level/name with & inside either; other levels stay apart."""
    if path in ("", "time", "/time"):
        return path.lstrip("/")
    slash, rest = path.startswith("/"), path.removeprefix("/")
    for level in filter(None, open_arrays):
        if rest == level or rest.startswith(level + "/"):
            parts = [level.replace("/", "&"), rest[len(level) + 1 :].replace("/", "&")]
            break
    else:
        parts = rest.split("/")
    return ("/" if slash else "") + "/".join(p for p in parts if p)


def split_at(p: Column, prefix: str) -> Column:
    """struct(prefix, index, rest) of a path below prefix: a/3/b/c below a is (a, 3, /b/c); null elsewhere."""
    below = F.substr(p, F.lit(len(prefix) + 2))
    index = F.substring_index(below, "/", 1)
    return F.when(p.startswith(prefix + "/"), F.struct(F.lit(prefix).alias("prefix"), index.alias("index"), F.substr(below, F.length(index) + 1).alias("rest")))


def substitute(p: Column, prefix: str, index: Column) -> Column:
    """The path with the index behind prefix replaced; unchanged elsewhere."""
    parts = split_at(p, prefix)
    return F.when(parts.isNotNull(), F.concat(parts["prefix"], F.lit("/"), index.cast("string"), parts["rest"])).otherwise(p)


def bracket_path(p: Column) -> Column:
    """a/0/b/1 as a[0]/b[1]."""
    return F.regexp_replace(p, "/([0-9]+)(?=/|$)", "[$1]")


def parse_index(p: Column) -> Column:
    """struct(name, begin, end, stride) of name[i], name(i:j) or name(i:j:k), ends included in the text and excluded here; null for others."""
    hit = r"^([^\[\(]+)[\[\(](-?\d+)(?::(-?\d+))?(?::(-?\d+))?[\]\)]$"
    part = lambda k: F.regexp_extract(p, hit, k)
    number = lambda k: F.nullif(part(k), F.lit("")).cast("int")
    begin = number(2)
    return F.when(part(1) != "", F.struct(part(1).alias("name"), begin.alias("begin"), (F.coalesce(number(3), begin) + 1).alias("end"), F.coalesce(number(4), F.lit(1)).alias("stride")))

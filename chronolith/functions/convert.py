"""Type conversion, constants and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolith.functions import values

TYPES = {50: "char", 51: "int", 52: "double", 53: "complex"}
MODES = {1: "closest", 2: "previous", 3: "linear"}
ERRORS = {-1: "unknown error", -2: "context error", -3: "backend error", -4: "low-level error"}
EMPTY = {"char": "\0", "int": values.EMPTY_INT, "double": values.EMPTY_DOUBLE}


class RankError(ValueError):
    pass


def name_of(code: int, names: dict[int, str]) -> str:
    """The name of a constant; "" for one that isn't known."""
    return names.get(code, "")


def empty_of(kind: str) -> Column:
    """What stands for a missing value of a type."""
    if kind == "complex":
        return values.complex_of(F.lit(values.EMPTY_DOUBLE), F.lit(values.EMPTY_DOUBLE))
    return F.lit(EMPTY[kind])


def convert(c: Column, source: str, target: str) -> Column:
    """A value of one type as another: characters by their codes, doubles cut towards zero, anything as the real part of
    a complex number; a complex number as anything else is that type's empty value. Overflow gives null."""
    if source == target:
        return c
    if source == "complex":
        return empty_of(target)
    number = F.ascii(c) if source == "char" else c
    if target == "complex":
        return values.complex_of(number.cast("double"), F.lit(0.0))
    if target == "char":
        return F.char(number.try_cast("long"))
    return number.try_cast(target)


def checked_rank(found: int, wanted: int) -> int:
    """The rank, if it is the wanted one."""
    if found != wanted:
        raise RankError(f"rank {found} where {wanted} is wanted")
    return found


def version_parts(v: Column) -> Column:
    """major.minor.patch as integers, so that arrays compare as versions do; what follows - or + is left out."""
    core = F.regexp_extract(v, r"^(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.split(core, r"\."), lambda x: x.try_cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.coalesce(F.get(parts, k), F.lit(0)))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = version_parts(a), version_parts(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def server_interpolates(version: Column) -> Column:
    """Whether a remote server settles times itself: only those after 1.4.0 do."""
    return compare_versions(version, F.lit("1.4.0")) > 0


def same_minor(a: str, b: str) -> bool:
    """Whether a store of one version may be written by another."""
    return a.split(".")[:2] == b.split(".")[:2]


def same_shape(a: Column, b: Column) -> Column:
    """Whether two shapes agree, in rank and in every dimension."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)


def greater_shape(a: Column, b: Column) -> Column:
    """The greatest of both in each dimension; what only one has is taken as it is."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))

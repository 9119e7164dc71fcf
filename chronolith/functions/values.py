"""Sentinels, typed blending, complex numbers, and index arithmetic, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_DOUBLE, EMPTY_INT, VIEW_INT, UNDEFINED_TIME = -9.0e40, -999999999, -999999, -999.0


def to_null(c: Column, sentinel) -> Column:
    return F.nullif(c, F.lit(sentinel))


def to_sentinel(c: Column, sentinel) -> Column:
    return F.coalesce(c, F.lit(sentinel))


def blend(lo: Column, hi: Column, w: Column) -> Column:
    return lo + (hi - lo) * w


def blend_int(lo: Column, hi: Column, w: Column) -> Column:
    """Rounded half away from zero."""
    x = blend(lo.cast("double"), hi.cast("double"), w)
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("int")


def blend_string(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, lo).when(lo.isNotNull() & hi.isNotNull(), F.lit(""))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def blend_complex(lo: Column, hi: Column, w: Column) -> Column:
    return complex_of(blend(lo["re"], hi["re"], w), blend(lo["im"], hi["im"], w))


def blend_array(lo: Column, hi: Column, w: Column) -> Column:
    """Element by element; null where the sizes differ."""
    return F.when(F.size(lo) == F.size(hi), F.zip_with(lo, hi, lambda a, b: a + (b - a) * w))


def product(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(1).cast("long"), lambda a, x: a * x)


def flat_index(index: list[Column], dims: list[Column]) -> Column:
    """Row-major place of a multi-index."""
    at = F.lit(0).cast("long")
    for i, d in zip(index, dims):
        at = at * d + i
    return at


def multi_index(at: Column, dims: list[int]) -> list[Column]:
    out, rest = [], at
    for d in reversed(dims):
        out.append(F.pmod(rest, F.lit(d)))
        rest = F.floor(rest / d)
    return out[::-1]

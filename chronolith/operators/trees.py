"""Slices, ranges and samples of nested values: structs and arrays of structs that carry their own times.

The schema drives the recursion, which ends as one column expression. An array whose elements have a field time is
dynamic: a slice leaves one element of it, or none of an empty one. A struct whose field time is an array of numbers
has signals of that length beside it: a slice leaves one value of each. Everything else is static and stays. Arrays
are in the order of time.

Profiles differ in what linear means: "round" rounds integers half away from zero and gives "" between different
texts; "truncate" cuts integers towards zero and keeps the earlier text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, NumericType, StringType, StructType

from chronolith.functions import values

TIME = "time"


def _timed(kind: DataType) -> bool:
    return isinstance(kind, StructType) and TIME in kind.names and isinstance(kind[TIME].dataType, NumericType)


def _own_base(kind: DataType) -> bool:
    return isinstance(kind, StructType) and TIME in kind.names and isinstance(kind[TIME].dataType, ArrayType)


def blend(lo: Column, hi: Column, w: Column, kind: DataType, profile: str = "round") -> Column:
    """Between two values of a type, field by field and element by element; arrays of different sizes leave an empty one."""
    if isinstance(kind, IntegralType):
        if profile == "round":
            return values.blend_int(lo, hi, w).cast(kind)
        return (lo + w * (hi - lo)).cast(kind)
    if isinstance(kind, NumericType):
        return values.blend(lo, hi, w).cast(kind)
    if isinstance(kind, StringType):
        return values.blend_string(lo, hi) if profile == "round" else lo
    if isinstance(kind, StructType):
        return F.struct(*[blend(lo[f.name], hi[f.name], w, f.dataType, profile).alias(f.name) for f in kind])
    if isinstance(kind, ArrayType):
        both = F.zip_with(lo, hi, lambda a, b: blend(a, b, w, kind.elementType, profile))
        return F.when(F.size(lo) == F.size(hi), both).otherwise(F.array().cast(kind))
    return lo


def _pick(lo: Column, hi: Column, at: Column, hi_at: Column, t: Column, mode: str, kind: DataType, profile: str) -> Column:
    if mode == "previous":
        return F.coalesce(lo, hi)
    if mode == "closest":
        return F.when(lo.isNull(), hi).when(hi.isNull(), lo).when(hi_at - t <= t - at, hi).otherwise(lo)
    if mode == "linear":
        return F.when(lo.isNull(), hi).when(hi.isNull() | (at == hi_at), lo).otherwise(blend(lo, hi, (t - at) / (hi_at - at), kind, profile))
    raise ValueError(f"no mode {mode!r}")


def element_at_time(array: Column, kind: StructType, t: Column, mode: str, profile: str = "round") -> Column:
    """The element of a dynamic array at time t; null of an empty array. A blended element has the time t."""
    lo = F.try_element_at(F.filter(array, lambda x: x[TIME] <= t), F.lit(-1))
    hi = F.try_element_at(F.filter(array, lambda x: x[TIME] >= t), F.lit(1))
    return _pick(lo, hi, lo[TIME], hi[TIME], t, mode, kind, profile)


def slice_array(array: Column, kind: StructType, t, mode: str, profile: str = "round") -> Column:
    """A dynamic array cut to the element at t: of size 1, or 0 where it is empty."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.when(F.size(array) == 0, array).otherwise(F.array(element_at_time(array, kind, t, mode, profile)))


def sample_array(array: Column, kind: StructType, times: list[float], mode: str, profile: str = "round") -> Column:
    """A dynamic array with one element per time, which has that time; as many as times, or none of an empty array."""
    grid = F.array(*[F.lit(float(t)) for t in times]) if times else F.array().cast("array<double>")
    made = F.transform(grid, lambda t: element_at_time(array, kind, t, mode, profile).withField(TIME, t))
    return F.when(F.size(array) == 0, array).otherwise(made)


def range_array(array: Column, tmin: float, tmax: float) -> Column:
    """The elements with tmin <= time <= tmax."""
    if tmin > tmax:
        raise ValueError("tmin is after tmax")
    return F.filter(array, lambda x: x[TIME].between(tmin, tmax))


def signal_at(data: Column, times: Column, t, mode: str, kind: DataType, profile: str = "round") -> Column:
    """A signal on its own base (arrays of one length) cut to [value]; as it is where the lengths differ."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    both = F.arrays_zip(times.alias("t"), data.alias("v"))
    both = F.transform(both, lambda x: F.struct(x["t"].alias("t"), x["v"].alias("v")))
    lo = F.try_element_at(F.filter(both, lambda x: x["t"] <= t), F.lit(-1))
    hi = F.try_element_at(F.filter(both, lambda x: x["t"] >= t), F.lit(1))
    v = _pick(lo["v"], hi["v"], lo["t"], hi["t"], t, mode, kind, profile)
    return F.when((F.size(data) == F.size(times)) & (F.size(times) > 0), F.array(v)).otherwise(data)


def slice_tree(value: Column, kind: DataType, t: float, mode: str, profile: str = "round") -> Column:
    """A nested value at one time."""
    if _own_base(kind):
        times = value[TIME]
        fields = []
        for f in kind:
            x = value[f.name]
            if f.name == TIME:
                x = F.when(F.size(times) > 0, F.array(F.lit(float(t)).cast(f.dataType.elementType))).otherwise(x)
            elif isinstance(f.dataType, ArrayType) and not isinstance(f.dataType.elementType, StructType):
                x = signal_at(x, times, t, mode, f.dataType.elementType, profile)
            else:
                x = slice_tree(x, f.dataType, t, mode, profile)
            fields.append(x.alias(f.name))
        return F.struct(*fields)
    if isinstance(kind, StructType):
        return F.struct(*[slice_tree(value[f.name], f.dataType, t, mode, profile).alias(f.name) for f in kind])
    if isinstance(kind, ArrayType) and _timed(kind.elementType):
        return slice_array(value, kind.elementType, t, mode, profile)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(value, lambda x: slice_tree(x, kind.elementType, t, mode, profile))
    return value


def range_tree(value: Column, kind: DataType, tmin: float, tmax: float) -> Column:
    """A nested value cut to a range of times."""
    if tmin > tmax:
        raise ValueError("tmin is after tmax")
    if _own_base(kind):
        inside = lambda x: F.transform(F.filter(F.arrays_zip(value[TIME].alias("t"), x.alias("v")), lambda y: y["t"].between(tmin, tmax)), lambda y: y["v"])
        plain = lambda f: isinstance(f.dataType, ArrayType) and not isinstance(f.dataType.elementType, StructType)
        return F.struct(*[(F.when(F.size(value[f.name]) == F.size(value[TIME]), inside(value[f.name])).otherwise(value[f.name]) if plain(f) else range_tree(value[f.name], f.dataType, tmin, tmax)).alias(f.name) for f in kind])
    if isinstance(kind, StructType):
        return F.struct(*[range_tree(value[f.name], f.dataType, tmin, tmax).alias(f.name) for f in kind])
    if isinstance(kind, ArrayType) and _timed(kind.elementType):
        return range_array(value, tmin, tmax)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(value, lambda x: range_tree(x, kind.elementType, tmin, tmax))
    return value


def sample_tree(value: Column, kind: DataType, times: list[float], mode: str, profile: str = "round") -> Column:
    """A nested value with its dynamic arrays sampled at times."""
    if isinstance(kind, StructType) and not _own_base(kind):
        return F.struct(*[sample_tree(value[f.name], f.dataType, times, mode, profile).alias(f.name) for f in kind])
    if _own_base(kind):
        grid = F.array(*[F.lit(float(t)) for t in times])
        at = lambda x, f: F.flatten(F.transform(grid, lambda t: signal_at(x, value[TIME], t, mode, f.dataType.elementType, profile)))
        plain = lambda f: isinstance(f.dataType, ArrayType) and not isinstance(f.dataType.elementType, StructType)
        return F.struct(*[(grid if f.name == TIME else F.when(F.size(value[f.name]) == F.size(value[TIME]), at(value[f.name], f)).otherwise(value[f.name]) if plain(f) else sample_tree(value[f.name], f.dataType, times, mode, profile)).alias(f.name) for f in kind])
    if isinstance(kind, ArrayType) and _timed(kind.elementType):
        return sample_array(value, kind.elementType, times, mode, profile)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(value, lambda x: sample_tree(x, kind.elementType, times, mode, profile))
    return value


def depth(kind: DataType) -> int:
    """How many arrays of structs lie inside one another."""
    if isinstance(kind, ArrayType):
        return depth(kind.elementType) + isinstance(kind.elementType, StructType)
    if isinstance(kind, StructType):
        return max((depth(f.dataType) for f in kind), default=0)
    return 0


def greatest_size(value: Column, kind: DataType) -> Column:
    """The greatest size of the arrays of structs in a value; 0 where there are none."""
    if isinstance(kind, StructType):
        inner = [greatest_size(value[f.name], f.dataType) for f in kind if depth(f.dataType)]
        return F.greatest(*inner) if len(inner) > 1 else inner[0] if inner else F.lit(0)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        deeper = F.array_max(F.transform(value, lambda x: greatest_size(x, kind.elementType)))
        return F.coalesce(F.greatest(F.size(value), deeper), F.lit(0))
    return F.lit(0)


def compatible(a: DataType, b: DataType) -> bool:
    """Whether two structures can be blended: the same fields of the same kinds, in any order."""
    if isinstance(a, StructType) and isinstance(b, StructType):
        return sorted(a.names) == sorted(b.names) and all(compatible(f.dataType, b[f.name].dataType) for f in a)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return compatible(a.elementType, b.elementType)
    return type(a) is type(b)


def element_field(array: Column, index: int, field: str) -> Column:
    """One field of one element; null beyond the end."""
    return F.get(array, F.lit(index))[field]


def put_element_field(array: Column, index: int, field: str, value: Column) -> Column:
    """array with one field of one element replaced; the same beyond the end."""
    return F.transform(array, lambda x, i: F.when(i == index, x.withField(field, value)).otherwise(x))

"""A small path language: name[sel]/name..., sel an index, a range a:b (half open), : or time=a[:b][,interp=mode].

A parsed path becomes one column expression over nested arrays of structs, so the scan reads only the fields named.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEGMENT = re.compile(r"([\w&@-]+)(?:\[([^\[\]]*)\])?\Z")


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Segment:
    name: str
    start: int | None = None
    stop: int | None = None
    index: int | None = None
    time: tuple[float, float | None] | None = None
    interp: str = "closest"


def _number(text: str, kind):
    try:
        return kind(text)
    except ValueError:
        raise PathError(f"not a number: {text!r}") from None


def parse(path: str) -> list[Segment]:
    out = []
    for part in path.strip("/").split("/"):
        m = _SEGMENT.match(part)
        if not m:
            raise PathError(f"bad segment {part!r}")
        name, sel = m.groups()
        if sel is None or sel == ":":
            out.append(Segment(name))
        elif sel.startswith("time="):
            time, _, interp = sel[5:].partition(",interp=")
            a, colon, b = time.partition(":")
            if interp not in ("", "closest", "linear"):
                raise PathError(f"bad interpolation {interp!r}")
            out.append(Segment(name, time=(_number(a, float), _number(b, float) if colon else None), interp=interp or "closest"))
        elif ":" in sel:
            a, _, b = sel.partition(":")
            out.append(Segment(name, start=_number(a, int) if a else 0, stop=_number(b, int) if b else None))
        else:
            out.append(Segment(name, index=_number(sel, int)))
    return out


def bind(template: str, indices: list[int]) -> str:
    """Fills the empty selections [] of template from the left."""
    parts = template.split("[]")
    if len(parts) - 1 != len(indices):
        raise PathError("as many indices as empty selections are needed")
    return parts[0] + "".join(f"[{i}]{p}" for i, p in zip(indices, parts[1:]))


def _select(array: Column, s: Segment, rest: list[Segment]) -> Column:
    if s.index is not None:
        return F.slice(array, s.index + 1, 1)
    if s.time is not None:
        a, b = s.time
        if b is not None:
            return F.filter(array, lambda x: x["time"].between(a, b))
        # nearest in time, ties to the later: the smallest (distance, -time)
        near = F.array_min(F.transform(array, lambda x: F.struct(F.abs(x["time"] - F.lit(a)).alias("d"), (-x["time"]).alias("l"))))
        return F.filter(array, lambda x: (F.abs(x["time"] - F.lit(a)) == near["d"]) & (-x["time"] == near["l"]))
    if s.start is not None:
        stop = F.size(array) if s.stop is None else F.least(F.lit(s.stop), F.size(array))
        return F.slice(array, F.lit(s.start + 1), F.greatest(stop - s.start, F.lit(0)))
    return array


def _linear(array: Column, t: float, rest: list[Segment]) -> Column:
    """One value: the field named by rest, blended between the steps around t and clamped at the ends."""
    lo = F.array_max(F.transform(F.filter(array, lambda x: x["time"] <= t), lambda x: F.struct(x["time"].alias("t"), _plain(x, rest).alias("v"))))
    hi = F.array_min(F.transform(F.filter(array, lambda x: x["time"] >= t), lambda x: F.struct(x["time"].alias("t"), _plain(x, rest).alias("v"))))
    v = F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (lo["t"] == hi["t"]), lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * ((F.lit(t) - lo["t"]) / (hi["t"] - lo["t"])))
    return F.array(v)


def _plain(x: Column, rest: list[Segment]) -> Column:
    for s in rest:
        x = x[s.name]
    return x


def column(path: str | list[Segment], arrays: set[str], root: Column | None = None) -> Column:
    """The selection as a column; arrays names the fields that are arrays of structs. Dimensions stay, also of size 1."""
    segments = parse(path) if isinstance(path, str) else path
    s, rest = segments[0], segments[1:]
    here = F.col(s.name) if root is None else root[s.name]
    if s.name not in arrays:
        return column(rest, arrays, here) if rest else here
    if s.time is not None and s.interp == "linear":
        return _linear(here, s.time[0], rest)
    some = _select(here, s, rest)
    return F.transform(some, lambda x: column(rest, arrays, x)) if rest else some


def condition(path: str | list[Segment], time: Column, index: Column | None = None) -> Column:
    """What the path's first segment asks of flat rows, before they are nested, so that it reaches the scan: a range of
    times, an index or a range of indices. Anything that needs its neighbours (one time) asks for nothing here."""
    s = (parse(path) if isinstance(path, str) else path)[0]
    if s.time is not None and s.time[1] is not None:
        return time.between(*s.time)
    if index is not None and s.index is not None:
        return index == s.index
    if index is not None and s.start is not None:
        return (index >= s.start) & (F.lit(True) if s.stop is None else index < s.stop)
    return F.lit(True)


def dims(tensor: Column, depth: int) -> Column:
    """The sizes of nested arrays from the outside in; of inner ones, which may differ, the greatest."""
    if depth == 1:
        return F.array(F.size(tensor))
    inner = F.transform(tensor, lambda x: dims(x, depth - 1))
    place = lambda k: lambda x: x[k]
    top = [F.coalesce(F.array_max(F.transform(inner, place(k))), F.lit(0)) for k in range(depth - 1)]
    return F.concat(F.array(F.size(tensor)), F.array(*top))


def flat(tensor: Column, depth: int) -> Column:
    """The values of nested arrays in order."""
    for _ in range(depth - 1):
        tensor = F.flatten(tensor)
    return tensor


def tensor(path: str, arrays: set[str]) -> Column:
    """struct(dims, data) of the leaf that path names, over all arrays on the way."""
    found, depth = column(path, arrays), sum(s.name in arrays for s in parse(path))
    return F.struct(dims(found, depth).alias("dims"), flat(found, depth).alias("data"))

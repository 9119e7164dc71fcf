"""Tensors as flat row-major arrays with a shape: selection, hyperslabs, strides."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def places(shape: list[int], starts: list[int], counts: list[int], strides: list[int] | None = None) -> list[int]:
    """Flat places of a selection; a count of -1 goes to the end; a stride takes every so manieth of the counted."""
    strides = [1] * (len(shape) - len(strides or [])) + list(strides or [])  # aligned from the right
    if any(s <= 0 for s in strides):
        raise ValueError("strides must be positive")
    axes = []
    for d, a, n, s in zip(shape, starts, counts, strides):
        n = d - a if n == -1 else n
        if a < 0 or n < 0 or a + n > d:
            raise IndexError(f"{a}..{a + n} is outside 0..{d}")
        axes.append(range(a, a + n, s))
    out = [0]
    for d, axis in zip(shape, axes):
        out = [x * d + i for x in out for i in axis]
    return out


def hyperslab(data: Column, shape: list[int], starts: list[int], counts: list[int], strides: list[int] | None = None) -> Column:
    at = places(shape, starts, counts, strides)
    if len(at) == 1:
        return F.array(F.get(data, F.lit(at[0])))
    step = {b - a for a, b in zip(at, at[1:])}
    if len(step) == 1:  # evenly spaced: no list of places in the plan
        return F.transform(F.sequence(F.lit(at[0]), F.lit(at[-1]), F.lit(step.pop())), lambda i: F.get(data, i))
    return F.transform(F.array(*[F.lit(i) for i in at]), lambda i: F.get(data, i))


def at(data: Column, shape: list[int], axis: int, index: int) -> tuple[Column, list[int]]:
    """The tensor without one dimension, at an index of it."""
    starts, counts = [0] * len(shape), [-1] * len(shape)
    starts[axis], counts[axis] = index, 1
    return hyperslab(data, shape, starts, counts), [d for k, d in enumerate(shape) if k != axis]


ALL = ("all",)


def view(data: Column, shape: list[int], cuts: list[tuple]) -> tuple[Column, list[int]]:
    """A part of a tensor, one cut per dimension: ("at", i) drops it, ("from", a), ("to", b), ("between", a, b) and ALL
    keep it. Ends are left out; what lies outside raises IndexError."""
    if len(cuts) != len(shape):
        raise IndexError(f"{len(cuts)} cuts for {len(shape)} dimensions")
    starts, counts, kept = [], [], []
    for (kind, *given), d in zip(cuts, shape):
        a, b = {"at": lambda i: (i, i + 1), "from": lambda i: (i, d), "to": lambda i: (0, i), "between": lambda i, j: (i, j), "all": lambda: (0, d)}[kind](*given)
        if not 0 <= a <= b <= d:
            raise IndexError(f"{a}..{b} is outside 0..{d}")
        starts.append(a), counts.append(b - a)
        if kind != "at":
            kept.append(b - a)
    return hyperslab(data, shape, starts, counts), kept


def time_last(data: Column, shape: list[int]) -> Column:
    """From time first to time last."""
    steps, rest = shape[0], prod(shape[1:])
    return F.transform(F.sequence(F.lit(0), F.lit(steps * rest - 1)), lambda i: F.get(data, (F.pmod(i, F.lit(steps)) * rest + F.floor(i / steps)).cast("int")))


def extent(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(1).cast("long"), lambda a, x: a * x)

"""Texts in stores: lists as padded characters, long texts in slots, attributes of XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_padded(texts: Column, width: Column | None = None, fill: str = " ") -> Column:
    """A list of texts as texts of one width: the longest and one more, unless it is given. Nulls are empty."""
    plain = F.transform(texts, lambda x: F.coalesce(x, F.lit("")))
    longest = F.coalesce(F.array_max(F.transform(plain, F.length)), F.lit(0)) + 1
    wide = longest if width is None else width
    return F.transform(plain, lambda x: F.rpad(x, wide, F.lit(fill)))


def from_padded(texts: Column, fill: str = " ") -> Column:
    """The list again, without what pads it."""
    return F.transform(texts, lambda x: F.regexp_replace(x, f"[{fill}]+$", ""))


def to_slots(text: Column, size: int) -> Column:
    """A text cut in slots of size characters; an empty one has one empty slot."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(text, k * size + 1, F.lit(size)))


def join_slots(slots: Column) -> Column:
    return F.array_join(slots, "")


def join_spans(slots: Column, spans: Column) -> Column:
    """One text per span (slot_offset, slot_span) of a list whose elements take several slots."""
    return F.transform(spans, lambda s: F.array_join(F.slice(slots, s["slot_offset"] + 1, s["slot_span"]), ""))


def attribute(xml: Column, path: str, name: str) -> Column:
    """An attribute of the first element at an XML path; null where there is none."""
    return F.nullif(F.xpath_string(xml, F.lit(f"{path}/@{name}")), F.lit(""))

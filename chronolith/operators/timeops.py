"""Time operators: as-of lookup, interpolation, gap filling, ranges and resampling, as windows over one shuffle.

Samples and requests are unioned and put in order per key; the sample before and after each request come from two
running windows. Times are seconds as doubles. A value is found per key (for instance an element and its signal).
A key that is too large for a task is cut in time buckets (bucket seconds): only the first and last sample of a
bucket cross to others, so a task holds one bucket of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import values
from chronolith.operators.tasks import spread

MODES = ("previous", "closest", "linear")


def seconds(ts: Column) -> Column:
    """A timestamp (with or without zone) as seconds since 1970, UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def step_grid(tmin: float, tmax: float, dt: float) -> list[float]:
    """tmin + i * dt up to tmax; a point that rounding puts just beyond it counts; dt <= 0: none."""
    n = int((tmax - tmin) / dt + 1e-9) + 1 if dt > 0 and tmax >= tmin else 0
    return [tmin + i * dt for i in range(n)]


def with_times(keys: DataFrame, times: list[float]) -> DataFrame:
    """A row per key and time."""
    return keys.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in times])) if times else F.explode(F.array().cast("array<double>")))


def bracket(samples: DataFrame, requests: DataFrame, keys: list[str], v: str = "v", order: str | None = None, bucket: float | None = None) -> DataFrame:
    """requests (keys, t) with lo and hi: struct(t, v) of the last sample at or before and the first at or after t.

    Null values are gaps and are passed over. Of samples at one time the one with the greatest order counts.
    """
    tie = F.col(order).cast("long") if order else F.lit(0).cast("long")
    kept = samples.where(F.col(v).isNotNull() & F.col("t").isNotNull())
    rows = kept.select(*keys, "t", F.lit(0).alias("_kind"), tie.alias("_tie"), F.struct("t", F.col(v).alias("v")).alias("_s"))
    asked = requests.select(*keys, "t", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(rows.schema["_s"].dataType).alias("_s"))
    both, parts = rows.unionByName(asked), list(keys)
    if bucket:
        both, parts = both.withColumn("_b", F.floor(F.col("t") / bucket)), [*keys, "_b"]
    up = Window.partitionBy(*parts).orderBy("t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*parts).orderBy(F.desc("t"), "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("lo", F.last("_s", ignorenulls=True).over(up)).withColumn("hi", F.last("_s", ignorenulls=True).over(down)).where("_kind = 1")
    if bucket:
        edge = both.groupBy(*parts).agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.struct("t", "_tie"))).alias("end"), F.min_by("_s", F.when(F.col("_s").isNotNull(), F.struct("t", -F.col("_tie")))).alias("start"))
        line = Window.partitionBy(*keys).orderBy("_b")
        edge = edge.withColumn("end", F.last("end", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
        edge = edge.withColumn("start", F.first("start", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)))
        out = out.join(edge, parts).withColumn("lo", F.coalesce("lo", "end")).withColumn("hi", F.coalesce("hi", "start"))
    return out.select(*keys, "t", "lo", "hi")


def _weight() -> Column:
    lo, hi, t = F.col("lo"), F.col("hi"), F.col("t")
    return (t - lo["t"]) / (hi["t"] - lo["t"])


def resolve(found: DataFrame, mode: str, kind: str = "double") -> DataFrame:
    """found (of bracket) with v by mode: the first or last sample beyond the ends; closest ties go to the later one.

    kind: double, int (linear rounds half away from zero), string (linear: "" between different texts), complex
    (struct of re and im) or array (null between different sizes).
    """
    lo, hi, t = F.col("lo"), F.col("hi"), F.col("t")
    if mode == "previous":
        v = F.coalesce(lo["v"], hi["v"])
    elif mode == "closest":
        v = F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).when(hi["t"] - t <= t - lo["t"], hi["v"]).otherwise(lo["v"])
    elif mode == "linear":
        between = {
            "double": lambda: values.blend(lo["v"], hi["v"], _weight()), "int": lambda: values.blend_int(lo["v"], hi["v"], _weight()),
            "string": lambda: values.blend_string(lo["v"], hi["v"]), "complex": lambda: values.blend_complex(lo["v"], hi["v"], _weight()),
            "array": lambda: values.blend_array(lo["v"], hi["v"], _weight()),
        }[kind]()
        v = F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).when(lo["t"] == hi["t"], lo["v"]).otherwise(between)
    else:
        raise ValueError(f"mode must be one of {MODES}")
    return found.withColumn("v", v).drop("lo", "hi")


def get_slice(samples: DataFrame, requests: DataFrame, keys: list[str], mode: str, kind: str = "double", **how) -> DataFrame:
    """(keys, t, v): each request's value; null where the key has no sample."""
    return resolve(bracket(samples, requests, keys, **how), mode, kind)


def _neighbours(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, _b, <column>_end, <column>_start): what is not null and nearest in the buckets before and after each."""
    there = F.when(F.col(column).isNotNull(), F.col("t"))
    edge = rows.groupBy(*keys, "_b").agg(F.max_by(column, there).alias("_e"), F.min_by(column, there).alias("_f"))
    line = Window.partitionBy(*keys).orderBy("_b")
    before = F.last("_e", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_f", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    return edge.select(*keys, "_b", before.alias(f"{column}_end"), after.alias(f"{column}_start"))


def get_slice_gaps(base: DataFrame, samples: DataFrame, requests: DataFrame, element: list[str], signal: list[str], bucket: float | None = None) -> DataFrame:
    """Closest with gaps: the time base (element, t) settles the step, then the signal's nearest sample fills it.

    requests have element, signal and t. A step that the signal has is taken; else the nearer in time to the request
    of its neighbours, a tie going to the earlier one; for requests before 1970 the nearer in steps. Samples lie on the
    base, so no sample lies between a request and the steps beside it, and one pass finds both kinds of neighbours. All three
    are counted first, and spread over tasks by their number.
    """
    count = base.count() + samples.count() + requests.count()
    nothing = F.lit(None).cast(samples.schema["v"].dataType)
    lacking = [F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in signal]
    steps = base.select(*element, "t").distinct().select(*element, *lacking, "t", F.lit(0).alias("_kind"), nothing.alias("v"))
    rows = steps.unionByName(samples.where("v is not null").select(*element, *signal, "t", F.lit(1).alias("_kind"), "v"))
    rows = rows.unionByName(requests.select(*element, *signal, "t", F.lit(2).alias("_kind"), nothing.alias("v"))).withColumn("_b", F.floor(F.col("t") / bucket) if bucket else F.lit(0))
    rows = spread(rows, [*element, "_b"] if bucket else element, count)
    up, down = [lambda keys, o=o: Window.partitionBy(*keys, "_b").orderBy(o, "_kind").rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("t"), F.desc("t"))]
    rows = rows.withColumn("_k", F.sum((F.col("_kind") == 0).cast("long")).over(up(element)))
    if bucket:
        at = F.when(F.col("_kind") == 0, F.col("t"))
        n = rows.groupBy(*element, "_b").agg(F.count(at).alias("_n"), F.max(at).alias("_e"), F.min(at).alias("_f"))
        line = Window.partitionBy(*element).orderBy("_b")
        before, end = F.sum("_n").over(line) - F.col("_n"), F.max("_e").over(line.rowsBetween(Window.unboundedPreceding, -1))
        n = n.select(*element, "_b", "_n", before.alias("_before"), end.alias("_end"), F.min("_f").over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_start"))
        rows = rows.join(n, [*element, "_b"]).withColumn("_k", F.col("_k") + F.col("_before"))
    rows = rows.withColumn("_base", F.when(F.col("_kind") == 0, F.struct("t", F.col("_k").alias("k"))))
    rows = rows.withColumn("_s", F.when(F.col("_kind") == 1, F.struct("t", F.col("_k").alias("k"), F.col("v").alias("x"))))
    found = rows
    for name, keys in (("_base", element), ("_s", [*element, *signal])):
        found = found.withColumn(f"{name}_lo", F.last(name, ignorenulls=True).over(up(keys))).withColumn(f"{name}_hi", F.last(name, ignorenulls=True).over(down(keys)))
    found = found.where("_kind = 2").drop("_base", "_s")
    if bucket:
        last = F.when(F.col("_end").isNotNull(), F.struct(F.col("_end").alias("t"), F.col("_before").alias("k")))
        first = F.when(F.col("_start").isNotNull(), F.struct(F.col("_start").alias("t"), (F.col("_before") + F.col("_n") + 1).alias("k")))
        found = found.withColumn("_base_lo", F.coalesce("_base_lo", last)).withColumn("_base_hi", F.coalesce("_base_hi", first)).drop("_n", "_before", "_end", "_start")
        keys = [*element, *signal]
        found = spread(found, [*keys, "_b"], count).join(_neighbours(rows, keys, "_s"), [*keys, "_b"])
        found = found.withColumn("_s_lo", F.coalesce("_s_lo", "_s_end")).withColumn("_s_hi", F.coalesce("_s_hi", "_s_start"))
    t, blo, bhi, slo, shi = (F.col(c) for c in ("t", "_base_lo", "_base_hi", "_s_lo", "_s_hi"))
    at = F.when(blo.isNull(), bhi).when(bhi.isNull(), blo).when(bhi["t"] - t <= t - blo["t"], bhi).otherwise(blo)
    found = found.withColumn("_at", at)
    step = F.col("_at")
    # at the step itself a sample is both neighbours
    here = F.when(slo["t"] == step["t"], slo).when(shi["t"] == step["t"], shi)
    in_time = F.abs(shi["t"] - t) < F.abs(t - slo["t"])
    in_steps = shi["k"] - step["k"] < step["k"] - slo["k"]
    other = F.when(slo.isNull(), shi["x"]).when(shi.isNull(), slo["x"]).when(F.when(t < 0, in_steps).otherwise(in_time), shi["x"]).otherwise(slo["x"])
    v = F.when(here.isNotNull(), here["x"]).otherwise(other)
    return found.select(*element, *signal, "t", F.when(step.isNotNull(), v).alias("v"))


def get_range(samples: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """Samples of tmin <= t <= tmax; the condition reaches the scan."""
    if tmin > tmax:
        raise ValueError("tmin is after tmax")
    return samples.where(F.col("t").between(tmin, tmax))


def get_range_filled(base: DataFrame, samples: DataFrame, element: list[str], signal: list[str], tmin: float, tmax: float, mode: str = "closest", bucket: float | None = None) -> DataFrame:
    """Every base time in the range for every signal of the element, gaps filled by mode."""
    times = get_range(base.select(*element, "t").distinct(), tmin, tmax)
    asked = samples.select(*element, *signal).distinct().join(times, element)
    if mode == "closest":
        return get_slice_gaps(base, samples, asked, element, signal, bucket)
    return get_slice(samples, asked, [*element, *signal], mode, bucket=bucket)


def resample(samples: DataFrame, keys: list[str], times: list[float], mode: str, kind: str = "double", **how) -> DataFrame:
    """Every key's value at each of times."""
    return get_slice(samples, with_times(samples.select(*keys).distinct(), times), keys, mode, kind, **how)


def time_base(samples: DataFrame, element: list[str], bucket: float | None = None) -> DataFrame:
    """(element, t, time_idx): the element's distinct times in order, from 0; with bucket no task holds a whole element."""
    times = samples.select(*element, "t").distinct()
    if not bucket:
        return times.withColumn("time_idx", F.row_number().over(Window.partitionBy(*element).orderBy("t")) - 1)
    times = times.withColumn("_b", F.floor(F.col("t") / bucket))
    n = times.groupBy(*element, "_b").agg(F.count("*").alias("n"))
    n = n.select(*element, "_b", (F.sum("n").over(Window.partitionBy(*element).orderBy("_b")) - F.col("n")).alias("before"))
    placed = times.withColumn("k", F.row_number().over(Window.partitionBy(*element, "_b").orderBy("t")) - 1)
    return placed.join(n, [*element, "_b"]).select(*element, "t", (F.col("k") + F.col("before")).cast("int").alias("time_idx"))


def whole_signal(samples: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """(keys, times, values) in order of time. With bucket a signal comes in pages (keys, page, times, values) of so many
    seconds, so that no task holds a whole one; without, a key's samples must fit a task."""
    parts = [*keys, "page"] if bucket else keys
    rows = samples.withColumn("page", F.floor(F.col("t") / bucket)) if bucket else samples
    both = F.sort_array(F.collect_list(F.struct("t", "v")))
    return rows.groupBy(*parts).agg(both.alias("s")).select(*parts, F.col("s.t").alias("times"), F.col("s.v").alias("values"))

"""Time bases: which node of a tree holds the times of a signal, and signals read by them.

A base is a node whose last segment is time. A signal's base is the first of these that has rows: beside it, beside
each array of structs around it from the inside out, at the root. A tree with one common time has it at the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import paths
from chronolith.operators import timeops

ROOT = "time"


def is_base(path: Column) -> Column:
    """Exactly time as the last segment: lifetime and time_step aren't bases."""
    return paths.last_segment(path) == ROOT


def candidates(path: Column) -> Column:
    """Array of (depth, base) from the sibling of path to the root."""
    parts = F.split(path, "/")
    place = lambda k: F.concat_ws("/", F.concat(F.slice(parts, F.lit(1), k), F.array(F.lit(ROOT))))
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.struct(k.alias("depth"), place(k).alias("base")))


def base_name(declared: str) -> str:
    """The name of a declared base without its containers: flux/time and a&time are time."""
    return declared.replace("&", "/").rpartition("/")[2]


def first_found(rows: DataFrame, key: str, wanted: Column, there: DataFrame, name: str) -> DataFrame:
    """(key, name): of wanted, an array of (depth, <name>) per row, the deepest that there (name) holds; rows without one are left out."""
    asked = rows.select(key, F.explode(wanted).alias("c")).select(key, F.col("c.depth").alias("_depth"), F.col(f"c.{name}").alias(name))
    return asked.join(there.select(name).distinct(), name).groupBy(key).agg(F.max_by(name, "_depth").alias(name))


def resolve(leaves: DataFrame, homogeneous: bool = False) -> DataFrame:
    """(path, base) of the signals of leaves (path, time_idx, ...) that have a base; homogeneous: the root's, for all."""
    signals = leaves.where(~is_base(F.col("path"))).select("path").distinct()
    if homogeneous:
        return signals.withColumn("base", F.lit(ROOT))
    there = leaves.where(is_base(F.col("path"))).select(F.col("path").alias("base"))
    return first_found(signals, "path", candidates(F.col("path")), there, "base")


def with_times(leaves: DataFrame, homogeneous: bool = False) -> DataFrame:
    """The signals' rows with their time t from the base, where it has the step; bases themselves are left out."""
    base = leaves.where(is_base(F.col("path"))).select(F.col("path").alias("base"), "time_idx", F.col("value").alias("t"))
    rows = leaves.where(~is_base(F.col("path")) & F.col("time_idx").isNotNull())
    return rows.drop("t").join(resolve(leaves, homogeneous), "path").join(base, ["base", "time_idx"])


def time_index(leaves: DataFrame, requests: DataFrame, mode: str) -> DataFrame:
    """(base, t, time_idx): the step of each requested time on its base."""
    steps = leaves.where(is_base(F.col("path"))).select(F.col("path").alias("base"), F.col("value").alias("t"), F.col("time_idx").alias("v"))
    return timeops.get_slice(steps, requests, ["base"], mode).withColumnRenamed("v", "time_idx")


def rows_at(leaves: DataFrame, step: int) -> DataFrame:
    """The rows of one step; the condition reaches the scan."""
    return leaves.where(F.col("time_idx") == step)


def around(leaves: DataFrame, step: int, radius: int) -> DataFrame:
    """The rows of the steps around one, for a dynamic array that is loaded as it is walked."""
    return leaves.where(F.col("time_idx").between(step - radius, step + radius))


def on_base(base: DataFrame, signals: DataFrame, samples: DataFrame, element: list[str], signal: list[str]) -> DataFrame:
    """Every step of the element's base for each of its signals, v null in gaps. base (element, t), signals (element, signal)."""
    return base.join(signals, element).join(samples.select(*element, *signal, "t", "v"), [*element, *signal, "t"], "left")


#: Steps of bases that go to every task, as a cache would hold them.
CACHED_STEPS = 1_000_000


def on_cached_base(rows: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with base on keys: without a shuffle of rows where base is known to be small."""
    return rows.join(F.broadcast(base) if base.count() <= CACHED_STEPS else base, keys)


def shape_conflicts(leaves: DataFrame) -> DataFrame:
    """(path, n_shapes) of the signals whose steps haven't all one shape, which can't be read as one tensor."""
    return leaves.groupBy("path").agg(F.count_distinct("shape").alias("n_shapes")).where("n_shapes > 1")


def next_step(next_signal: Column, next_base: Column, n: Column) -> Column:
    """Where n appended steps of a signal begin: a signal that goes on ends with its base, however many it skipped; a new one begins at 0."""
    return F.greatest(next_signal, F.when(next_signal > 0, next_base - n).otherwise(F.lit(0)))


def get_slice(leaves: DataFrame, t: float, mode: str, kind: str = "double", homogeneous: bool = False) -> DataFrame:
    """(path, t, value, rank) of every path at one time: signals by mode, with a dimension of size 1 (rank 1); static ones
    (no time_idx) as they are. Rows that have their own t need no base; signals without base or rows aren't available."""
    timed = leaves.where(F.col("time_idx").isNotNull())
    own = timed.where(F.col("t").isNotNull() & ~is_base(F.col("path"))).select("path", "t", F.col("value").alias("v"))
    based = with_times(timed.where(F.col("t").isNull()), homogeneous).select("path", "t", F.col("value").alias("v"))
    samples = own.unionByName(based)
    asked = samples.select("path").distinct().withColumn("t", F.lit(float(t)))
    got = timeops.get_slice(samples, asked, ["path"], mode, kind).select("path", "t", F.col("v").alias("value"), F.lit(1).alias("rank"))
    static = leaves.where(F.col("time_idx").isNull()).select("path", F.lit(None).cast("double").alias("t"), "value", F.lit(0).alias("rank"))
    return got.unionByName(static)


def get_sample(leaves: DataFrame, times: list[float], mode: str, kind: str = "double", homogeneous: bool = False) -> DataFrame:
    """get_slice() at each of times (of a step grid, or chosen ones); static paths once."""
    timed = leaves.where(F.col("time_idx").isNotNull())
    own = timed.where(F.col("t").isNotNull() & ~is_base(F.col("path"))).select("path", "t", F.col("value").alias("v"))
    based = with_times(timed.where(F.col("t").isNull()), homogeneous).select("path", "t", F.col("value").alias("v"))
    got = timeops.resample(own.unionByName(based), ["path"], times, mode, kind)
    static = leaves.where(F.col("time_idx").isNull()).select("path", F.lit(None).cast("double").alias("t"), "value", F.lit(0).alias("rank"))
    return got.select("path", "t", F.col("v").alias("value"), F.lit(1).alias("rank")).unionByName(static)


def cut_strings(samples: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """String signals in a range: their own steps, never made between steps."""
    return timeops.get_range(samples, tmin, tmax)

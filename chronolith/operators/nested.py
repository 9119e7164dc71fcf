"""Arrays of structs and the catalog of a tree stored as leaves (path, index, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import paths


def nest(rows: DataFrame, keys: list[str], order: str, fields: list[str], name: str) -> DataFrame:
    """One row per key with an array of structs in order; a key's elements must fit a task."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))


def unnest(rows: DataFrame, name: str, index: str = "index") -> DataFrame:
    """One row per element with its index from 0; empty arrays give none."""
    others = [c for c in rows.columns if c != name]
    return rows.select(*others, F.posexplode(name).alias(index, "_e")).select(*others, index, "_e.*")


def _field(name: str):
    return lambda x: x[name]


def deflate(array: Column, fields: list[str]) -> Column:
    """Array of structs -> struct of arrays."""
    return F.struct(*[F.transform(array, _field(f)).alias(f) for f in fields])


def inflate(struct: Column, fields: list[str]) -> Column:
    """Struct of arrays -> array of structs, as long as the longest."""
    return F.arrays_zip(*[struct[f].alias(f) for f in fields])


def sizes(leaves: DataFrame, keys: list[str], index: str, declared: DataFrame | None = None) -> DataFrame:
    """(keys, size): greatest index + 1, or the declared size (keys, size) where there is one."""
    found = leaves.groupBy(*keys).agg((F.max(index) + 1).alias("found"))
    if declared is None:
        return found.withColumnRenamed("found", "size")
    return found.join(declared, keys, "full").select(*keys, F.coalesce("size", "found").alias("size"))


def nodes(leaves: DataFrame) -> DataFrame:
    """leaves (path, time_idx, shape) by schema path: rows, time coverage, greatest shape, whether it varies in time."""
    per = leaves.groupBy("path").agg(F.count("*").alias("n"), F.max("time_idx").alias("last"), F.max("size").alias("size"))
    return per.groupBy(paths.strip_indices(F.col("path")).alias("schema_path")).agg(
        F.sum("n").alias("n_rows"), (F.max("last") + 1).alias("coverage"), F.max("size").alias("max_size"), F.max("last").isNotNull().alias("dynamic"),
    )


def occurrences(leaves: DataFrame) -> DataFrame:
    return leaves.select("tree", "occurrence").distinct()


def filled_paths(leaves: DataFrame) -> DataFrame:
    return leaves.where("size > 0").select("path").distinct().select(paths.strip_indices(F.col("path")).alias("schema_path")).distinct()


def last_write(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int, flag: str | None = None) -> DataFrame:
    """The first n rows of each key; flag: a column that says whether the key had more."""
    w = Window.partitionBy(*keys)
    out = rows.withColumn("_n", F.row_number().over(w.orderBy(*order)))
    if flag:
        out = out.withColumn(flag, F.count("*").over(w) > n)
    return out.where(F.col("_n") <= n).drop("_n")


def padded(rows: DataFrame, keys: list[str], index: str, value: str, fill) -> DataFrame:
    """(keys, index, value): every key has every index up to the greatest of all, holes as fill."""
    width = rows.agg((F.max(index) + 1).alias("_w"))  # one row
    grid = rows.select(*keys).distinct().join(F.broadcast(width)).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias(index))
    return grid.join(rows.select(*keys, F.col(index).cast("int").alias(index), value), [*keys, index], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def holes(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """One row: keys, greatest size, elements, and cells of the padded view without one."""
    per = rows.groupBy(*keys).agg((F.max(index) + 1).alias("w"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_rows"), F.max("w").alias("width"), F.sum("n").alias("n_elements")).withColumn("n_holes", F.col("n_rows") * F.col("width") - F.col("n_elements"))

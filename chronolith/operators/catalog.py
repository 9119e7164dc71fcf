"""The catalog of a tree of leaves (path, time_idx, ...): parents, sizes, existence, order, listings and statistics.

Paths hold indices as numeric segments (a/0/b); without them they are schema paths. What is said of schema paths is
first reduced per path, so that path functions run once a path and not once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import paths
from chronolith.operators.tasks import spread

#: Dimensions that shapes may have.
RANKS = 8


def indices(path: Column) -> Column:
    """The numeric segments, as integers."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))


def array_path(path: Column) -> Column:
    """The path of the innermost array of structs that path lies in; "" outside."""
    return F.regexp_extract(path, "^(.*)/[0-9]+(?:/[^0-9/][^/]*)*$", 1)


def natural_order(leaves: DataFrame) -> DataFrame:
    """(path, place): every path once, numbered per schema path in the order of its indices: 10 after 9."""
    each = leaves.select("path").distinct().withColumn("schema_path", paths.strip_indices(F.col("path")))
    w = Window.partitionBy("schema_path").orderBy(indices(F.col("path")))
    return each.withColumn("place", F.row_number().over(w) - 1).select("schema_path", "path", "place")


def under(leaves: DataFrame, prefix: str) -> DataFrame:
    """The rows at and below a path; the condition reaches the scan."""
    return leaves.where((F.col("path") == prefix) | F.col("path").startswith(prefix + "/"))


def at_index(leaves: DataFrame, schema_path: str, index: list[int]) -> DataFrame:
    """The rows of one element: a/b with indices [k] are those of a/k/b, wherever the index stands."""
    want = F.array(*[F.lit(i) for i in index]) if index else F.array().cast("array<int>")
    return leaves.where((paths.strip_indices(F.col("path")) == schema_path) & (indices(F.col("path")) == want))


def existing(requests: DataFrame, leaves: DataFrame, absent: bool = False) -> DataFrame:
    """requests (schema_path, ...) that have a row in leaves under any index; absent: those that have none."""
    there = leaves.select("path").distinct().select(paths.strip_indices(F.col("path")).alias("schema_path")).distinct()
    return requests.join(there, "schema_path", "left_anti" if absent else "left_semi")


def with_parents(leaves: DataFrame, arrays: DataFrame) -> DataFrame:
    """leaves with the columns of arrays (path, ...), the node of the array that a leaf lies in; null where there is none."""
    named = arrays.withColumnRenamed("path", "parent")
    return leaves.withColumn("parent", array_path(F.col("path"))).join(named, "parent", "left")


def linked(names: DataFrame, links: DataFrame) -> DataFrame:
    """names (tree, occurrence) with the file that links (tree, occurrence, file) give; those without keep null."""
    return names.join(links, ["tree", "occurrence"], "left")


def dynamic_sizes(leaves: DataFrame) -> DataFrame:
    """(array, size): one more than the last step of all that lies under a dynamic array. leaves: path, time_idx, n_steps."""
    per = leaves.where("time_idx is not null").groupBy("path").agg(F.max(F.col("time_idx") + F.col("n_steps")).alias("size"))
    return per.groupBy(array_path(F.col("path")).alias("array")).agg(F.max("size").alias("size")).where("array <> ''")


def dynamic_flags(leaves: DataFrame) -> DataFrame:
    """(schema_path, dynamic): whether a signal has steps, be it one."""
    per = leaves.groupBy("path").agg(F.max("time_idx").isNotNull().alias("dynamic"))
    return per.groupBy(paths.strip_indices(F.col("path")).alias("schema_path")).agg(F.bool_or("dynamic").alias("dynamic"))


def ragged_shape(rows: DataFrame, keys: list[str], shape: str = "shape") -> DataFrame:
    """(keys, shape): in each dimension the greatest, over shapes of different sizes and ranks."""
    tops = rows.groupBy(*keys).agg(*[F.max(F.get(shape, F.lit(k))).alias(f"_d{k}") for k in range(RANKS)])
    return tops.select(*keys, F.filter(F.array(*[f"_d{k}" for k in range(RANKS)]), lambda x: x.isNotNull()).alias(shape))


def shapes(leaves: DataFrame) -> DataFrame:
    """(path, time_idx, shape): the shape of each step, as the last write left it. leaves are counted first, and spread by their number."""
    return spread(leaves, ["path", "time_idx"], leaves.count()).groupBy("path", "time_idx").agg(F.max_by("shape", "seq").alias("shape"))


def counters(leaves: DataFrame) -> DataFrame:
    """(path, next_step): the step that a signal would append; 0 for static ones."""
    return leaves.groupBy("path").agg(F.coalesce(F.max("time_idx") + 1, F.lit(0)).alias("next_step"))


def string_width(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, width): the longest text and one more, as padded texts need."""
    return rows.groupBy(*keys).agg((F.max(F.length(text)) + 1).alias("width"))


def chunk_statistics(rows: DataFrame, keys: list[str], size: str, chunk: int) -> DataFrame:
    """(keys, n_chunks, n_bytes, largest): what reading rows of so many bytes each in chunks takes."""
    return rows.groupBy(*keys).agg(F.sum(F.ceil(F.col(size) / chunk)).cast("long").alias("n_chunks"), F.sum(size).cast("long").alias("n_bytes"), F.max(size).cast("long").alias("largest"))


def listing(leaves: DataFrame, recursive: bool = True) -> DataFrame:
    """Schema paths in order, or the top level alone."""
    found = leaves.select("path").distinct().select(paths.strip_indices(F.col("path")).alias("path")).distinct()
    if not recursive:
        found = found.select(F.substring_index("path", "/", 1).alias("path")).distinct()
    return found.orderBy("path")


def tree_lines(leaves: DataFrame) -> DataFrame:
    """(line, kind): schema paths with [] after arrays, kind as a listing shows it: sizes, /Inf after a dynamic first one."""
    marked = F.regexp_replace(F.col("path"), "/[0-9]+(?=/|$)", "[]")
    per = leaves.groupBy("path").agg(F.max("size").alias("size"), F.max("time_idx").isNotNull().alias("dynamic"))
    found = per.groupBy(marked.alias("line")).agg(F.max("size").alias("size"), F.bool_or("dynamic").alias("dynamic"))
    inner = F.when(F.col("size") <= 1, F.when(F.col("dynamic"), "1/Inf").otherwise("SCALAR")).otherwise(F.concat(F.col("size").cast("string"), F.when(F.col("dynamic"), "/Inf").otherwise("")))
    return found.select("line", F.concat(F.lit("Dataset {"), inner, F.lit("}")).alias("kind"))


def index_dump(leaves: DataFrame, match: str | None = None, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the index whose path holds match and whose kind is one of kinds, in order, the first limit of them."""
    out = leaves
    if match:
        out = out.where(F.col("path").contains(match))
    if kinds is not None:
        out = out.where(F.col("kind").isin(kinds))
    out = out.orderBy("path", "time_idx")
    return out if limit is None else out.limit(limit)


def write_sorted(rows: DataFrame, path: str, time: str = "t", partitions: int | None = None) -> None:
    """Files with times in order that don't overlap, so that a condition on time skips all others by their statistics."""
    ranged = rows.repartitionByRange(partitions, time) if partitions else rows.repartitionByRange(time)
    ranged.sortWithinPartitions(time).write.mode("overwrite").parquet(path)


def metadata_once(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): one value per key, the last written."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def to_leaves(table: DataFrame, keys: list[str], fields: list[str], root: str) -> DataFrame:
    """A flat table as leaves (path, value): root/key/.../field; null fields have none."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x")
    path = F.concat_ws("/", F.lit(root), *[F.col(k).cast("string") for k in keys], F.col("x.f"))
    return table.select(*keys, each).where("x.value is not null").select(path.alias("path"), F.col("x.value").alias("value"))


def with_metadata(leaves: DataFrame, metadata: DataFrame) -> DataFrame:
    """leaves with the columns of metadata (schema_path, ...); null where a path has none."""
    return leaves.withColumn("schema_path", paths.strip_indices(F.col("path"))).join(metadata, "schema_path", "left")

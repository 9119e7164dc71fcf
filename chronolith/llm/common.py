"""Shared helpers: durable intermediate tables, batches of text, connected components."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ASCII_SPACE = r"\x20\x09-\x0D"
#: Rows and bytes of an Arrow batch that are worked on at a time.
PART_ROWS, PART_BYTES = 1000, 4 << 20
#: Rows that Spark sends a worker at a time while materialize() writes: a batch is whole in memory on both sides, lists and texts with it.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Without a checksum file beside each: on local disks Hadoop starts a process (chmod) for every file that it makes, and until
#: that process has its own program it counts as much memory as the executor that starts it.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_local_dir: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset it is an error, but in local mode, where a temporary folder serves."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="corpus-"))
    return "file://" + _local_dir[0]


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_all(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM is gone: the shared folder outlives it
        pass


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors.

    small: rows are short, so they are shuffled into as few files as their size asks for. The table is removed when the driver's process ends, or earlier through discard() and discard_since().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH, "10000")
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        (df.hint("rebalance") if small else df).write.options(**_PLAIN).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    if not _made:
        atexit.register(lambda: [_remove_all(SparkSession.getActiveSession() or spark, p) for p in _made])
    _made.append(path)
    return out


def mark() -> int:
    """The place in the list of tables, for discard_since()."""
    return len(_made)


def discard_since(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Removes the tables that materialize() wrote since mark(), but for those kept: what a finished stage leaves behind."""
    held = {df._table_path for df in kept}
    for path in [p for p in _made[since:] if p not in held]:
        remove(spark, path)
        _made.remove(path)


def discard(df: DataFrame) -> None:
    """Removes a table of materialize() that no later plan reads."""
    remove(df.sparkSession, df._table_path)
    _made.remove(df._table_path)


def release() -> None:
    """Gives the system back what is free: Spark keeps workers for further tasks, with all the memory they ever took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with release() at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow with one function per task, so caches live for a task and no longer.

    A batch is worked on in parts of PART_ROWS rows and about PART_BYTES, so that results stay small beside long texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            n = batch.num_rows
            step = max(1, min(PART_ROWS, PART_BYTES * n // max(batch.nbytes, 1)))
            for at in range(0, n, step):
                yield one(batch.slice(at, step))

    return df.mapInArrow(tidy(run), schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (src, dst): component is the smallest node reachable.

    Alternates large-star and small-star joins, each round a table in the shared folder; neither links nor
    components reach the driver, which only compares a count and a checksum. Stars of hot nodes are minima and
    joins that combine before they shuffle. Every round that changes a link lowers an end, so the rounds end, after
    about log squared of the longest chain. Self-links and null ends are ignored; no edges give no rows.
    """
    e = (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e, last = materialize(e, "cc"), None
    while True:
        sign = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == last or sign[0] == 0:
            break
        last = sign
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = (
            large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        step = materialize(step, "cc")
        discard(e)
        e = step
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

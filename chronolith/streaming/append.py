"""Appended steps as a stream: a folder of new rows in, an entry out, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources import store


def append_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 100):
    """Starts a query that takes what is there in batches and ends; the sink commits each batch's files at once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start()


def latest_values(stream: DataFrame, keys: list[str], delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Per key and window of event time ts: the last value and the number of values; state ends delay after a window."""
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", window), *keys)
        .agg(F.max_by("value", "ts").alias("last_value"), F.count("*").alias("n_values"))
        .select(F.col("window.start").alias("window_start"), *keys, "last_value", "n_values")
    )


def append_steps(stream: DataFrame, target: str, tree: str, checkpoint: str, occurrence: int = 0):
    """Appends a stream of steps (path, t, value) to a tree, batch by batch, on the tree's base: late signals go to the
    steps of their times, skipped ones stay gaps. A batch that was written before a failure isn't written again."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        done = f"{target.rstrip('/')}/_batches/{tree}-{occurrence}-{batch}"
        entry = store.Entry(spark, target, "force_open")
        steps = rows
        if store.exists(spark, done):
            # the batch may have been written in part: what the tree has of it isn't appended twice
            old = entry.get(tree, occurrence).select("path", "t").distinct()
            steps = steps.join(old, ["path", "t"], "left_anti")
        store.mark(spark, done)
        entry.put_slice(steps, tree, occurrence)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, keys: list[str], size: str, slide: str | None = None, gap: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Per key and window of event time ts the number and sum of values: tumbling, sliding by slide, or sessions that end
    after a gap. State ends delay after a window; what comes later is dropped."""
    at = F.session_window("ts", gap) if gap else F.window("ts", size, slide or size)
    out = stream.withWatermark("ts", delay).groupBy(at.alias("w"), *keys).agg(F.count("*").alias("n_values"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n_values", "total")

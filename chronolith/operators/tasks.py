"""How many tasks share a shuffle's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task of spread() gets, about.
TASK_ROWS = 250_000


def spread(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """rows shuffled by keys into as many tasks as their count asks for; what groups and orders by keys, or by more, needs no other shuffle.

    Adaptive plans join partitions up to a size in bytes as they are shuffled, compressed; repeated keys and nulls take many
    times that in sorts, so what a task holds would grow with the input. All rows of one key are still in one task.
    """
    n = -(-count // TASK_ROWS)
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else rows

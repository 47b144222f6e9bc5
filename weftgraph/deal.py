"""Tasks by the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 500_000  # that one task takes


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, dealt by keys over as many tasks as `rows` ask for, so that a task's memory does not grow with the table.
    (Spark joins small partitions by their bytes alone, which say nothing of the rows that a step makes of them.)"""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)

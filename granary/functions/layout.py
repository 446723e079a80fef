"""How many tasks a table is dealt to: by its rows, so that a task's memory stays as tables grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a series that a task sorts, and the fewest worth a task of their own.
ROWS_PER_TASK, FEW_ROWS = 500_000, 20_000


def tasks_for_rows(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """Enough tasks for ``per_task`` rows each, and for small tables no more than there are cores."""
    return max(-(-rows // per_task), min(spark.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)), 1)


def by_key(df: DataFrame, *keys: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt by ``keys`` for windows and aggregates over them; counts it, so it should be a written table."""
    return df.repartition(tasks_for_rows(df.sparkSession, df.count(), per_task), *keys)

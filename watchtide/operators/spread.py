"""Dealing a small input over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

BYTES_PER_CORE = 8 * 1024 * 1024


def spread(rows: DataFrame) -> DataFrame:
    """`rows`, dealt over all cores if the planner puts them below BYTES_PER_CORE a core; else as they are.

    A file of one row group is one task's work, however dear a row is. Large inputs come in enough splits, and are
    never shuffled here. Streams are left alone.
    """
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size <= cores * BYTES_PER_CORE else rows

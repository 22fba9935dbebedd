"""Incremental compaction: days are merged into columnar files when loads touch them, and stay as they are otherwise.

`<mirror>/rows` holds merged days, each under the generation that merged it; `<mirror>/marks` says which announced
folders a generation took in. Marks are written last, in one file, so a generation that failed half-way is never read
and the next one replaces it. A read is the newest generation of each day plus the folders no mark names: mirrored
rows are scanned in place, and only those few rows that late loads may overwrite are merged.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.operators.dedup import last_write_wins
from watchtide.operators.small_side import join_checked
from watchtide.schemas import ENRICHED
from watchtide.session import materialize
from watchtide.sources import feed, lake
from watchtide.sources.tables import read_table

DAY = ("source", *lake.DAY_COLUMNS)
MARKS = ", ".join(f"{c} string" for c in ("announcement", *feed.FOLDER)) + ", generation int"


def _pending(spark: SparkSession, marks: DataFrame, announced: str) -> DataFrame:
    """Announced folders that no generation has taken in. Both sides are tables of folder names, not of findings."""
    named = read_table(spark, announced, MARKS.rsplit(",", 1)[0], fmt="json")
    return named.join(marks.select("announcement").distinct(), "announcement", "left_anti")


def _served(marks: DataFrame) -> DataFrame:
    """Day and newest generation, named as the folder it lies in."""
    newest = marks.groupBy(*DAY).agg(F.max("generation").alias("generation"))
    return newest.select(*DAY, F.concat(F.lit("g"), "generation").alias("load"))


def _merge(mirrored: DataFrame, tail: DataFrame) -> DataFrame:
    """The newest row per key. The mirrored side is unique and never shuffled unless the keys of the tail are many."""
    key = F.struct(*DAY, "safe_id").alias("_k")  # structs: null days are equal, too
    tail = materialize(tail)
    keys = tail.select(key).distinct()
    keyed = mirrored.withColumn("_k", key)
    touched = join_checked(keyed, keys, ["_k"], "left_semi").drop("_k")
    rest = join_checked(keyed, keys, ["_k"], "left_anti").drop("_k")
    return rest.unionByName(last_write_wins(touched.unionByName(tail)))


def _tail(spark: SparkSession, path: str, folders: list[Row], schema: T.StructType) -> DataFrame:
    rows = feed.read_folders(spark, path, folders, schema=schema).filter(F.col("finding_id").isNotNull())
    return rows.select(*[f.name for f in schema.fields], *lake.DAY_COLUMNS).withColumn("safe_id", lake.safe_id())


def _mirrored(spark: SparkSession, mirror: str, days: list[Row], schema: T.StructType) -> DataFrame:
    rows = feed.read_folders(spark, f"{mirror}/rows", days, schema=schema, fmt="parquet")
    return rows.select(*[f.name for f in schema.fields], *lake.DAY_COLUMNS).withColumn("safe_id", lake.safe_id())


def read_current(
    spark: SparkSession, path: str, mirror: str, announced: str, *, schema: T.StructType = ENRICHED,
    sources: Sequence[str] | None = None, start: date | None = None, end: date | None = None,
) -> DataFrame:
    """Findings in the lake, as `read_findings` gives them: merged days plus what came since.

    Days without new loads are plain scans. Of the others the tail's keys are broadcast (by their measured size) to
    the mirrored rows, and only matches and the tail itself are shuffled. Folder names of the days asked for pass
    through the driver, as they do in any listing of a table.
    """
    marks = read_table(spark, f"{mirror}/marks", MARKS)
    served = lake.in_range(_served(marks), sources, start, end).collect()
    pending = lake.in_range(_pending(spark, marks, announced).select(*feed.FOLDER).distinct(), sources, start, end).collect()
    return _current(spark, path, mirror, served, pending, schema).drop("safe_id")


def _current(
    spark: SparkSession, path: str, mirror: str, served: list[Row], pending: list[Row], schema: T.StructType
) -> DataFrame:
    touched = {tuple(r[c] for c in DAY) for r in pending}
    still = [r for r in served if tuple(r[c] for c in DAY) not in touched]
    moving = [r for r in served if tuple(r[c] for c in DAY) in touched]
    rows = _mirrored(spark, mirror, still, schema)
    if not pending:
        return rows
    return rows.unionByName(_merge(_mirrored(spark, mirror, moving, schema), _tail(spark, path, pending, schema)))


def compact(spark: SparkSession, path: str, mirror: str, announced: str, *, schema: T.StructType = ENRICHED) -> int | None:
    """Merges the days that new loads touch into a new generation, and returns it; None if nothing is new.

    Days without new loads are neither read nor written. One compaction of a mirror runs at a time. A load repeated
    after it was taken in is merged again: its rows overwrite by key; rows it no longer has stay until then.
    """
    marks = read_table(spark, f"{mirror}/marks", MARKS)
    fresh = materialize(_pending(spark, marks, announced))
    pending = fresh.select(*feed.FOLDER).distinct().collect()
    if not pending:
        return None
    generation = (marks.agg(F.max("generation")).first()[0] or 0) + 1
    touched = {tuple(r[c] for c in DAY) for r in pending}
    served = [r for r in _served(marks).collect() if tuple(r[c] for c in DAY) in touched]
    rows = _current(spark, path, mirror, served, pending, schema).drop("safe_id")
    (
        rows.withColumn("load", F.lit(f"g{generation}"))
        .hint("rebalance", *DAY)
        .sortWithinPartitions(*DAY, "severity", "finding_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*DAY, "load")
        .parquet(f"{mirror}/rows")
    )
    named = fresh.select("announcement", *feed.FOLDER).withColumn("generation", F.lit(generation))
    named.coalesce(1).write.mode("append").parquet(f"{mirror}/marks")
    return generation

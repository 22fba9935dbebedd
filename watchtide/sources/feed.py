"""Announcements of loads: what a write tells its readers, so that no reader lists the lake to find what is new.

Each consumer has a folder of its own. A write leaves one small file in it, with the folders it wrote; the consumer's
stream takes new files and archives those it has committed, so a trigger costs new loads only, however old the lake
is. Delivery is at least once: a load that is repeated is announced again, and findings overwrite themselves by key.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from watchtide.schemas import ENRICHED
from watchtide.sources import lake

FOLDER = ("source", *lake.DAY_COLUMNS, "load")
ANNOUNCEMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("announcement", *FOLDER)])
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # fixed value: folder name of a null


def announce(spark: SparkSession, folders: Iterable[Sequence[str | None]], announcement: str, queues: Sequence[str]) -> None:
    """Leaves a file that names `folders` (source, year, month, day, load) with each consumer; nothing if there are none."""
    rows = [(announcement, *folder) for folder in folders]
    if rows:
        told = spark.createDataFrame(rows, ANNOUNCEMENT).coalesce(1)
        for queue in queues:
            told.write.mode("append").json(queue)


def folder_path(root: str, folder: Row) -> str:
    parts = [(c, NO_VALUE if folder[c] is None else folder[c]) for c in FOLDER]
    for _name, value in parts:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", value):
            raise ValueError(f"no folder of a lake: {value!r}")
    return "/".join([root, *(f"{c}={value}" for c, value in parts)])


def folders_of_load(spark: SparkSession, path: str, load: str) -> list[tuple[str | None, ...]]:
    """Folders that one load owns, by listing the lake."""
    jvm = spark._jvm.org.apache.hadoop.fs
    pattern = jvm.Path("/".join([path, *(f"{c}=*" for c in FOLDER[:-1]), f"load={load}"]))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or ()
    parts = [[p.split("=", 1)[1] for p in str(status.getPath()).split("/")[-len(FOLDER):]] for status in found]
    return [tuple(None if v == NO_VALUE else v for v in values) for values in parts]


def read_folders(
    spark: SparkSession, path: str, folders: Sequence[Row], *, schema: T.StructType = ENRICHED, fmt: str = "json"
) -> DataFrame:
    """Rows of the named folders alone, as `read_loads` gives them. Folders that are gone (expired) are left out."""
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    wanted = sorted({folder_path(path, f) for f in folders})
    return lake.open_folders(spark, path, [w for w in wanted if files.exists(jvm.Path(w))], schema=schema, fmt=fmt)


def stream_announcements(spark: SparkSession, queue: str, *, archive: str, max_files: int = 100) -> DataFrame:
    """One consumer's announcements as a stream. Files of committed batches move to `archive`, outside the queue."""
    if f"{archive.rstrip('/')}/".startswith(f"{queue.rstrip('/')}/"):
        raise ValueError("the archive lies outside the queue")
    return (
        spark.readStream.schema(ANNOUNCEMENT)
        .option("maxFilesPerTrigger", max_files)
        .option("cleanSource", "archive")
        .option("sourceArchiveDir", archive)
        .option("pathGlobFilter", "*.json")
        .json(queue)
    )


def announced_rows(batch: DataFrame, path: str, *, schema: T.StructType = ENRICHED) -> DataFrame:
    """The rows that a batch of announcements names. A batch holds the folders of at most `max_files` loads."""
    folders = batch.select(*FOLDER).distinct().collect()
    return read_folders(batch.sparkSession, path, folders, schema=schema)

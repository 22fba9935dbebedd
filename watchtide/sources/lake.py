"""The finding lake: partitioned reads, idempotent writes, object feed and columnar mirror.

Layout: <root>/source=…/year=…/month=…/day=…/load=…/. A load (a batch job or one
micro-batch) owns its `load` folders, so a write never reads or rewrites what is
there, and repeating it replaces exactly its own rows. "Same key overwrites" is
resolved when findings are read, and for good when finished days are mirrored.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.operators.dedup import last_write_wins
from watchtide.operators.normalize import with_partition_columns
from watchtide.operators.query import ALLOWED_SOURCE
from watchtide.schemas import ENRICHED, SCORED

DAY_COLUMNS = ("year", "month", "day")
CORRUPT = "_corrupt_record"
OBJECT_PATH = r"/([^/]+)/(\d{4})/(\d{2})/(\d{2})/[^/]+\.json$"


def _body(schema: T.StructType) -> list[T.StructField]:
    """Columns stored in files; `source` comes from the partition."""
    return [f for f in schema.fields if f.name != "source"]


def _lake_schema(schema: T.StructType, fmt: str) -> T.StructType:
    partitions = [T.StructField(c, T.StringType()) for c in ("source", *DAY_COLUMNS, "load")]
    corrupt = [T.StructField(CORRUPT, T.StringType())] if fmt == "json" else []
    return T.StructType(_body(schema) + corrupt + partitions)


def in_range(df: DataFrame, sources: Sequence[str] | None, start: date | None, end: date | None) -> DataFrame:
    """Partition filters: whole folders outside the request are never opened."""
    day = F.concat_ws("-", *DAY_COLUMNS)
    if sources:
        unknown = set(sources) - set(ALLOWED_SOURCE)
        if unknown:
            raise ValueError(f"unknown sources {sorted(unknown)}; allowed: {ALLOWED_SOURCE}")
        df = df.filter(F.col("source").isin(*sources))
    if start:
        df = df.filter(day >= start.isoformat())
    if end:
        df = df.filter(day <= end.isoformat())
    return df


def read_loads(
    spark: SparkSession, path: str, *, schema: T.StructType = ENRICHED, fmt: str = "json",
    sources: Sequence[str] | None = None, start: date | None = None, end: date | None = None,
) -> DataFrame:
    """Every stored row, corrupt lines included (their text is in `_corrupt_record`).

    With both `start` and `end` only the folders of these days are listed; otherwise the whole lake is listed
    before its folders are filtered.
    """
    folders = _folders(spark, path, sources or ALLOWED_SOURCE, start, end) if start and end else [path]
    return in_range(open_folders(spark, path, folders, schema=schema, fmt=fmt), sources, start, end)


def open_folders(
    spark: SparkSession, path: str, folders: Sequence[str], *, schema: T.StructType = ENRICHED, fmt: str = "json"
) -> DataFrame:
    """Rows below some folders of the lake at `path`; other folders are not listed."""
    stored = _lake_schema(schema, fmt)
    if not folders:
        return spark.createDataFrame([], stored)
    reader = spark.read.schema(stored).option("basePath", path)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.format(fmt).load(list(folders))


def safe_id() -> Column:
    return F.translate("finding_id", "/:", "__")


def _folders(spark: SparkSession, path: str, sources: Sequence[str], start: date, end: date) -> list[str]:
    """Patterns for the folders of sources x days, one per source and month, that match something."""
    months: dict[tuple[int, int], list[str]] = {}
    for n in range((end - start).days + 1):
        day = start + timedelta(days=n)
        months.setdefault((day.year, day.month), []).append(f"{day.day:02d}")
    wanted = [
        f"{path}/source={source}/year={y}/month={m:02d}/day={{{','.join(days)}}}"
        for source in sources for (y, m), days in months.items()
    ]
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return [w for w in wanted if len(files.globStatus(jvm.Path(w)) or ())]


def read_findings(
    spark: SparkSession, path: str, *, schema: T.StructType = ENRICHED, fmt: str = "json",
    sources: Sequence[str] | None = None, start: date | None = None, end: date | None = None,
) -> DataFrame:
    """Findings in the lake: the newest row per source, day and safe id; malformed lines left out."""
    rows = read_loads(spark, path, schema=schema, fmt=fmt, sources=sources, start=start, end=end)
    if fmt == "json":
        rows = rows.filter(F.col("finding_id").isNotNull()).drop(CORRUPT)
    rows = rows.withColumn("safe_id", safe_id())
    return last_write_wins(rows).select(*[f.name for f in schema.fields], *DAY_COLUMNS)


def read_scored(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_findings(spark, path, schema=SCORED, **options)


def read_mirror(spark: SparkSession, mirror: str, *, schema: T.StructType = ENRICHED, **options) -> DataFrame:
    """Findings in a columnar mirror. Its rows are unique already: a plain scan with pushed filters, no shuffle."""
    rows = read_loads(spark, mirror, schema=schema, fmt="parquet", **options)
    return rows.select(*[f.name for f in schema.fields], *DAY_COLUMNS)


def read_objects(
    spark: SparkSession, path: str, *, schema: T.StructType = ENRICHED,
    sources: Sequence[str] | None = None, start: date | None = None, end: date | None = None,
) -> DataFrame:
    """Findings kept one object per file under <prefix>/<source>/<yyyy>/<MM>/<dd>/<id>.json.

    Source and day come from the file path, and the filter on them is a file
    filter: other files are listed but not opened.
    """
    files = (
        spark.read.schema(T.StructType(_body(schema)))
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    parts = {
        name: F.regexp_extract("_metadata.file_path", OBJECT_PATH, i)
        for i, name in enumerate(("source", *DAY_COLUMNS), start=1)
    }
    return in_range(files.withColumns(parts), sources, start, end).select(
        *[f.name for f in schema.fields], *DAY_COLUMNS
    )


def write_findings(
    findings: DataFrame, path: str, *, ts: Column, load: str, fmt: str = "json",
    environment: str = "prod", prefix: str = "enriched", announce: Sequence[str] = (),
) -> None:
    """Writes one load, the newest row per key; `ts` is the processing time that picks the day.

    Rows carry `environment` next to the finding, as object metadata would. Each folder in `announce` is a consumer
    that is told which folders were written, after they are (see `sources/feed.py`).
    """
    keyed = with_partition_columns(findings, ts, prefix).drop("object_key")
    rows = last_write_wins(keyed).drop("safe_id").withColumns(
        {"environment": F.lit(environment), "load": F.lit(load)}
    )
    told = Observation(f"folders {uuid.uuid4().hex}")
    if announce:  # counted while the rows are written, not by another pass
        rows = rows.observe(told, F.collect_set(F.struct("source", *DAY_COLUMNS)).alias("days"))
    (
        # Files of even size per folder: adaptive execution splits a hot source or day and merges small ones.
        rows.hint("rebalance", "source", *DAY_COLUMNS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", *DAY_COLUMNS, "load")
        .format(fmt)
        .save(path)
    )
    if announce:
        from watchtide.sources import feed

        try:
            written = [(*day, load) for day in told.get["days"]]
        except Py4JJavaError:  # a plan found empty at run time drops what it observes: look at the folders
            written = feed.folders_of_load(findings.sparkSession, path, load)
        feed.announce(findings.sparkSession, written, uuid.uuid4().hex, announce)


def mirror_days(
    spark: SparkSession, path: str, mirror: str, *, schema: T.StructType = ENRICHED,
    start: date | None = None, end: date | None = None,
) -> None:
    """Copies whole days to a columnar mirror that holds only the newest row per key."""
    rows = read_findings(spark, path, schema=schema, start=start, end=end)
    (
        rows.withColumn("load", F.lit("mirror"))
        .hint("rebalance", "source", *DAY_COLUMNS)
        .sortWithinPartitions("source", *DAY_COLUMNS, "severity", "finding_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", *DAY_COLUMNS, "load")
        .parquet(mirror)
    )


def stream_findings(
    spark: SparkSession, path: str, *, schema: T.StructType = ENRICHED, max_files: int = 10
) -> DataFrame:
    """New finding files as a stream. The checkpoint takes the place of a queue of object keys.

    The lake of scored findings is another root, so a scoring job never sees its own output.
    """
    return (
        spark.readStream.schema(_lake_schema(schema, "json"))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )

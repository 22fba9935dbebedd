"""Audit log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.schemas import CLOUDTRAIL_FILE, CLOUDTRAIL_FILE_FIELDS

# …/<account>/CloudTrail/<region>/<yyyy>/<MM>/<dd>/<file>; each folder may also be written as key=value.
LOG_PATH = (
    r"/(?:\w+=)?(\d{12})/(?:\w+=)?CloudTrail/(?:\w+=)?([^/]+)"
    r"/(?:\w+=)?(\d{4})/(?:\w+=)?(\d{2})/(?:\w+=)?(\d{2})/[^/]+$"
)
PATH_COLUMNS = ("account_id", "region", "year", "month", "day")


def read_cloudtrail(spark: SparkSession, path: str) -> DataFrame:
    """One row per audit record (files hold one JSON object per line), catalog (lower-case) names, nested parts as JSON text.

    account_id, region, year, month and day come from the file path, so filters
    on them leave other files unopened.
    """
    files = (
        spark.read.schema(CLOUDTRAIL_FILE)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    from_path = [
        F.regexp_extract("_metadata.file_path", LOG_PATH, i).alias(name)
        for i, name in enumerate(PATH_COLUMNS, start=1)
    ]
    return files.select(*from_path, F.explode("Records").alias("r")).select(
        *PATH_COLUMNS, *[F.col(f"r.{name}").alias(name.lower()) for name in CLOUDTRAIL_FILE_FIELDS]
    )

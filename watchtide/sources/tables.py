"""Append-only tables: alerts, conversation turns and score captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.schemas import FEATURE_COLUMNS


def append_load(rows: DataFrame, path: str, load: str, *, by: Sequence[str] = ()) -> None:
    """Appends one load; repeating the load replaces it, so a replayed batch adds nothing twice.

    `by` names further partition columns, in front of the load.
    """
    (
        rows.withColumn("load", F.lit(load))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by, "load")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table that may not have been written yet."""
    jvm = spark._jvm.org.apache.hadoop.fs
    if not jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


def score_capture(scored: DataFrame, *, model_version: str) -> DataFrame:
    """Model inputs and outputs as captured next to the scored findings."""
    return scored.select(
        "finding_id",
        F.array(*FEATURE_COLUMNS).alias("features"),
        F.col("anomaly_score").alias("score"),
        "is_anomaly",
        F.lit(model_version).alias("model_version"),
    )

"""Training input and the split data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.schemas import TRAINING, TRAINING_COLUMNS


def union_training_files(frames: list[DataFrame]) -> DataFrame:
    """Frames stacked by column name; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _files(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}").schema(TRAINING)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("escape", '"')
    try:
        df = reader.format(fmt).load(path)
    except AnalysisException:
        return None
    return df if df.inputFiles() else None


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """All .parquet and .csv files below `path` as one frame of the training columns."""
    frames = [df for fmt in ("parquet", "csv") if (df := _files(spark, path, fmt)) is not None]
    if not frames:
        raise ValueError(f"no training files found in {path}")
    return union_training_files(frames).select(*TRAINING_COLUMNS)


def write_split(train: DataFrame, validation: DataFrame, path: str) -> None:
    train.write.mode("overwrite").parquet(f"{path}/train")
    validation.write.mode("overwrite").parquet(f"{path}/validation")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Both sets with their `split` name."""
    sets = [spark.read.parquet(f"{path}/{s}").withColumn("split", F.lit(s)) for s in ("train", "validation")]
    return union_training_files(sets)

"""Model registry: an append-only table of version events, and the evaluation gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Registry states and the highest anomaly rate a model may show.
PENDING, APPROVED = "PendingManualApproval", "Approved"
MAX_ANOMALY_RATE = 0.05
MODEL_COLUMNS = ("model_group", "version", "status", "anomaly_rate", "artifact", "recorded_at")


def write_eval_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def gate(reports: DataFrame, *, max_anomaly_rate: float = MAX_ANOMALY_RATE) -> DataFrame:
    """Reports that may be registered, as pending versions."""
    return reports.filter(F.col("anomaly_rate") <= max_anomaly_rate).withColumn("status", F.lit(PENDING))


def register(reports: DataFrame, path: str, *, group: Column, version: Column, artifact: Column, at: Column) -> None:
    """Appends the versions that pass the gate."""
    gate(reports).select(
        group.alias("model_group"), version.cast("long").alias("version"), "status", "anomaly_rate",
        artifact.alias("artifact"), F.unix_timestamp(at).alias("recorded_at"),
    ).write.mode("append").parquet(path)


def model_states(models: DataFrame) -> DataFrame:
    """The newest event of each version. On equal times approval is the later one."""
    approved_last = F.struct("recorded_at", (F.col("status") == APPROVED).alias("_late"))
    return models.groupBy("model_group", "version").agg(
        F.max_by(F.struct("status", "anomaly_rate", "artifact", "recorded_at"), approved_last).alias("_e")
    ).select("model_group", "version", "_e.*")


def approvals(models: DataFrame, *, when: Column, at: Column) -> DataFrame:
    """Approval events for the pending versions that satisfy `when`."""
    return model_states(models).filter((F.col("status") == PENDING) & when).withColumns(
        {"status": F.lit(APPROVED), "recorded_at": F.unix_timestamp(at)}
    ).select(*MODEL_COLUMNS)


def approve_model(models: DataFrame, path: str, *, when: Column, at: Column) -> None:
    approvals(models, when=when, at=at).write.mode("append").parquet(path)


def keep_latest_models(models: DataFrame) -> DataFrame:
    """The newest approved version of each group: the one to serve."""
    approved = model_states(models).filter(F.col("status") == APPROVED)
    return approved.groupBy("model_group").agg(
        F.max_by(F.struct("version", "anomaly_rate", "artifact"), "version").alias("_m")
    ).select("model_group", "_m.*")

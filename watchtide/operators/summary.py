"""Counts and summaries over findings and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.operators.query import ALLOWED_SOURCE


def evaluation_report(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Anomaly rate, counts and score statistics of a validation set: one row, or one per `by` group."""
    return scores.groupBy(*by).agg(
        (F.count_if("is_anomaly") / F.count(F.lit(1))).alias("anomaly_rate"),
        F.count_if("is_anomaly").alias("anomalies_detected"),
        F.count(F.lit(1)).alias("total_validation_rows"),
        F.struct(
            F.avg("anomaly_score").alias("mean"),
            F.min("anomaly_score").alias("min"),
            F.max("anomaly_score").alias("max"),
        ).alias("score_statistics"),
    )


def training_distribution(scores: DataFrame) -> DataFrame:
    """One row: anomalies among the training rows, as a count and a percentage."""
    anomalies, total = F.count_if("is_anomaly"), F.count(F.lit(1))
    return scores.agg(
        anomalies.alias("anomalies"), total.alias("rows"), (100.0 * anomalies / total).alias("percent")
    )


def finding_counts(findings: DataFrame, *, ts: Column, totals: bool = False) -> DataFrame:
    """Findings per severity, source and day; `totals` adds the roll-up rows."""
    rows = findings.select("severity", "source", F.date_format(ts, "yyyy-MM-dd").alias("day"))
    grouped = rows.rollup("severity", "source", "day") if totals else rows.groupBy("severity", "source", "day")
    return grouped.agg(F.count(F.lit(1)).alias("findings"))


def data_freshness(
    findings: DataFrame, *, ts: Column, as_of: Column, expected: Sequence[str] = ALLOWED_SOURCE, max_age_hours: int = 24
) -> DataFrame:
    """Per source: rows, newest time, and PASS when something arrived within `max_age_hours`.

    An `expected` source without a row is told as well: 0 findings, no newest time, WARN.
    """
    newest = F.max("_at")
    fresh = newest >= as_of - F.make_dt_interval(hours=F.lit(max_age_hours))
    seen = findings.select("source", ts.cast("timestamp").alias("_at"), F.lit(1).alias("_n"))
    due = findings.sparkSession.createDataFrame([(s,) for s in expected], "source string")
    due = due.select("source", F.lit(None).cast("timestamp").alias("_at"), F.lit(0).alias("_n"))
    return seen.unionByName(due).groupBy("source").agg(
        F.sum("_n").alias("findings"),
        F.date_format(newest, "yyyy-MM-dd HH:mm:ss").alias("newest"),
        F.when(fresh, "PASS").otherwise("WARN").alias("status"),
    )

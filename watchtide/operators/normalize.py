"""Source-specific event shapes to one canonical finding, and findings to model input events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions import findings as fx


def _source_parts(events: DataFrame) -> DataFrame:
    """Adds the parsed detail `_d`, the first hub finding `_f`, the severity `_s` and its score `_n`.

    Each is its own step, so that the dispatch below reads finished columns. Only one source has a score; text that
    is no number costs an exception a row, so the others are not tried.
    """
    fields = ("id", "finding_id", "severity", "accountId", "region", "resource_arn", "resource", "findings")
    return (
        events.withColumn("_d", fx.parse_detail(F.col("detail"), *fields))
        .withColumns({"_f": fx.first_of(F.col("_d.findings")), "_s": fx.severity_parts(F.col("_d.severity"))})
        .withColumn("_n", F.when(F.col("source") == fx.GUARDDUTY, fx.severity_score(F.col("_s"))))
    )


def finding_columns(source: Column) -> dict[str, Column]:
    """finding_id, severity and resource_arn, dispatched on the event source."""
    d, finding = F.col("_d"), F.col("_f")
    guardduty, hub = source == fx.GUARDDUTY, source == fx.SECURITYHUB
    return {
        "finding_id": F.when(guardduty, fx.or_default(d["id"], "unknown"))
        .when(hub, fx.or_default(finding["Id"], "unknown"))
        .otherwise(F.coalesce(fx.non_empty(d["id"]), fx.non_empty(d["finding_id"]), F.lit("unknown"))),
        "severity": F.when(guardduty, fx.severity_label(F.col("_n")))
        .when(hub, F.lower(fx.or_default(finding["Severity"]["Label"], "unknown")))
        .otherwise(fx.or_default(fx.python_text(F.col("_s")), "unknown")),
        "resource_arn": F.when(guardduty, fx.guardduty_resource_arn(d))
        .when(hub, fx.or_default(fx.first_of(finding["Resources"])["Id"], ""))
        .otherwise(fx.or_default(d["resource_arn"], "")),
    }


def normalize_findings(
    events: DataFrame, *, enriched_at: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Event envelopes to enriched findings. One JSON parse per row, no shuffle.

    `enriched_at` is the processing time (default now); `keep` names input
    columns to carry along.
    """
    stamp = F.current_timestamp() if enriched_at is None else enriched_at
    parsed = _source_parts(events.withColumn("_at", fx.iso_utc(stamp)))
    cols = finding_columns(F.col("source"))
    return parsed.select(
        *keep,
        cols["finding_id"].alias("finding_id"),
        fx.source_label(F.col("source")).alias("source"),
        fx.or_default(F.col("detail_type"), "unknown").alias("detail_type"),
        cols["severity"].alias("severity"),
        fx.or_default(F.col("account"), "unknown").alias("account_id"),
        fx.or_default(F.col("region"), "unknown").alias("region"),
        cols["resource_arn"].alias("resource_arn"),
        F.create_map().cast("map<string,string>").alias("resource_tags"),
        fx.or_default(F.col("detail"), "{}").alias("raw_detail"),
        F.col("_at").alias("enriched_at"),
    )


def with_partition_columns(findings: DataFrame, ts: Column, prefix: str = "enriched") -> DataFrame:
    """Adds year, month, day, safe_id and the object key for a write at `ts`."""
    return findings.withColumns(
        {
            "year": F.date_format(ts, "yyyy"),
            "month": F.date_format(ts, "MM"),
            "day": F.date_format(ts, "dd"),
            "safe_id": fx.safe_id(F.col("finding_id")),
            "object_key": fx.object_key(prefix, F.col("source"), ts, F.col("finding_id")),
        }
    )


def finding_to_event(findings: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Enriched findings to the event shape the model was trained on."""
    parsed = findings.withColumn("_d", fx.parse_detail(F.col("raw_detail"), "type", "resource", "service"))
    d = F.col("_d")
    user_type = fx.or_default(d["resource"]["accessKeyDetails"]["userType"], "unknown")
    return parsed.select(
        *keep,
        F.col("enriched_at").alias("eventtime"),
        fx.eventsource_of(F.col("source")).alias("eventsource"),
        fx.or_default(d["type"], "UnknownFinding").alias("eventname"),
        fx.source_ip(d).alias("sourceipaddress"),
        F.to_json(F.struct(user_type.alias("type"))).alias("useridentity"),
        F.lit(None).cast("string").alias("errorcode"),
        fx.or_default(F.col("region"), "unknown").alias("awsregion"),
    )


def merge_scores(findings: DataFrame, *, scored_at: Column, model_endpoint: str) -> DataFrame:
    """Completes scored findings; a row without a prediction scores 0.0 and is no anomaly."""
    return findings.withColumns(
        {
            "anomaly_score": F.coalesce(F.col("anomaly_score"), F.lit(0.0)),
            "is_anomaly": F.coalesce(F.col("is_anomaly"), F.lit(False)),
            "scored_at": fx.iso_utc(scored_at),
            "model_endpoint": F.lit(model_endpoint),
        }
    )

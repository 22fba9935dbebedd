"""Alert records: parsing for triage and the text of the alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions import findings as fx

# Alert layout limits.
SUBJECT_LIMIT, DESCRIPTION_LIMIT = 100, 800


def triage_parse(events: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Event envelopes to alert records: kind, id, title, severity, account, region, description, resource.

    Unlike the canonical finding, severity stays raw and resource is a type.
    """
    fields = ("id", "type", "title", "description", "severity", "accountId", "region", "resource", "findings")
    parsed = events.withColumn("_d", fx.parse_detail(F.col("detail"), *fields)).withColumns(
        {"_f": fx.first_of(F.col("_d.findings")), "_s": fx.severity_parts(F.col("_d.severity"))}
    )
    source, d, finding = F.col("source"), F.col("_d"), F.col("_f")
    guardduty, hub = source == fx.GUARDDUTY, source == fx.SECURITYHUB
    raw_severity = fx.or_default(fx.python_text(F.col("_s")), "unknown")

    def pick(from_guardduty: Column, from_hub: Column, from_other: Column) -> Column:
        return F.when(guardduty, from_guardduty).when(hub, from_hub).otherwise(from_other)

    account, region = F.col("account"), F.col("region")
    return parsed.select(
        *keep,
        pick(F.lit("GuardDuty"), F.lit("SecurityHub"), F.coalesce(fx.non_empty(source), F.lit("Unknown"))).alias("kind"),
        fx.or_default(pick(d["id"], finding["Id"], d["id"]), "unknown").alias("id"),
        pick(
            fx.or_default(d["type"], "Unknown finding type"),
            fx.or_default(finding["Title"], "Unknown finding"),
            F.coalesce(fx.non_empty(d["type"]), d["title"], F.lit("Unknown finding")),
        ).alias("title"),
        pick(raw_severity, fx.or_default(finding["Severity"]["Label"], "unknown"), raw_severity).alias("severity"),
        F.coalesce(
            fx.non_empty(pick(d["accountId"], finding["AwsAccountId"], F.lit(None))), account, F.lit("unknown")
        ).alias("account"),
        F.coalesce(
            fx.non_empty(pick(d["region"], finding["Region"], F.lit(None))), region, F.lit("unknown")
        ).alias("region"),
        fx.or_default(pick(d["description"], finding["Description"], d["description"]), "").alias("description"),
        pick(
            fx.or_default(d["resource"]["resourceType"], "unknown"),
            fx.or_default(fx.first_of(finding["Resources"])["Type"], "unknown"),
            F.lit("unknown"),
        ).alias("resource"),
    )


def format_alert(
    alerts: DataFrame, *, triage: Column | None = None, signature: str = "-- Security findings (automated alert)"
) -> DataFrame:
    """Adds `subject` and `body`. `triage` is an optional analyst note column; `signature` is the last line."""
    head = F.format_string("[%s] %s finding in account %s", "severity", "kind", "account")
    subject = F.when(
        F.length(head) > SUBJECT_LIMIT, F.concat(F.substring(head, 1, SUBJECT_LIMIT - 3), F.lit("..."))
    ).otherwise(head)
    note = fx.non_empty(F.lit(None).cast("string") if triage is None else triage)
    # The lines of an alert, in reading order. concat_ws leaves null lines out.
    body = F.concat_ws(
        "\n",
        F.format_string("A %s security finding was detected.", "kind"),
        F.lit(""),
        F.concat(F.lit("Title:     "), "title"),
        F.concat(F.lit("Severity:  "), "severity"),
        F.concat(F.lit("Account:   "), "account"),
        F.concat(F.lit("Region:    "), "region"),
        F.concat(F.lit("Resource:  "), "resource"),
        F.concat(F.lit("Finding ID: "), "id"),
        F.concat(F.lit("\nDescription:\n"), F.substring(fx.non_empty(F.col("description")), 1, DESCRIPTION_LIMIT)),
        F.coalesce(
            F.concat(F.lit("\n----- AI analyst triage -----\n"), note),
            F.lit("\n(Automated triage was not attached to this alert.)"),
        ),
        F.lit("\n" + signature),
    )
    return alerts.withColumns({"subject": subject, "body": body})

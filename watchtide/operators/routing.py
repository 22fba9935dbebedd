"""Event routing rules as predicates, and all rules in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions import findings as fx

# Event types, labels and states the rules name.
GUARDDUTY_TYPE = "GuardDuty Finding"
SECURITYHUB_TYPE = "Security Hub Findings - Imported"
ALERT_LABELS = ("HIGH", "CRITICAL")
NEW_STATUS, ACTIVE_STATE = "NEW", "ACTIVE"
HIGH_SEVERITY = 7
RULES = (
    "route_guardduty_forward",
    "route_securityhub_forward",
    "route_all",
    "route_guardduty_high",
    "route_securityhub_high",
)


def rule_conditions(d: Column) -> dict[str, Column]:
    """Rule name to predicate; `d` is the parsed detail. Null never matches."""
    source, kind = F.col("source"), F.col("detail_type")
    guardduty = (source == fx.GUARDDUTY) & (kind == GUARDDUTY_TYPE)
    hub = (source == fx.SECURITYHUB) & (kind == SECURITYHUB_TYPE)
    severe = fx.is_json_number(fx.variant_kind(d["severity"])) & (
        F.try_variant_get(d["severity"], "$", "double") >= HIGH_SEVERITY
    )
    actionable = F.exists(
        d["findings"],
        lambda f: f["Severity"]["Label"].isin(*ALERT_LABELS)
        & (f["Workflow"]["Status"] == NEW_STATUS)
        & (f["RecordState"] == ACTIVE_STATE),
    )
    return {
        "route_guardduty_forward": guardduty,
        "route_securityhub_forward": hub,
        "route_all": source.isNotNull(),
        "route_guardduty_high": guardduty & severe,
        "route_securityhub_high": hub & actionable,
    }


def _parsed() -> Column:
    return fx.parse_detail(F.col("detail"), "severity", "findings")


def route(events: DataFrame, rule: str) -> DataFrame:
    """Events that match one rule."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {RULES}")
    return events.filter(rule_conditions(_parsed())[rule])


def route_high_severity(events: DataFrame) -> DataFrame:
    """Events that match either alerting rule."""
    rules = rule_conditions(_parsed())
    return events.filter(
        F.coalesce(rules["route_guardduty_high"], F.lit(False))
        | F.coalesce(rules["route_securityhub_high"], F.lit(False))
    )


def route_events(events: DataFrame) -> DataFrame:
    """One row per (event, matching rule), all rules in one pass over the events."""
    parsed = events.withColumn("_d", _parsed())
    matches = F.array(*[F.when(cond, F.lit(name)) for name, cond in rule_conditions(F.col("_d")).items()])
    return parsed.withColumn("rule", F.explode(F.array_compact(matches))).drop("_d")


def select_trail_events(trail: DataFrame) -> DataFrame:
    """Audit events the trail records: management events and object-store data events."""
    touched = F.from_json(F.col("resources"), "array<struct<type string>>")
    return trail.filter(
        (F.col("eventcategory") == "Management")
        | (
            (F.col("eventcategory") == "Data")
            & F.exists(touched, lambda r: r["type"] == "AWS::S3::Object")
        )
    )

"""The structured query surface over scored findings."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allow-lists, limits and the columns a query returns.
ALLOWED_SEVERITY = ("low", "medium", "high", "informational")
ALLOWED_SOURCE = ("guardduty", "securityhub", "custom")
DEFAULT_DAYS, DEFAULT_LIMIT, MAX_LIMIT = 7, 25, 100
TRUE_WORDS = ("true", "1", "yes")
RESULT_COLUMNS = (
    "finding_id", "source", "severity", "account_id", "region",
    "resource_arn", "anomaly_score", "is_anomaly", "enriched_at",
)


def _allowed(name: str, value: Any, allowed: tuple[str, ...]) -> str | None:
    if not value:
        return None
    cleaned = str(value).strip().lower()
    if cleaned not in allowed:
        raise ValueError(f"invalid {name} {value!r}; allowed: {sorted(allowed)}")
    return cleaned


def _whole(value: Any, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def clamp_limit(limit: Any) -> int:
    return min(MAX_LIMIT, max(1, _whole(limit, DEFAULT_LIMIT)))


def time_window(findings: DataFrame, days: int, as_of: datetime) -> Column | None:
    """Rows enriched after `as_of - days`, with the cheaper conditions it implies.

    The exact test parses text, so it cannot reach a file scan. Two weaker tests
    can: ISO text sorts by date (one day of slack covers zone offsets), and a
    finding is never stored under a day before it was enriched.
    """
    try:
        cutoff = as_of - timedelta(days=days)
        slack = f"{cutoff - timedelta(days=1):%Y-%m-%d}"
    except OverflowError:
        return None
    enriched = F.col("enriched_at")
    window = (F.try_to_timestamp(enriched) > F.lit(cutoff)) & (enriched >= slack)
    if {"year", "month", "day"} <= set(findings.columns):
        window &= F.concat_ws("-", "year", "month", "day") >= f"{cutoff:%Y-%m-%d}"
    return window


def top_anomalies(findings: DataFrame, *, limit: Any = DEFAULT_LIMIT) -> DataFrame:
    """Lowest score first, unscored rows last; ties by finding id. A bounded top-k, not a full sort."""
    return findings.orderBy(F.asc_nulls_last("anomaly_score"), F.asc("finding_id")).limit(clamp_limit(limit))


def query_findings(
    findings: DataFrame,
    *,
    severity: str | None = None,
    source: str | None = None,
    days_back: Any = DEFAULT_DAYS,
    only_anomalies: Any = False,
    limit: Any = DEFAULT_LIMIT,
    as_of: datetime | None = None,
) -> DataFrame:
    """Most anomalous findings of the last `days_back` days.

    Text parameters are checked against allow-lists and become literal
    predicates; numbers that do not parse fall back to their defaults.
    """
    now = as_of or datetime.now(timezone.utc)
    conditions = [
        F.col(name) == value
        for name, value in (
            ("severity", _allowed("severity", severity, ALLOWED_SEVERITY)),
            ("source", _allowed("source", source, ALLOWED_SOURCE)),
        )
        if value
    ]
    window = time_window(findings, max(1, _whole(days_back, DEFAULT_DAYS)), now)
    if window is not None:
        conditions.append(window)
    if str(only_anomalies).strip().lower() in TRUE_WORDS:
        conditions.append(F.col("is_anomaly"))
    for condition in conditions:
        findings = findings.filter(condition)
    return top_anomalies(findings.select(*RESULT_COLUMNS), limit=limit)


def expire_rows(rows: DataFrame, *, as_of: Column, expires_at: str = "expires_at") -> DataFrame:
    """Rows whose time to live has not passed at `as_of`."""
    return rows.filter(F.col(expires_at) > as_of)

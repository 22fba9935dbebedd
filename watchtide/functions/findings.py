"""Column expressions over event envelopes and findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchtide.schemas import DETAIL_FIELDS

GUARDDUTY = "aws.guardduty"
SECURITYHUB = "aws.securityhub"
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"

# Label floors of the numeric severity scale.
HIGH_FLOOR, MEDIUM_FLOOR, LOW_ABOVE = 7.0, 4.0, 0.0


def parse_detail(detail: Column, *fields: str) -> Column:
    """One tolerant parse of the named parts of the JSON detail; bad or missing JSON gives null fields."""
    return F.from_json(detail, ", ".join(f"{name} {DETAIL_FIELDS[name]}" for name in fields))


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def non_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, ISO_UTC)


def source_label(source: Column) -> Column:
    return (
        F.when(source == GUARDDUTY, "guardduty")
        .when(source == SECURITYHUB, "securityhub")
        .otherwise("custom")
    )


def variant_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def variant_kind(value: Column) -> Column:
    """'VOID' for JSON null, SQL null when the key is absent."""
    return F.schema_of_variant(value)


def severity_parts(value: Column) -> Column:
    """Struct of a severity's JSON `kind` (null when absent) and `text`; compute it once per row."""
    return F.struct(variant_kind(value).alias("kind"), variant_text(value).alias("text"))


def is_json_number(kind: Column) -> Column:
    return F.coalesce(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False))


def severity_score(severity: Column) -> Column:
    """Number behind a severity, as a lenient float conversion sees it; an absent one counts as 0."""
    kind, text = severity["kind"], severity["text"]
    return (
        F.when(kind.isNull(), 0.0)
        .when(kind == "BOOLEAN", (text == "true").cast("double"))
        .otherwise(text.try_cast("double"))
    )


def severity_label(score: Column) -> Column:
    """Label of a score; a null score is unknown. NaN sorts above all numbers in Spark, so it is named first."""
    return (
        F.when(score.isNull(), "unknown")
        .when(F.isnan(score), "informational")
        .when(score >= HIGH_FLOOR, "high")
        .when(score >= MEDIUM_FLOOR, "medium")
        .when(score > LOW_ABOVE, "low")
        .otherwise("informational")
    )


def python_text(severity: Column) -> Column:
    """Text of a JSON scalar where null, true and false carry Python's spelling; null when absent."""
    kind, text = severity["kind"], severity["text"]
    fraction = kind.startswith("DECIMAL") | (kind == "DOUBLE")
    return (
        F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(fraction, text.try_cast("double").cast("string"))
        .otherwise(text)
    )


def guardduty_resource_arn(detail: Column) -> Column:
    resource = detail["resource"]
    kind = resource["resourceType"]
    region = or_default(detail["region"], "")
    account = or_default(detail["accountId"], "")
    instance = non_empty(resource["instanceDetails"]["instanceId"])
    user = non_empty(resource["accessKeyDetails"]["userName"])
    arn = (
        F.when(kind == "Instance", F.concat(F.lit("arn:aws:ec2:"), region, F.lit(":"), account, F.lit(":instance/"), instance))
        .when(kind == "AccessKey", F.concat(F.lit("arn:aws:iam::"), account, F.lit(":user/"), user))
        .when(kind == "S3Bucket", first_of(resource["s3BucketDetails"])["arn"])
    )
    return or_default(arn, "")


def safe_id(finding_id: Column) -> Column:
    return F.translate(finding_id, "/:", "__")


def object_key(prefix: str, source: Column, ts: Column, finding_id: Column) -> Column:
    """Key of a finding object: prefix/source/yyyy/MM/dd/id.json."""
    return F.concat_ws(
        "/", F.lit(prefix), source, F.date_format(ts, "yyyy/MM/dd"), F.concat(safe_id(finding_id), F.lit(".json"))
    )


def eventsource_of(source_name: Column) -> Column:
    return (
        F.when(source_name == "guardduty", "guardduty.amazonaws.com")
        .when(source_name == "securityhub", "securityhub.amazonaws.com")
        .otherwise("custom.amazonaws.com")
    )


def source_ip(detail: Column) -> Column:
    ip = detail["service"]["action"]["networkConnectionAction"]["remoteIpDetails"]["ipAddressV4"]
    return or_default(ip, "0.0.0.0")


def json_scalar(text: Column, path: str) -> Column:
    """Scalar at `path`; null for objects, arrays, missing paths and bad JSON.

    A string whose text merely starts with a bracket is still a scalar, so the
    decision is made on the JSON type, not on the text.
    """
    value = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = variant_kind(value)
    return F.when(~kind.rlike("^(OBJECT|ARRAY)"), F.try_variant_get(value, "$", "string"))

"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, _S) for name in names]


EVENT = T.StructType(
    _strings("source", "detail_type", "account", "region", "time", "id", "detail")
)

ENRICHED = T.StructType(
    _strings("finding_id", "source", "detail_type", "severity", "account_id", "region", "resource_arn")
    + [T.StructField("resource_tags", T.MapType(_S, _S))]
    + _strings("raw_detail", "enriched_at")
)

SCORED = T.StructType(
    ENRICHED.fields
    + [T.StructField("anomaly_score", T.DoubleType()), T.StructField("is_anomaly", T.BooleanType())]
    + _strings("scored_at", "model_endpoint")
)

# Audit-log field names as they appear in log files. The catalog
# form is the lower-case spelling; the last seven hold nested JSON kept as text.
CLOUDTRAIL_FILE_FIELDS = (
    "eventVersion", "eventTime", "eventSource", "eventName", "awsRegion", "sourceIPAddress",
    "userAgent", "errorCode", "errorMessage", "requestID", "eventID", "eventType", "apiVersion",
    "readOnly", "recipientAccountId", "sharedEventID", "vpcEndpointId", "managementEvent",
    "eventCategory", "userIdentity", "requestParameters", "responseElements",
    "additionalEventData", "resources", "serviceEventDetails", "tlsDetails",
)
CLOUDTRAIL_FILE = T.StructType(
    [T.StructField("Records", T.ArrayType(T.StructType(_strings(*CLOUDTRAIL_FILE_FIELDS))))]
)

TRAINING_COLUMNS = (
    "eventtime", "eventsource", "eventname", "sourceipaddress", "useridentity", "errorcode", "awsregion",
)
TRAINING = T.StructType(_strings(*TRAINING_COLUMNS))

# The model's twelve inputs. The order is a contract between fit and score.
FEATURE_COLUMNS = (
    "hour_of_day", "day_of_week", "is_weekend", "is_business_hours", "is_root_user",
    "is_assumed_role", "is_error_response", "is_console_action", "event_source_rarity",
    "event_name_rarity", "region_rarity", "ip_octet_variance",
)

# Trees are stored in heap order: the children of node i are 2i+1 and 2i+2; feature -1 marks a leaf.
FOREST_NODES = "tree int, node int, feature int, threshold double, n_rows long"

# Parts of a finding's JSON detail that any operator reads; one parse serves them all.
# `severity` stays a variant: JSON null, text and number must be told apart.
# Each operator parses only the parts it names.
DETAIL_FIELDS = {
    "id": "string",
    "finding_id": "string",
    "type": "string",
    "title": "string",
    "description": "string",
    "severity": "variant",
    "accountId": "string",
    "region": "string",
    "resource_arn": "string",
    "resource": """struct<resourceType string, instanceDetails struct<instanceId string>,
        accessKeyDetails struct<userName string, userType string>, s3BucketDetails array<struct<arn string>>>""",
    "service": "struct<action struct<networkConnectionAction struct<remoteIpDetails struct<ipAddressV4 string>>>>",
    "findings": """array<struct<Id string, Title string, Description string, AwsAccountId string, Region string,
        Severity struct<Label string>, Workflow struct<Status string>, RecordState string,
        Resources array<struct<Type string, Id string>>>>""",
}

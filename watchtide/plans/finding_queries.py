"""Queries over envelopes and findings: normalization, routing, structured queries, lookups, de-duplication."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.functions import findings as fx
from watchtide.operators.alerts import format_alert, triage_parse
from watchtide.operators.config_lookup import ITEM_COLUMNS, latest_config, resource_config_lookup
from watchtide.operators.context import cited_findings, event_context, events_near
from watchtide.operators.dedup import claim_check, last_write_wins, ttl_dedup
from watchtide.operators.normalize import finding_to_event, merge_scores, normalize_findings, with_partition_columns
from watchtide.operators.query import expire_rows, query_findings, top_anomalies
from watchtide.operators.requests import session_history, store_turn, validate_requests
from watchtide.operators.routing import route, route_events, select_trail_events
from watchtide.operators.summary import data_freshness, finding_counts
from watchtide.plans.adapters import AS_OF
from watchtide.plans.registry import Inputs, query
from watchtide.sources.knowledge import kb_source_overlap

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)


def as_of():
    return F.lit(NOW)


def normalized(t: Inputs) -> DataFrame:
    return normalize_findings(t.view("envelopes"), enriched_at=F.col("event_ts"), keep=["event_id", "event_ts"])


def stored(t: Inputs) -> DataFrame:
    return last_write_wins(with_partition_columns(normalized(t), F.col("event_ts")))


FINDING = "finding_id, source, detail_type, severity, account_id, region, resource_arn, raw_detail, enriched_at"
FINDING_COLUMNS = FINDING.split(", ")
N = ("envelopes", "normalized")


@query("normalize_findings", f"SELECT event_id, {FINDING}, '{{}}' AS resource_tags FROM normalized", N)
def _(t):
    return normalized(t).select("event_id", *FINDING_COLUMNS, F.to_json("resource_tags").alias("resource_tags"))


@query("union_finding_sources", "SELECT source, count(*) AS findings, count(DISTINCT finding_id) AS ids FROM normalized GROUP BY 1", N)
def _(t):
    return normalized(t).groupBy("source").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("finding_id").alias("ids")
    )


@query("source_label", "SELECT event_id, source AS label FROM normalized", N)
def _(t):
    return t.view("envelopes").select("event_id", fx.source_label(F.col("source")).alias("label"))


@query("severity_label", "SELECT event_id, severity FROM normalized WHERE source = 'guardduty'", N)
def _(t):
    severity = fx.severity_parts(fx.parse_detail(F.col("detail"), "severity")["severity"])
    scored = t.view("envelopes").filter(F.col("source") == fx.GUARDDUTY).withColumn("_s", severity)
    return scored.withColumn("_n", fx.severity_score(F.col("_s"))).select(
        "event_id", fx.severity_label(F.col("_n")).alias("severity")
    )


@query("securityhub_extract", "SELECT event_id, finding_id, severity, resource_arn FROM normalized WHERE source = 'securityhub'", N)
def _(t):
    return normalized(t).filter(F.col("source") == "securityhub").select(
        "event_id", "finding_id", "severity", "resource_arn"
    )


@query("custom_extract", "SELECT event_id, finding_id, severity, resource_arn FROM normalized WHERE source = 'custom'", N)
def _(t):
    return normalized(t).filter(F.col("source") == "custom").select(
        "event_id", "finding_id", "severity", "resource_arn"
    )


@query("guardduty_resource_arn", "SELECT event_id, resource_arn FROM normalized WHERE source = 'guardduty'", N)
def _(t):
    d = fx.parse_detail(F.col("detail"), "accountId", "region", "resource")
    return t.view("envelopes").filter(F.col("source") == fx.GUARDDUTY).withColumn("_d", d).select(
        "event_id", fx.guardduty_resource_arn(F.col("_d")).alias("resource_arn")
    )


@query(
    "partition_columns",
    """SELECT event_id, year, month, day, translate(finding_id, '/:', '__') AS safe_id,
       CONCAT('enriched/', source, '/', year, '/', month, '/', day, '/', translate(finding_id, '/:', '__'), '.json') AS object_key
       FROM normalized""",
    N,
)
def _(t):
    return with_partition_columns(normalized(t), F.col("event_ts")).select(
        "event_id", "year", "month", "day", "safe_id", "object_key"
    )


EVENT_SQL = """
SELECT event_id, enriched_at AS eventtime, CONCAT(source, '.amazonaws.com') AS eventsource,
  COALESCE(json_extract_string(raw_detail, '$.type'), 'UnknownFinding') AS eventname,
  COALESCE(json_extract_string(raw_detail, '$.service.action.networkConnectionAction.remoteIpDetails.ipAddressV4'), '0.0.0.0') AS sourceipaddress,
  CONCAT('{"type":"', COALESCE(json_extract_string(raw_detail, '$.resource.accessKeyDetails.userType'), 'unknown'), '"}') AS useridentity,
  CAST(NULL AS VARCHAR) AS errorcode, region AS awsregion
FROM normalized
"""


@query("finding_to_event", EVENT_SQL, N)
def _(t):
    return finding_to_event(normalized(t), keep=["event_id"])


@query("eventsource_map", f"SELECT event_id, eventsource FROM ({EVENT_SQL})", N)
def _(t):
    return normalized(t).select("event_id", fx.eventsource_of(F.col("source")).alias("eventsource"))


@query("source_ip", f"SELECT event_id, sourceipaddress FROM ({EVENT_SQL})", N)
def _(t):
    return t.view("envelopes").select(
        "event_id", fx.source_ip(fx.parse_detail(F.col("detail"), "service")).alias("sourceipaddress")
    )


@query(
    "safe_json",
    """SELECT event_id, CASE WHEN json_valid(useridentity) THEN json_extract_string(useridentity, '$.type') END AS identity_type
       FROM cloudtrail""",
    ("cloudtrail",),
)
def _(t):
    return t.view("cloudtrail").select("event_id", F.get_json_object("useridentity", "$.type").alias("identity_type"))


@query(
    "json_scalar",
    """SELECT event_id,
         CASE WHEN json_type(detail, '$.resource') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(detail, '$.resource') END AS resource,
         CASE WHEN json_type(detail, '$.severity') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(detail, '$.severity') END AS severity
       FROM envelopes""",
    ("envelopes",),
)
def _(t):
    detail = F.col("detail")
    return t.view("envelopes").select(
        "event_id", fx.json_scalar(detail, "$.resource").alias("resource"),
        fx.json_scalar(detail, "$.severity").alias("severity"),
    )


@query(
    "merge_scores",
    """SELECT finding_id, round(COALESCE(anomaly_score, 0.0), 9) AS anomaly_score, COALESCE(is_anomaly, FALSE) AS is_anomaly,
       strftime(enriched_ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS scored_at, 'forest-1' AS model_endpoint FROM scored""",
    ("scored",),
)
def _(t):
    return merge_scores(t.view("scored"), scored_at=F.col("enriched_ts"), model_endpoint="forest-1").select(
        "finding_id", F.round("anomaly_score", 9).alias("anomaly_score"), "is_anomaly", "scored_at", "model_endpoint"
    )


# --- alert records -------------------------------------------------------------------------------

TRIAGE_SQL = """
SELECT event_id,
  CASE source WHEN 'aws.guardduty' THEN 'GuardDuty' WHEN 'aws.securityhub' THEN 'SecurityHub' ELSE COALESCE(NULLIF(source, ''), 'Unknown') END AS kind,
  COALESCE(CASE WHEN source = 'aws.securityhub' THEN json_extract_string(detail, '$.findings[0].Id') ELSE json_extract_string(detail, '$.id') END, 'unknown') AS id,
  CASE source WHEN 'aws.guardduty' THEN COALESCE(json_extract_string(detail, '$.type'), 'Unknown finding type')
    WHEN 'aws.securityhub' THEN COALESCE(json_extract_string(detail, '$.findings[0].Title'), 'Unknown finding')
    ELSE COALESCE(json_extract_string(detail, '$.type'), json_extract_string(detail, '$.title'), 'Unknown finding') END AS title,
  CASE WHEN source = 'aws.securityhub' THEN COALESCE(json_extract_string(detail, '$.findings[0].Severity.Label'), 'unknown')
    WHEN NOT list_contains(json_keys(detail), 'severity') THEN 'unknown'
    ELSE COALESCE(json_extract_string(detail, '$.severity'), 'None') END AS severity,
  COALESCE(CASE WHEN source = 'aws.guardduty' THEN NULLIF(json_extract_string(detail, '$.accountId'), '') END, account, 'unknown') AS account,
  COALESCE(CASE WHEN source = 'aws.guardduty' THEN NULLIF(json_extract_string(detail, '$.region'), '') END, region, 'unknown') AS region,
  COALESCE(json_extract_string(detail, '$.description'), '') AS description,
  CASE source WHEN 'aws.guardduty' THEN COALESCE(json_extract_string(detail, '$.resource.resourceType'), 'unknown')
    WHEN 'aws.securityhub' THEN COALESCE(json_extract_string(detail, '$.findings[0].Resources[0].Type'), 'unknown') ELSE 'unknown' END AS resource
FROM envelopes
"""


@query("triage_parse", TRIAGE_SQL, ("envelopes",))
def _(t):
    return triage_parse(t.view("envelopes"), keep=["event_id"])


@query(
    "format_alert",
    f"""SELECT event_id, CONCAT('[', severity, '] ', kind, ' finding in account ', account) AS subject,
      CONCAT('A ', kind, ' security finding was detected.', chr(10), chr(10), 'Title:     ', title, chr(10), 'Severity:  ', severity, chr(10),
        'Account:   ', account, chr(10), 'Region:    ', region, chr(10), 'Resource:  ', resource, chr(10), 'Finding ID: ', id, chr(10),
        CASE WHEN description <> '' THEN CONCAT(chr(10), 'Description:', chr(10), description, chr(10)) ELSE '' END,
        chr(10), '(Automated triage was not attached to this alert.)', chr(10), chr(10), '-- Security findings (automated alert)') AS body
      FROM ({TRIAGE_SQL})""",
    ("envelopes",),
)
def _(t):
    return format_alert(triage_parse(t.view("envelopes"), keep=["event_id"])).select("event_id", "subject", "body")


# --- routing -------------------------------------------------------------------------------------

GUARDDUTY = "source = 'aws.guardduty' AND detail_type = 'GuardDuty Finding'"
HUB = "source = 'aws.securityhub' AND detail_type = 'Security Hub Findings - Imported'"
RULE_SQL = {
    "route_guardduty_forward": GUARDDUTY,
    "route_securityhub_forward": HUB,
    "route_all": "source IS NOT NULL",
    "route_guardduty_high": GUARDDUTY
    + " AND json_type(detail, '$.severity') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(json_extract_string(detail, '$.severity') AS DOUBLE) >= 7",
    "route_securityhub_high": HUB
    + """ AND json_extract_string(detail, '$.findings[0].Severity.Label') IN ('HIGH', 'CRITICAL')
      AND json_extract_string(detail, '$.findings[0].Workflow.Status') = 'NEW'
      AND json_extract_string(detail, '$.findings[0].RecordState') = 'ACTIVE'""",
}


def _register_rule(rule: str, condition: str) -> None:
    @query(rule, f"SELECT event_id, source, detail_type, account, region FROM envelopes WHERE {condition}", ("envelopes",))
    def _(t):
        return route(t.view("envelopes"), rule).select("event_id", "source", "detail_type", "account", "region")


for _rule, _condition in RULE_SQL.items():
    _register_rule(_rule, _condition)


@query(
    "route_events",
    " UNION ALL ".join(f"SELECT event_id, '{r}' AS rule FROM envelopes WHERE {c}" for r, c in RULE_SQL.items()),
    ("envelopes",),
)
def _(t):
    return route_events(t.view("envelopes")).select("event_id", "rule")


@query(
    "trail_event_selector",
    """SELECT event_id, eventcategory, eventname FROM cloudtrail WHERE eventcategory = 'Management'
       OR (eventcategory = 'Data' AND list_contains(json_extract_string(resources, '$[*].type'), 'AWS::S3::Object'))""",
    ("cloudtrail",),
)
def _(t):
    return select_trail_events(t.view("cloudtrail")).select("event_id", "eventcategory", "eventname")


# --- structured queries --------------------------------------------------------------------------

RESULT = "finding_id, source, severity, account_id, region, resource_arn, round(anomaly_score, 9) AS anomaly_score, is_anomaly, strftime(enriched_ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS enriched_at"


def scored(t: Inputs) -> DataFrame:
    return t.view("scored").withColumn("enriched_at", fx.iso_utc(F.col("enriched_ts")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("anomaly_score", F.round("anomaly_score", 9))


@query(
    "query_findings",
    f"""SELECT {RESULT} FROM scored
        WHERE severity = 'high' AND source = 'guardduty' AND enriched_ts > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND is_anomaly
        ORDER BY scored.anomaly_score ASC NULLS LAST, finding_id LIMIT 100""",
    ("scored",),
)
def _(t):
    return _rounded(
        query_findings(
            scored(t), severity=" HIGH ", source="guardduty", days_back="14", only_anomalies="yes", limit=9999, as_of=NOW
        )
    )


@query(
    "query_findings_default",
    f"""SELECT {RESULT} FROM scored WHERE enriched_ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
        ORDER BY scored.anomaly_score ASC NULLS LAST, finding_id LIMIT 25""",
    ("scored",),
)
def _(t):
    return _rounded(query_findings(scored(t), as_of=NOW))


@query(
    "top_anomalies",
    "SELECT finding_id, round(anomaly_score, 9) AS anomaly_score FROM scored ORDER BY scored.anomaly_score ASC NULLS LAST, finding_id LIMIT 100",
    ("scored",),
)
def _(t):
    return _rounded(top_anomalies(t.view("scored").select("finding_id", "anomaly_score"), limit=100))


@query(
    "finding_counts",
    "SELECT severity, source, strftime(enriched_ts, '%Y-%m-%d') AS day, count(*) AS findings FROM scored GROUP BY ALL",
    ("scored",),
)
def _(t):
    return finding_counts(t.view("scored"), ts=F.col("enriched_ts"))


@query(
    "finding_totals",
    """SELECT severity, source, strftime(enriched_ts, '%Y-%m-%d') AS day, count(*) AS findings FROM scored
       GROUP BY ROLLUP (severity, source, strftime(enriched_ts, '%Y-%m-%d'))""",
    ("scored",),
)
def _(t):
    return finding_counts(t.view("scored"), ts=F.col("enriched_ts"), totals=True)


@query(
    "data_freshness",
    f"""SELECT source, count(event_id) AS findings, strftime(max(enriched_ts), '%Y-%m-%d %H:%M:%S') AS newest,
        CASE WHEN max(enriched_ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 'PASS' ELSE 'WARN' END AS status
        FROM scored FULL JOIN (VALUES ('guardduty'), ('securityhub'), ('custom'), ('silent')) due(source) USING (source) GROUP BY source""",
    ("scored",),
)
def _(t):
    return data_freshness(
        t.view("scored"), ts=F.col("enriched_ts").cast("timestamp"), as_of=as_of(),
        expected=("guardduty", "securityhub", "custom", "silent"),
    )


# --- requests and conversations ------------------------------------------------------------------

BODY_FLAWS = {0: "'{bad'", 1: "'[1, 2]'", 2: "'{\"question\":\"  \"}'", 3: "''"}


@query(
    "validate_requests",
    """WITH requests AS (
      SELECT doc_id AS request_id, text,
        CASE WHEN doc_id % 29 < 4 THEN doc_id % 29 END AS flaw,
        CASE WHEN doc_id % 3 > 0 THEN CONCAT('s', CAST(doc_id % 11 AS VARCHAR)) END AS sub,
        CASE WHEN doc_id % 2 = 0 THEN CONCAT('n', CAST(doc_id % 7 AS VARCHAR)) END AS username,
        CASE WHEN doc_id % 5 > 0 THEN CONCAT('sess-', CAST(doc_id % 13 AS VARCHAR)) END AS given
      FROM documents), cleaned AS (
      SELECT *, CASE WHEN flaw IS NULL THEN trim(text, concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12))) ELSE '' END AS question FROM requests)
    SELECT request_id, length(question) AS question_chars,
      CASE WHEN flaw IS NULL AND given IS NOT NULL THEN given ELSE CONCAT('sess-', substr(md5(CAST(request_id AS VARCHAR)), 1, 16)) END AS session_id,
      COALESCE(sub, username, 'unknown') AS user_id,
      CASE WHEN flaw = 0 THEN 'Request body must be valid JSON.' WHEN flaw = 1 THEN 'Request body must be a JSON object.'
        WHEN question = '' THEN 'Field ''question'' is required.'
        WHEN length(question) > 4000 THEN 'Field ''question'' is too long (max 4000 chars).' END AS error
    FROM cleaned""",
)
def _(t):
    flaw = F.col("doc_id") % 29
    body = F.when(F.lit(False), F.lit(""))
    for value, text in BODY_FLAWS.items():
        body = body.when(flaw == value, F.expr(text))
    body = body.otherwise(
        F.to_json(F.struct(
            F.col("text").alias("question"),
            F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("sess-"), (F.col("doc_id") % 13).cast("string"))).alias("session_id"),
        ))
    )
    log = t.table("documents").select(
        F.col("doc_id").alias("request_id"),
        body.alias("body"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 11).cast("string"))).alias("sub"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("n"), (F.col("doc_id") % 7).cast("string"))).alias("username"),
    )
    return validate_requests(log).select(
        "request_id", F.length("question").cast("long").alias("question_chars"), "session_id", "user_id", "error"
    )


TURN_SQL = """SELECT session_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp, user_id, question, answer,
  CAST(floor(epoch(ts)) AS BIGINT) + 2592000 AS expires_at FROM turns"""


@query("store_turn", TURN_SQL, ("turns",))
def _(t):
    return store_turn(t.view("turns"), ts=F.col("ts"))


@query("session_history", f"SELECT session_id, timestamp, question FROM ({TURN_SQL})", ("turns",))
def _(t):
    return session_history(store_turn(t.view("turns"), ts=F.col("ts"))).select("session_id", "timestamp", "question")


@query(
    "expire_rows",
    f"SELECT session_id, timestamp, expires_at FROM ({TURN_SQL}) WHERE expires_at > CAST(epoch(TIMESTAMP '2024-01-31 02:00:00') AS BIGINT)",
    ("turns",),
)
def _(t):
    limit = F.unix_timestamp(F.lit(datetime(2024, 1, 31, 2, tzinfo=timezone.utc)))
    return expire_rows(store_turn(t.view("turns"), ts=F.col("ts")), as_of=limit).select(
        "session_id", "timestamp", "expires_at"
    )


# --- lookups -------------------------------------------------------------------------------------

LATEST_SQL = """SELECT resource_id, resource_type, aws_region, configuration, strftime(capture_time, '%Y-%m-%d %H:%M:%S.%f') AS capture_time,
  row_number() OVER (PARTITION BY resource_id ORDER BY capture_time DESC, event_id DESC) AS position FROM config_items"""


def _capture_text(df: DataFrame) -> DataFrame:
    return df.withColumn("capture_time", F.date_format("capture_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("latest_config", f"SELECT * FROM ({LATEST_SQL}) WHERE position <= 3", ("config_items",))
def _(t):
    return _capture_text(latest_config(t.view("config_items"), tie=["event_id"]).select(
        *ITEM_COLUMNS, F.col("position").cast("long").alias("position")
    ))


@query(
    "resource_config_lookup",
    f"""SELECT r.request_id, r.resource_id AS requested,
        CASE WHEN trim(r.resource_id) = '' THEN 'No resource_id provided.'
             WHEN NOT regexp_full_match(trim(r.resource_id), '[A-Za-z0-9\\-_/:.]{{1,256}}') THEN 'Invalid resource_id format.' END AS error,
        i.resource_id, i.resource_type, i.aws_region, i.configuration, i.capture_time, i.position
      FROM config_requests r LEFT JOIN (SELECT * FROM ({LATEST_SQL}) WHERE position <= 3) i
        ON regexp_full_match(trim(r.resource_id), '[A-Za-z0-9\\-_/:.]{{1,256}}')
        AND i.resource_id = regexp_extract(trim(r.resource_id), '[^:/]*$')""",
    ("config_items", "config_requests"),
)
def _(t):
    found = resource_config_lookup(t.view("config_requests"), t.view("config_items"), tie=["event_id"])
    return _capture_text(found).withColumn("position", F.col("position").cast("long"))


@query(
    "kb_source_overlap",
    "SELECT event_id, finding_id, source FROM normalized WHERE finding_id NOT IN (SELECT finding_id FROM normalized WHERE severity = 'high')",
    N,
)
def _(t):
    findings = normalized(t)
    return kb_source_overlap(findings, findings.filter(F.col("severity") == "high")).select(
        "event_id", "finding_id", "source"
    )


# --- de-duplication ------------------------------------------------------------------------------

CLAIM_SQL = """
, seconds AS (SELECT DISTINCT finding_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM claim_events),
claims AS (
  SELECT finding_id, min(s) AS claimed_at FROM seconds GROUP BY finding_id
  UNION ALL
  SELECT c.finding_id, min(n.s) FROM claims c JOIN seconds n ON n.finding_id = c.finding_id AND n.s >= c.claimed_at + 86400
  GROUP BY c.finding_id, c.claimed_at)
"""


@query("ttl_dedup", CLAIM_SQL + "SELECT finding_id, claimed_at, claimed_at + 86400 AS expires_at FROM claims", ("claim_events",))
def _(t):
    return ttl_dedup(t.view("claim_events"), ts=F.col("ts"))


@query(
    "dedup_claim_check",
    CLAIM_SQL
    + """SELECT e.event_id, e.finding_id FROM claim_events e WHERE NOT EXISTS (
      SELECT 1 FROM claims h WHERE h.finding_id = e.finding_id AND h.claimed_at < epoch(TIMESTAMP '2024-01-20')
        AND floor(epoch(e.ts)) >= h.claimed_at AND floor(epoch(e.ts)) < h.claimed_at + 86400)""",
    ("claim_events",),
)
def _(t):
    events = t.view("claim_events")
    cut = F.unix_timestamp(F.lit(datetime(2024, 1, 20, tzinfo=timezone.utc)))
    claims = ttl_dedup(events, ts=F.col("ts")).filter(F.col("claimed_at") < cut)
    return claim_check(events, claims, ts=F.col("ts")).select("event_id", "finding_id")


@query("last_write_wins", f"SELECT event_id, {FINDING} FROM stored", ("envelopes", "normalized", "stored"))
def _(t):
    return stored(t).select("event_id", *FINDING_COLUMNS)


# --- what stands behind a finding ----------------------------------------------------------------

NEAR_SQL = """, near AS (SELECT s.event_id AS finding_event, s.finding_id, e.event_id, e.errorcode,
  CAST(floor(epoch(e.event_ts)) - floor(epoch(s.enriched_ts)) AS BIGINT) AS seconds
  FROM scored s JOIN resource_events e ON e.resource_arn = s.resource_arn
  WHERE floor(epoch(e.event_ts)) - floor(epoch(s.enriched_ts)) BETWEEN -86400 AND 3600)"""


def near(t: Inputs, **options) -> DataFrame:
    return events_near(
        t.view("scored").withColumnRenamed("event_id", "finding_event"), t.view("resource_events"),
        finding_ts=F.col("enriched_ts"), event_ts=F.col("event_ts"), keep=["finding_event", "finding_id"],
        event_keep=["event_id", "errorcode"], before=86400, after=3600, **options,
    )


@query("events_near", NEAR_SQL + " SELECT finding_id, event_id, seconds FROM near", ("scored", "resource_events"))
def _(t):
    return near(t).select("finding_id", "event_id", "seconds")


@query(
    "event_context",
    NEAR_SQL + """ SELECT finding_id, count(*) AS events, min(seconds) AS first_seconds, max(seconds) AS last_seconds,
    count_if(errorcode IS NOT NULL) AS failures FROM near GROUP BY 1""",
    ("scored", "resource_events"),
)
def _(t):
    return event_context(near(t), failed=F.col("errorcode").isNotNull())


@query(
    "cited_findings",
    """, named AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(answer, '\\bf-[0-9]+\\b')) AS cited_id FROM answers)
    SELECT conv_id, turn, cited_id, cited_id IN (SELECT finding_id FROM scored) AS known FROM named""",
    ("answers", "scored"),
)
def _(t):
    return cited_findings(t.view("answers"), t.view("scored"), key=["conv_id", "turn"])

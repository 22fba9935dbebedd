"""Views that let the given tables stand in for audit events, envelopes and findings.

Each view is one SQL text that Spark and the SQL check both run, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"  # the day after the last event

CLOUDTRAIL = """
SELECT event_id,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE ts END AS event_ts,
  CASE WHEN event_id % 79 = 0 THEN NULL ELSE CONCAT(event_type, '.example.com') END AS eventsource,
  CASE WHEN event_id % 101 = 0 THEN 'ConsoleLogin' ELSE CONCAT(event_type, '_', CAST(user_id % 7 AS STRING)) END AS eventname,
  CASE WHEN event_id % 83 = 0 THEN '2001:db8::1' ELSE CONCAT('10.', CAST(user_id % 256 AS STRING), '.',
       CAST(event_id % 256 AS STRING), '.', CAST((event_id * 7) % 254 + 1 AS STRING)) END AS sourceipaddress,
  CASE WHEN event_id % 97 = 0 THEN '{bad' WHEN user_id % 50 = 0 THEN '{"type":"Root"}'
       WHEN user_id % 5 = 0 THEN '{"type":"IAMUser"}' ELSE '{"type":"AssumedRole"}' END AS useridentity,
  CASE WHEN event_type = 'error' THEN 'AccessDenied' END AS errorcode,
  CASE event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-east-2' ELSE 'us-west-2' END AS awsregion,
  CASE WHEN event_type IN ('view', 'click') THEN 'Data' ELSE 'Management' END AS eventcategory,
  CASE WHEN event_type = 'view' THEN '[{"ARN":"arn:aws:s3:::b/k","type":"AWS::S3::Object"}]'
       WHEN event_type = 'click' THEN '[{"type":"AWS::Lambda::Function"}]' END AS resources
FROM events
"""

ENVELOPES = """
SELECT event_id, ts AS event_ts,
  CASE WHEN event_id % 4 <= 1 THEN 'aws.guardduty' WHEN event_id % 4 = 2 THEN 'aws.securityhub'
       WHEN event_id % 8 = 3 THEN 'custom.test' END AS source,
  CASE WHEN event_id % 4 <= 1 THEN 'GuardDuty Finding' WHEN event_id % 4 = 2 THEN 'Security Hub Findings - Imported' END AS detail_type,
  CONCAT('11111111111', CAST(user_id % 4 AS STRING)) AS account,
  CASE event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-east-2' ELSE 'us-west-2' END AS region,
  CASE WHEN event_id % 67 = 0 THEN '{}'
       WHEN event_id % 4 <= 1 THEN CONCAT('{"id":"gd-', CAST(user_id AS STRING), '-', event_type, '","type":"Recon:EC2/', event_type, '"',
         CASE WHEN event_id % 61 = 0 THEN '' WHEN event_id % 53 = 0 THEN ',"severity":null' WHEN event_id % 59 = 0 THEN ',"severity":"not-a-number"'
              WHEN event_id % 47 = 0 THEN ',"severity":"8.5"'
              ELSE CONCAT(',"severity":', CAST(CAST(FLOOR(value) AS BIGINT) % 10 AS STRING)) END,
         ',"accountId":"11111111111', CAST(user_id % 4 AS STRING), '","region":"us-east-1","resource":',
         CASE event_id % 3 WHEN 0 THEN CONCAT('{"resourceType":"Instance","instanceDetails":{"instanceId":"i-', CAST(user_id AS STRING), '"}}')
              WHEN 1 THEN CONCAT('{"resourceType":"AccessKey","accessKeyDetails":{"userName":"u', CAST(user_id AS STRING), '","userType":"', CASE WHEN user_id % 50 = 0 THEN 'Root' ELSE 'AssumedRole' END, '"}}')
              ELSE CONCAT('{"resourceType":"S3Bucket","s3BucketDetails":[{"arn":"arn:aws:s3:::b', CAST(user_id AS STRING), '"}]}') END,
         CASE WHEN event_id % 5 = 0 THEN CONCAT(',"description":"seen ', event_type, '"') ELSE '' END,
         ',"service":{"action":{"networkConnectionAction":{"remoteIpDetails":{"ipAddressV4":"203.0.113.', CAST(event_id % 256 AS STRING), '"}}}}}')
       WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 71 = 0 THEN '{"findings":[]}' ELSE CONCAT('{"findings":[{"Id":"sh/', CAST(user_id AS STRING), ':', event_type, '","Title":"t-', event_type, '","Severity":{"Label":"',
         CASE CAST(FLOOR(value) AS BIGINT) % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END,
         '"},"Workflow":{"Status":"', CASE WHEN event_id % 5 = 0 THEN 'RESOLVED' ELSE 'NEW' END, '"},"RecordState":"', CASE WHEN event_id % 7 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END,
         '","Resources":[{"Type":"AwsS3Bucket","Id":"arn:aws:s3:::b', CAST(user_id AS STRING), '"}]}]}') END
       WHEN event_id % 16 = 7 THEN CONCAT('{"finding_id":"c-', CAST(user_id AS STRING), '","severity":null,"title":"manual"}')
       ELSE CONCAT('{"id":"c-', CAST(user_id AS STRING), '","severity":"Low"}') END AS detail
FROM events
"""

SCORED = """
SELECT CONCAT('f-', CAST(event_id AS STRING)) AS finding_id,
  CASE WHEN event_id % 4 <= 1 THEN 'guardduty' WHEN event_id % 4 = 2 THEN 'securityhub' ELSE 'custom' END AS source,
  CASE WHEN event_id % 41 = 0 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium'
       WHEN value > 5 THEN 'low' ELSE 'informational' END AS severity,
  CONCAT('11111111111', CAST(user_id % 4 AS STRING)) AS account_id,
  CASE event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-east-2' ELSE 'us-west-2' END AS region,
  CONCAT('arn:aws:ec2:us-east-1:11111111111', CAST(user_id % 4 AS STRING), ':instance/i-', CAST(user_id AS STRING)) AS resource_arn,
  CASE WHEN event_id % 103 = 0 THEN NULL ELSE CAST(0.25 AS DOUBLE) - value / 200 END AS anomaly_score,
  CASE WHEN event_id % 103 = 0 THEN NULL ELSE value > 50 END AS is_anomaly,
  ts AS enriched_ts, event_id, user_id
FROM events
"""

METRICS = """
SELECT event_type AS name, CONCAT('d', CAST(user_id % 4 AS STRING)) AS dim, value, ts,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failures,
  CASE WHEN event_type = 'error' THEN 500 + CAST(user_id % 4 AS INT) WHEN event_type = 'signup' THEN 400 + CAST(user_id % 5 AS INT) ELSE 200 END AS status
FROM events
"""

CLAIM_EVENTS = """
SELECT event_id, CONCAT('f-', CAST(user_id AS STRING), '-', event_type) AS finding_id, ts FROM events
"""

CONFIG_ITEMS = """
SELECT CONCAT('i-', CAST(user_id AS STRING)) AS resource_id, event_type AS resource_type,
  CASE event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-east-2' ELSE 'us-west-2' END AS aws_region,
  props AS configuration, ts AS capture_time, event_id
FROM events
"""

CONFIG_REQUESTS = """
SELECT event_id AS request_id,
  CASE event_id % 6 WHEN 0 THEN CONCAT('i-', CAST(user_id AS STRING))
    WHEN 1 THEN CONCAT('arn:aws:ec2:us-east-1:111111111111:instance/i-', CAST(user_id AS STRING))
    WHEN 2 THEN CONCAT('  i-', CAST(user_id AS STRING), ' ')
    WHEN 3 THEN CONCAT('i-', CAST(user_id AS STRING), '; drop')
    WHEN 4 THEN '' ELSE CONCAT('none/x-', CAST(user_id AS STRING)) END AS resource_id
FROM events
"""

CHUNK_TABLE = """
SELECT CONCAT('doc-', CAST(d.doc_id AS STRING)) AS chunk_id, d.text AS chunk, e.embedding, e.label
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
"""

RECORD_LINES = """
SELECT event_id,
  CASE WHEN event_id % 31 = 0 THEN '{"finding_id": broken'
       WHEN event_id % 37 = 0 THEN CONCAT('{"source":"custom","region":"r', CAST(user_id AS STRING), '"}')
       WHEN event_id % 43 = 0 THEN CONCAT('{"finding_id":"f-', CAST(event_id AS STRING), '"}')
       ELSE CONCAT('{"finding_id":"f-', CAST(event_id AS STRING), '","source":"custom"}') END AS value
FROM events
"""

RESOURCE_EVENTS = """
SELECT event_id, CONCAT('arn:aws:ec2:us-east-1:11111111111', CAST(user_id % 4 AS STRING), ':instance/i-', CAST(user_id AS STRING)) AS resource_arn,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE ts END AS event_ts, CASE WHEN event_type = 'error' THEN 'AccessDenied' END AS errorcode
FROM events
"""

ANSWERS = """
SELECT conv_id, turn, CASE WHEN conv_id % 13 = 0 THEN NULL
  ELSE CONCAT('Seen in f-', CAST(conv_id * 3 AS STRING), ' and f-7, xf-8; ', text, ' (f-', CAST(conv_id * 97 + turn AS STRING), '; f-7)') END AS answer
FROM conversations WHERE role = 'assistant'
"""

TURNS = """
SELECT CONCAT('sess-', CAST(q.conv_id AS STRING)) AS session_id, CONCAT('u', CAST(q.conv_id % 9 AS STRING)) AS user_id,
  q.text AS question, a.text AS answer, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * q.turn AS ts
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'
"""

VIEWS = {
    "record_lines": RECORD_LINES,
    "turns": TURNS,
    "resource_events": RESOURCE_EVENTS,
    "answers": ANSWERS,
    "cloudtrail": CLOUDTRAIL,
    "envelopes": ENVELOPES,
    "scored": SCORED,
    "metrics": METRICS,
    "claim_events": CLAIM_EVENTS,
    "config_items": CONFIG_ITEMS,
    "config_requests": CONFIG_REQUESTS,
    "chunk_table": CHUNK_TABLE,
}

# Tables behind a view; all others read `events`.
VIEW_TABLES = {"turns": ("conversations",), "answers": ("conversations",), "chunk_table": ("documents", "embeddings")}

# Canonical findings as the checking engine computes them from `envelopes`.
NORMALIZED = """
SELECT event_id, event_ts,
  CASE WHEN source = 'aws.guardduty' THEN COALESCE(json_extract_string(detail, '$.id'), 'unknown')
       WHEN source = 'aws.securityhub' THEN COALESCE(json_extract_string(detail, '$.findings[0].Id'), 'unknown')
       ELSE COALESCE(NULLIF(json_extract_string(detail, '$.id'), ''), NULLIF(json_extract_string(detail, '$.finding_id'), ''), 'unknown') END AS finding_id,
  CASE source WHEN 'aws.guardduty' THEN 'guardduty' WHEN 'aws.securityhub' THEN 'securityhub' ELSE 'custom' END AS source,
  COALESCE(detail_type, 'unknown') AS detail_type,
  CASE WHEN source = 'aws.guardduty' THEN
         CASE WHEN NOT list_contains(json_keys(detail), 'severity') THEN 'informational'
              WHEN TRY_CAST(json_extract_string(detail, '$.severity') AS DOUBLE) IS NULL THEN 'unknown'
              WHEN TRY_CAST(json_extract_string(detail, '$.severity') AS DOUBLE) >= 7 THEN 'high'
              WHEN TRY_CAST(json_extract_string(detail, '$.severity') AS DOUBLE) >= 4 THEN 'medium'
              WHEN TRY_CAST(json_extract_string(detail, '$.severity') AS DOUBLE) > 0 THEN 'low'
              ELSE 'informational' END
       WHEN source = 'aws.securityhub' THEN LOWER(COALESCE(json_extract_string(detail, '$.findings[0].Severity.Label'), 'unknown'))
       WHEN NOT list_contains(json_keys(detail), 'severity') THEN 'unknown'
       ELSE COALESCE(json_extract_string(detail, '$.severity'), 'None') END AS severity,
  COALESCE(account, 'unknown') AS account_id, COALESCE(region, 'unknown') AS region,
  CASE WHEN source = 'aws.guardduty' THEN
         CASE json_extract_string(detail, '$.resource.resourceType')
           WHEN 'Instance' THEN CONCAT('arn:aws:ec2:', json_extract_string(detail, '$.region'), ':', json_extract_string(detail, '$.accountId'), ':instance/', json_extract_string(detail, '$.resource.instanceDetails.instanceId'))
           WHEN 'AccessKey' THEN CONCAT('arn:aws:iam::', json_extract_string(detail, '$.accountId'), ':user/', json_extract_string(detail, '$.resource.accessKeyDetails.userName'))
           WHEN 'S3Bucket' THEN COALESCE(json_extract_string(detail, '$.resource.s3BucketDetails[0].arn'), '')
           ELSE '' END
       WHEN source = 'aws.securityhub' THEN COALESCE(json_extract_string(detail, '$.findings[0].Resources[0].Id'), '')
       ELSE COALESCE(json_extract_string(detail, '$.resource_arn'), '') END AS resource_arn,
  COALESCE(detail, '{}') AS raw_detail,
  strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS enriched_at,
  strftime(event_ts, '%Y') AS year, strftime(event_ts, '%m') AS month, strftime(event_ts, '%d') AS day
FROM envelopes
"""

# One row per (source, day, safe id): the lake after all writes.
STORED = """
SELECT * FROM normalized
QUALIFY row_number() OVER (PARTITION BY source, year, month, day, translate(finding_id, '/:', '__')
                           ORDER BY enriched_at DESC, raw_detail DESC) = 1
"""

SQL_ONLY = {"normalized": NORMALIZED, "stored": STORED}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the given tables; only those it reads are opened."""
    for source in VIEW_TABLES.get(name, ("events",)):
        table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """`sql` for the checking engine, with the named views in front of it."""
    parts = ",\n".join(f"{name} AS ({(VIEWS | SQL_ONLY)[name]})" for name in names)
    return f"WITH RECURSIVE {parts}\n{sql}" if names else sql

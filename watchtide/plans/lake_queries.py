"""Queries that write to storage and read back, and streaming jobs run to the end of their input."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions import findings as fx
from watchtide.operators.normalize import merge_scores, normalize_findings
from watchtide.operators.requests import store_turn
from watchtide.operators.scoring import score_with_features
from watchtide.operators.sketches import hourly
from watchtide.operators.split import train_val_split
from watchtide.plans.finding_queries import FINDING, FINDING_COLUMNS, CLAIM_SQL, TRIAGE_SQL, TURN_SQL, RULE_SQL
from watchtide.plans.model_queries import FINDING_VIEWS, alarm_sql, fitted, hourly_sql, rounded_hours, scored_findings_sql
from watchtide.plans.registry import Inputs, query
from watchtide.schemas import CLOUDTRAIL_FILE_FIELDS, ENRICHED, FEATURE_COLUMNS
from watchtide.sources import feed, lake
from watchtide.sources.cloudtrail import read_cloudtrail
from watchtide.sources.compaction import compact, read_current
from watchtide.sources.knowledge import kb_ingest, write_chunks
from watchtide.sources.quarantine import parse_records, quarantine_rows, retry_quarantine, split_bad
from watchtide.sources.sessions import store_turns, stored_turns
from watchtide.sources.tables import append_load, score_capture
from watchtide.sources.training import read_split, read_training, write_split
from watchtide.streaming import jobs

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
STORED = ("envelopes", "normalized", "stored")
STORED_SQL = f"SELECT {FINDING}, year, month, day FROM stored"


def event_ts():
    return F.col("event_ts").cast("timestamp")


def _enriched(t: Inputs) -> DataFrame:
    return normalize_findings(t.view("envelopes"), enriched_at=F.col("event_ts"), keep=["event_ts"])


def _write_enriched(t: Inputs, path: str, fmt: str = "json") -> None:
    findings = _enriched(t)
    lake.write_findings(findings, path, ts=F.col("event_ts"), load="batch", fmt=fmt)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*FINDING_COLUMNS, *lake.DAY_COLUMNS)


@query("write_enriched", STORED_SQL, STORED)
def _(t):
    path = t.scratch("enriched")
    _write_enriched(t, path)
    return _flat(lake.read_loads(t.spark, path))


@query(
    "read_enriched",
    f"{STORED_SQL} WHERE source IN ('guardduty', 'custom') AND year || '-' || month || '-' || day BETWEEN '2024-01-10' AND '2024-01-20'",
    STORED,
)
def _(t):
    path = t.scratch("enriched")
    _write_enriched(t, path)
    return _flat(
        lake.read_findings(
            t.spark, path, sources=["guardduty", "custom"], start=date(2024, 1, 10), end=date(2024, 1, 20)
        )
    )


@query("mirror_days", STORED_SQL, STORED)
def _(t):
    path, mirror = t.scratch("enriched"), t.scratch("mirror")
    _write_enriched(t, path)
    lake.mirror_days(t.spark, path, mirror)
    return _flat(lake.read_mirror(t.spark, mirror))


def _stored_findings(t: Inputs) -> DataFrame:
    """The findings, written once: a filter on one that is not stored repeats the parse of its detail for each
    mention of a column, dozens of times a row, and for each load."""
    path = t.scratch("normalized")
    _enriched(t).write.parquet(path)
    return t.spark.read.parquet(path)


def _write_announced(findings: DataFrame, path: str, queues: list[str], parts: list[Column]) -> None:
    """A load per part of the findings, each told to the consumers."""
    for n, part in enumerate(parts):
        lake.write_findings(findings.filter(part), path, ts=F.col("event_ts"), load=f"part-{n}", announce=queues)


@query("read_current", STORED_SQL, STORED)
def _(t):
    path, mirror, announced = t.scratch("enriched"), t.scratch("mirror"), t.scratch("announced")
    findings, late = _stored_findings(t), F.crc32("finding_id") % 50 == 0
    _write_announced(findings, path, [announced], [F.col("severity") == "high", (F.col("severity") != "high") & ~late])
    compact(t.spark, path, mirror, announced)
    _write_announced(findings, path, [announced], [late])
    return _flat(read_current(t.spark, path, mirror, announced))


@query("stream_announcements", "SELECT source, count(*) AS findings FROM stored GROUP BY 1", STORED)
def _(t):
    path, queue, out = t.scratch("enriched"), t.scratch("queue"), t.scratch("feed")
    _write_announced(_stored_findings(t), path, [queue], [F.col("severity") == "high", F.col("severity") != "high"])

    def take(batch: DataFrame, batch_id: int) -> None:
        append_load(feed.announced_rows(batch, path).select("finding_id", F.col("source").alias("src"), *lake.DAY_COLUMNS), out, str(batch_id))

    told = feed.stream_announcements(t.spark, queue, archive=t.scratch("archive"), max_files=1)
    told.writeStream.foreachBatch(take).option("checkpointLocation", t.scratch("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    keys = t.spark.read.parquet(out).select("src", *lake.DAY_COLUMNS, F.translate("finding_id", "/:", "__").alias("id")).distinct()
    return keys.groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("findings"))


@query("stream_enriched", "SELECT source, count(*) AS findings FROM stored GROUP BY 1", STORED)
def _(t):
    path, out = t.scratch("enriched"), t.scratch("feed")
    _write_enriched(t, path)
    feed = lake.stream_findings(t.spark, path, max_files=200).select("finding_id", F.col("source").alias("src"))
    (
        feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", t.scratch("checkpoint"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return t.spark.read.parquet(out).groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("findings"))


SCORED_SQL = """SELECT finding_id, source, severity, round(COALESCE(anomaly_score, 0.0), 9) AS anomaly_score, COALESCE(is_anomaly, FALSE) AS is_anomaly,
  strftime(enriched_ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS scored_at FROM scored"""


def _scored(t: Inputs) -> DataFrame:
    rows = t.view("scored").withColumns(
        {
            "detail_type": F.lit("unknown"),
            "resource_tags": F.create_map().cast("map<string,string>"),
            "raw_detail": F.lit("{}"),
            "enriched_at": fx.iso_utc(F.col("enriched_ts")),
        }
    )
    return merge_scores(rows, scored_at=F.col("enriched_ts"), model_endpoint="forest-1")


def _scored_back(df: DataFrame) -> DataFrame:
    return df.select(
        "finding_id", "source", "severity", F.round("anomaly_score", 9).alias("anomaly_score"), "is_anomaly", "scored_at"
    )


def _write_scored(t: Inputs, path: str) -> None:
    rows = _scored(t).drop("event_id", "user_id")
    lake.write_findings(rows, path, ts=F.col("enriched_ts"), load="batch", prefix="scored")


@query("write_scored", SCORED_SQL, ("scored",))
def _(t):
    path = t.scratch("scored")
    _write_scored(t, path)
    return _scored_back(lake.read_scored(t.spark, path))


@query("read_scored", f"SELECT * FROM ({SCORED_SQL}) WHERE source = 'securityhub' AND scored_at >= '2024-01-15'", ("scored",))
def _(t):
    path = t.scratch("scored")
    _write_scored(t, path)
    return _scored_back(lake.read_scored(t.spark, path, sources=["securityhub"], start=date(2024, 1, 15)))


@query(
    "read_cloudtrail",
    """SELECT CAST(event_id AS VARCHAR) AS eventid, eventname, useridentity, errorcode, awsregion AS region,
         strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day
       FROM (SELECT c.*, e.ts FROM cloudtrail c JOIN events e USING (event_id))""",
    ("cloudtrail",),
)
def _(t):
    # Log files of at most a hundred records each, in the folders an audit trail uses.
    path = t.scratch("trail")
    known = {
        "eventID": F.col("event_id").cast("string"), "eventName": F.col("eventname"),
        "userIdentity": F.col("useridentity"), "errorCode": F.col("errorcode"), "awsRegion": F.col("awsregion"),
    }
    record = F.struct(*[
        known.get(name, F.lit(None).cast("string")).alias(name) for name in CLOUDTRAIL_FILE_FIELDS
    ])
    ts = t.table("events").select("event_id", "ts")
    trail = t.view("cloudtrail").join(ts, "event_id").select(
        F.lit("111111111111").alias("account"), F.lit("CloudTrail").alias("log"), F.col("awsregion").alias("region"),
        *[F.date_format("ts", p).alias(n) for n, p in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))],
        F.floor(F.col("event_id") / 100).alias("_file"), record.alias("r"),
    )
    folders = ["account", "log", "region", "year", "month", "day"]
    files = trail.groupBy(*folders, "_file").agg(F.collect_list("r").alias("Records"))
    files.drop("_file").write.partitionBy(*folders).json(path)
    return read_cloudtrail(t.spark, path).select(
        "eventid", "eventname", "useridentity", "errorcode", "region", "year", "month", "day"
    )


TRAINING_SQL = """SELECT strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS eventtime, eventsource, eventname, sourceipaddress,
  useridentity, errorcode, awsregion FROM cloudtrail"""


def _training(t: Inputs) -> DataFrame:
    trail = t.view("cloudtrail")
    return trail.select(
        fx.iso_utc(F.col("event_ts")).alias("eventtime"), "eventsource", "eventname", "sourceipaddress",
        "useridentity", "errorcode", "awsregion",
    )


def _training_files(t: Inputs) -> str:
    path, rows = t.scratch("training"), _training(t)
    busy = F.col("errorcode").isNull()
    rows.filter(busy).write.parquet(f"{path}/a/part")
    rows.filter(~busy).write.option("header", True).option("escape", '"').csv(f"{path}/b")
    return path


@query("read_training", TRAINING_SQL, ("cloudtrail",))
def _(t):
    return read_training(t.spark, _training_files(t))


@query("union_training_files", "SELECT awsregion, count(*) AS events, count(errorcode) AS errors FROM cloudtrail GROUP BY 1", ("cloudtrail",))
def _(t):
    rows = read_training(t.spark, _training_files(t))
    return rows.groupBy("awsregion").agg(F.count(F.lit(1)).alias("events"), F.count("errorcode").alias("errors"))


@query(
    "write_split",
    """SELECT split, count(*) AS events, sum(event_id) AS ids FROM (
       SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5(CONCAT('42:', CAST(event_id AS VARCHAR))))
         <= CAST(floor((SELECT count(*) FROM cloudtrail) * (1.0 - 0.2)) AS BIGINT) THEN 'train' ELSE 'validation' END AS split FROM cloudtrail)
       GROUP BY 1""",
    ("cloudtrail",),
)
def _(t):
    path = t.scratch("split")
    write_split(*train_val_split(t.view("cloudtrail"), key="event_id"), path)
    return read_split(t.spark, path).groupBy("split").agg(
        F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids")
    )


QUARANTINE_REASON = """CASE WHEN event_id % 31 = 0 THEN 'malformed' WHEN event_id % 37 = 0 THEN 'missing finding_id'
  WHEN event_id % 43 = 0 THEN 'missing source' ELSE 'good' END"""


@query("quarantine", f"SELECT {QUARANTINE_REASON} AS reason, count(*) AS records FROM record_lines GROUP BY 1", ("record_lines",))
def _(t):
    good, bad = split_bad(parse_records(t.view("record_lines"), ENRICHED))
    return (
        good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason"))
        .groupBy("reason").agg(F.count(F.lit(1)).alias("records"))
    )


@query(
    "quarantine_retry",
    f"SELECT value AS record, {QUARANTINE_REASON} AS reason, 3 AS attempts, 1707868800 AS expires_at FROM record_lines WHERE {QUARANTINE_REASON} <> 'good'",
    ("record_lines",),
)
def _(t):
    _, bad = split_bad(parse_records(t.view("record_lines"), ENRICHED))
    table = quarantine_rows(bad, at=F.lit(NOW), text="value")
    for _attempt in range(3):  # the last round finds no attempt left
        _, table = retry_quarantine(table, ENRICHED, at=F.lit(NOW))
    return table.withColumn("attempts", F.col("attempts").cast("int"))


@query(
    "alerts_sink",
    f"SELECT event_id, id, kind, account FROM ({TRIAGE_SQL}) WHERE event_id IN (SELECT event_id FROM envelopes WHERE {RULE_SQL['route_guardduty_high']})",
    ("envelopes",),
)
def _(t):
    from watchtide.operators.alerts import format_alert, triage_parse
    from watchtide.operators.routing import route

    path = t.scratch("alerts")
    alerts = format_alert(triage_parse(route(t.view("envelopes"), "route_guardduty_high"), keep=["event_id"]))
    append_load(alerts, path, "0")
    append_load(alerts, path, "0")  # a replayed batch adds nothing
    return t.spark.read.parquet(path).select("event_id", "id", "kind", "account")


@query(
    "kb_ingest",
    """, told AS (SELECT *, 'enriched' AS origin FROM stored UNION ALL SELECT *, 'scored' FROM stored WHERE severity = 'high'),
    newest AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY origin, source, finding_id ORDER BY enriched_at DESC, raw_detail DESC) = 1)
    SELECT concat_ws('/', origin, source, finding_id) || '#0' AS chunk_id, severity, account_id, resource_arn, enriched_at
    FROM newest n WHERE origin = 'scored' OR NOT EXISTS (
      SELECT 1 FROM newest s WHERE s.origin = 'scored' AND s.source = n.source AND s.finding_id = n.finding_id)""",
    STORED,
)
def _(t):
    path, out = t.scratch("enriched"), t.scratch("chunks")
    _write_enriched(t, path)
    enriched = lake.read_findings(t.spark, path)
    severe = enriched.filter(F.col("severity") == "high").withColumn("anomaly_score", F.lit(-0.1))
    write_chunks(kb_ingest(enriched, severe), out)
    # Every finding is short enough for one chunk, so the chunk holds its whole JSON.
    told = [F.get_json_object("chunk", f"$.{c}").alias(c) for c in ("severity", "account_id", "resource_arn", "enriched_at")]
    return t.spark.read.parquet(out).select("chunk_id", *told)


@query(
    "score_capture",
    scored_findings_sql("normalized") + """SELECT finding_id, round(score, 9) AS score, is_anomaly, '1' AS model_version, """
    + ", ".join(f"f[{i}] AS {c}" for i, c in enumerate(FEATURE_COLUMNS, start=1)) + " FROM scored_findings",
    FINDING_VIEWS,
)
def _(t):
    scored = score_with_features(_enriched(t).drop("event_ts"), fitted(t)[0], model_endpoint="forest-1")
    path = t.scratch("capture")
    append_load(score_capture(scored, model_version="1"), path, "0")
    captured = t.spark.read.parquet(path)
    inputs = [F.round(F.col("features")[i], 9).alias(c) for i, c in enumerate(FEATURE_COLUMNS)]
    return captured.select("finding_id", F.round("score", 9).alias("score"), "is_anomaly", "model_version", *inputs)


# --- streaming -----------------------------------------------------------------------------------


@query("stream_normalize", STORED_SQL, STORED)
def _(t):
    path = t.scratch("enriched")
    jobs.stream_normalize(
        t.stream("envelopes"), path, t.scratch("checkpoint"), job="envelopes", enriched_at=event_ts()
    ).awaitTermination()
    return _flat(lake.read_findings(t.spark, path))


@query(
    "stream_score",
    scored_findings_sql("stored") + f"""SELECT {FINDING}, year, month, day, round(score, 9) AS anomaly_score, is_anomaly,
      enriched_at AS scored_at, '1' AS model_endpoint FROM scored_findings""",
    (*FINDING_VIEWS, "stored"),
)
def _(t):
    path, out = t.scratch("enriched"), t.scratch("scored")
    _write_enriched(t, path)
    feed = lake.stream_findings(t.spark, path, max_files=2000)
    jobs.stream_score(
        feed, out, t.scratch("checkpoint"), job="scores", model=fitted(t)[0],
        scored_at=F.try_to_timestamp(F.col("enriched_at")),
    ).awaitTermination()
    scored = lake.read_scored(t.spark, f"{out}/scored").drop("resource_tags")
    return scored.withColumn("anomaly_score", F.round("anomaly_score", 9))


# Alerting rules, then claims per id by the second, in event-time order.
ALERT_SQL = (
    f""", claim_events AS (SELECT t.id AS finding_id, v.event_ts AS ts FROM ({TRIAGE_SQL}) t JOIN envelopes v USING (event_id)
    WHERE v.event_id IN (SELECT event_id FROM envelopes WHERE ({RULE_SQL['route_guardduty_high']}) OR ({RULE_SQL['route_securityhub_high']})))"""
    + CLAIM_SQL
    + "SELECT finding_id AS id, claimed_at FROM claims"
)


@query("stream_alerts", ALERT_SQL, ("envelopes",))
def _(t):
    path = t.scratch("alerts")
    jobs.stream_alerts(t.stream("envelopes"), path, t.scratch("checkpoint"), job="alerts", ts=event_ts()).awaitTermination()
    return t.spark.read.parquet(path).select("id", "claimed_at")


CLOSED = "(SELECT epoch(max(ts)) - 3600 FROM metrics)"


@query("stream_metrics_hourly", hourly_sql(f"w + 300 <= {CLOSED}"), ("metrics",))
def _(t):
    path = t.scratch("sketches")
    jobs.stream_sketches(t.stream("metrics"), path, t.scratch("checkpoint"), ts=F.col("ts")).awaitTermination()
    return rounded_hours(hourly(t.spark.read.parquet(path), ["name"]))


@query(
    "stream_metrics",
    f"""SELECT * FROM (SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS window_start, name, dim, round(sum(value), 6) AS sum_value,
        round(avg(value), 6) AS avg_value, count(value) AS samples FROM metrics GROUP BY ALL) WHERE window_start + 300 <= {CLOSED}""",
    ("metrics",),
)
def _(t):
    path = t.scratch("metrics")
    jobs.stream_metrics(t.stream("metrics"), path, t.scratch("checkpoint"), ts=F.col("ts")).awaitTermination()
    return t.spark.read.parquet(path).select(
        "window_start", "name", "dim", F.round("sum_value", 6).alias("sum_value"),
        F.round("avg_value", 6).alias("avg_value"), "samples",
    )


@query("stream_alarms", alarm_sql(CLOSED), ("metrics",))
def _(t):
    path = t.scratch("alarms")
    jobs.stream_alarms(
        t.stream("metrics"), path, t.scratch("checkpoint"), ts=F.col("ts"), value=F.col("failures")
    ).awaitTermination()
    return t.spark.read.parquet(path)


@query("late_data", "SELECT 'accepted' AS kind, count(*) AS events FROM events")
def _(t):
    path = t.scratch("late")
    jobs.late_data(t.stream("claim_events"), path, t.scratch("checkpoint"), job="claims", ts=F.col("ts")).awaitTermination()
    kinds = [
        t.spark.read.schema("event_id long").parquet(f"{path}/{kind}").select(F.lit(kind).alias("kind")) for kind in ("accepted", "late")
    ]
    return kinds[0].unionByName(kinds[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("events"))


@query("session_log", TURN_SQL, ("turns",))
def _(t):
    path = t.scratch("sessions")
    store_turns(store_turn(t.view("turns"), ts=F.col("ts")), path, load="batch")
    return stored_turns(t.spark, path)

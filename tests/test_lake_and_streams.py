"""Storage round trips and streams fed in several files, with restarts."""

import json
import random
import shutil
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from watchtide.operators.dedup import ttl_dedup
from watchtide.operators.metrics import alarm_states, window_sums
from watchtide.operators.normalize import normalize_findings
from watchtide.operators.query import query_findings
from watchtide.schemas import ENRICHED, EVENT, SCORED
from watchtide.sources import lake
from watchtide.sources.cloudtrail import read_cloudtrail
from watchtide.sources.knowledge import kb_ingest
from watchtide.sources.quarantine import MAX_ATTEMPTS, parse_records, quarantine_rows, retry_quarantine, split_bad
from watchtide.sources.registry import approve_model, keep_latest_models, model_states, register
from watchtide.sources.tables import read_table
from watchtide.sources.training import read_training
from watchtide.streaming import jobs

DAY = datetime(2026, 5, 20, 10, tzinfo=timezone.utc)


def finding(name, at=DAY, source="aws.guardduty", severity=8):
    detail = {"id": name, "severity": severity, "type": "T"}
    if source == "aws.securityhub":
        detail = {"findings": [{"Id": name, "Severity": {"Label": "HIGH"}, "Workflow": {"Status": "NEW"}, "RecordState": "ACTIVE"}]}
    kind = {"aws.guardduty": "GuardDuty Finding", "aws.securityhub": "Security Hub Findings - Imported"}.get(source, "x")
    return (source, kind, "1", "r", at.isoformat(), name, json.dumps(detail))


def event_frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def at_time():
    return F.try_to_timestamp(F.col("time"))


def write_batch(spark, rows, path, load):
    findings = normalize_findings(event_frame(spark, rows), enriched_at=at_time(), keep=["time"])
    lake.write_findings(findings.drop("environment"), path, ts=at_time(), load=load)


def stored(df):
    return sorted((r.source, r.day, r.finding_id, r.enriched_at[:19]) for r in df.collect())


def test_lake_overwrites_by_key(spark, tmp_path):
    path = str(tmp_path / "lake")
    first = [finding("a/b"), finding("c", DAY + timedelta(days=1)), finding("s", source="aws.securityhub")]
    write_batch(spark, first, path, "1")
    write_batch(spark, first, path, "1")
    assert lake.read_loads(spark, path).count() == 3
    write_batch(spark, [finding("a:b", DAY + timedelta(hours=1))], path, "2")
    assert lake.read_loads(spark, path).count() == 4
    got = stored(lake.read_findings(spark, path))
    assert got == [
        ("guardduty", "20", "a:b", "2026-05-20T11:00:00"),
        ("guardduty", "21", "c", "2026-05-21T10:00:00"),
        ("securityhub", "20", "s", "2026-05-20T10:00:00"),
    ]
    assert stored(lake.read_findings(spark, path, sources=["guardduty"], start=date(2026, 5, 21))) == got[1:2]
    with pytest.raises(ValueError):
        lake.read_findings(spark, path, sources=["nope"])
    mirror = str(tmp_path / "mirror")
    lake.mirror_days(spark, path, mirror)
    lake.mirror_days(spark, path, mirror, start=date(2026, 5, 21))
    assert stored(lake.read_mirror(spark, mirror)) == got


def test_lake_tolerates_malformed_lines(spark, tmp_path):
    path = tmp_path / "lake"
    write_batch(spark, [finding("a")], str(path), "1")
    folder = next(p.parent for p in path.rglob("*.json"))
    (folder / "broken.json").write_text('{"finding_id": "x"\nnot json\n')
    assert lake.read_findings(spark, str(path)).count() == 1
    _, bad = split_bad(lake.read_loads(spark, str(path)), required=("finding_id",))
    assert [r.reason for r in bad.collect()] == ["malformed", "malformed"]


def test_partition_filters_prune_folders(spark, tmp_path):
    path = str(tmp_path / "lake")
    write_batch(spark, [finding("a", DAY + timedelta(days=d)) for d in range(5)], path, "1")
    rows = lake.read_loads(spark, path, start=date(2026, 5, 23))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(concat_ws" in plan.replace("isnotnull", "") or "PartitionFilters: [" in plan
    assert rows.count() == 2
    scored = lake.read_loads(spark, path, schema=SCORED)
    found = query_findings(scored, as_of=DAY + timedelta(days=10))
    assert "concat_ws(-, year" in found._jdf.queryExecution().optimizedPlan().toString()


def test_object_layout(spark, tmp_path):
    for source, day, name in (("guardduty", "2026/05/20", "a"), ("custom", "2026/05/21", "b")):
        folder = tmp_path / "enriched" / source / day
        folder.mkdir(parents=True)
        (folder / f"{name}.json").write_text(json.dumps({"finding_id": name, "source": source, "severity": "high", "resource_tags": {"k": "v"}}))
    rows = lake.read_objects(spark, str(tmp_path / "enriched"))
    assert sorted((r.source, r.day, r.finding_id, r.resource_tags["k"]) for r in rows.collect()) == [
        ("custom", "21", "b", "v"), ("guardduty", "20", "a", "v")
    ]
    assert lake.read_objects(spark, str(tmp_path / "enriched"), sources=["custom"], end=date(2026, 5, 21)).count() == 1


def test_cloudtrail_files(spark, tmp_path):
    folder = tmp_path / "AWSLogs/o-1/111122223333/CloudTrail/us-east-1/2026/05/20"
    folder.mkdir(parents=True)
    records = [{"eventName": "Go", "sourceIPAddress": "1.2.3.4", "userIdentity": {"type": "Root", "n": [1]}}, {"eventID": "2"}]
    (folder / "x.json").write_text(json.dumps({"Records": records}))
    rows = read_cloudtrail(spark, str(tmp_path / "AWSLogs"))
    assert len(rows.columns) == 5 + 26
    got = rows.orderBy("eventname").collect()
    assert got[1].account_id == "111122223333" and got[1].region == "us-east-1" and got[1].day == "20"
    assert json.loads(got[1].useridentity) == {"type": "Root", "n": [1]} and got[0].eventid == "2"


def test_training_files(spark, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError, match="no training files"):
        read_training(spark, str(empty))
    with pytest.raises(ValueError, match="no training files"):
        read_training(spark, str(tmp_path / "missing"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    header = "eventtime,eventsource,eventname,sourceipaddress,useridentity,errorcode,awsregion\n"
    (tmp_path / "in/deep/a.csv").write_text(header + 'T,s,n,1.1.1.1,"{""type"": ""Root""}",,r\n')
    (tmp_path / "in/notes.txt").write_text("x")
    rows = read_training(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 1 and json.loads(rows[0].useridentity) == {"type": "Root"} and rows[0].errorcode is None


def test_quarantine_retries(spark):
    lines = spark.createDataFrame([('{"finding_id":"a","source":"s"}',), ("{bad",), ('{"finding_id":"b"}',)], "value string")
    good, bad = split_bad(parse_records(lines, ENRICHED))
    assert [r.finding_id for r in good.collect()] == ["a"]
    table = quarantine_rows(bad, at=F.lit(DAY), text="value")
    assert sorted(r.reason for r in table.collect()) == ["malformed", "missing source"]
    mended = table.withColumn("record", F.when(F.col("reason") == "malformed", '{"finding_id":"m","source":"s"}').otherwise(F.col("record")))
    recovered, left = retry_quarantine(mended, ENRICHED, at=F.lit(DAY))
    assert [r.finding_id for r in recovered.collect()] == ["m"]
    assert [(r.attempts, r.reason) for r in left.collect()] == [(2, "missing source")]
    for _ in range(5):
        _, left = retry_quarantine(left, ENRICHED, at=F.lit(DAY))
    assert [r.attempts for r in left.collect()] == [MAX_ATTEMPTS]


def test_model_registry(spark, tmp_path):
    path = str(tmp_path / "models")
    reports = spark.createDataFrame([("g", 1, 0.01), ("g", 2, 0.05), ("g", 3, 0.051)], "g string, v int, anomaly_rate double")
    register(reports, path, group=F.col("g"), version=F.col("v"), artifact=F.lit("a"), at=F.lit(DAY))
    models = spark.read.parquet(path)
    assert sorted(r.version for r in models.collect()) == [1, 2]
    assert keep_latest_models(models).count() == 0
    approve_model(models, path, when=F.col("version") == 1, at=F.lit(DAY))
    states = {r.version: r.status for r in model_states(spark.read.parquet(path)).collect()}
    assert states == {1: "Approved", 2: "PendingManualApproval"}
    assert [r.version for r in keep_latest_models(spark.read.parquet(path)).collect()] == [1]


def test_kb_ingest_prefers_scored(spark):
    plain = "source string, finding_id string, enriched_at string, raw_detail string"
    enriched = spark.createDataFrame(
        [("custom", "a", "2", "{}"), ("guardduty", "a", "1", "{}"), ("guardduty", "a", "3", "{}"), ("custom", "b", "2", "{}")], plain
    )
    scored = spark.createDataFrame([("custom", "a", "2", "{}", -0.1), ("custom", "a", "1", "{}", -0.7)], plain + ", anomaly_score double")
    rows = kb_ingest(enriched, scored).collect()
    got = {r.chunk_id: r.chunk for r in rows}
    assert len(rows) == 3 and set(got) == {"scored/custom/a#0", "enriched/guardduty/a#0", "enriched/custom/b#0"}
    assert "-0.1" in got["scored/custom/a#0"] and '"enriched_at":"3"' in got["enriched/guardduty/a#0"]


# --- streams -------------------------------------------------------------------------------------


def feed(spark, path, schema=EVENT):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def drop_file(spark, rows, path, name, schema=EVENT):
    path.mkdir(exist_ok=True)
    frame = spark.createDataFrame(rows, schema)
    (path / name).write_text("\n".join(frame.toJSON().collect()) + "\n")


def test_stream_normalize_equals_batch(spark, tmp_path):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    rows = [finding(f"f{i % 7}", DAY + timedelta(hours=i), "aws.guardduty" if i % 3 else "aws.securityhub") for i in range(40)]
    for part in range(4):
        drop_file(spark, rows[part * 10:part * 10 + 10], inbox, f"{part}.json")
        jobs.stream_normalize(feed(spark, inbox), out, checkpoint, job="t", enriched_at=at_time()).awaitTermination()
    batch = str(tmp_path / "batch")
    write_batch(spark, rows, batch, "all")
    assert stored(lake.read_findings(spark, out)) == stored(lake.read_findings(spark, batch))


def test_two_streams_share_a_lake(spark, tmp_path):
    out = str(tmp_path / "out")
    for job in ("east", "west"):
        drop_file(spark, [finding(f"from-{job}")], tmp_path / job, "0.json")
        jobs.stream_normalize(feed(spark, tmp_path / job), out, str(tmp_path / f"cp-{job}"), job=job).awaitTermination()
    assert sorted(r.finding_id for r in lake.read_findings(spark, out).collect()) == ["from-east", "from-west"]
    with pytest.raises(ValueError):
        jobs.stream_normalize(feed(spark, tmp_path / "east"), out, str(tmp_path / "cp"), job="a/b")


def test_filters_reach_the_lake(spark, tmp_path):
    from watchtide.operators.query import query_findings

    path = str(tmp_path / "lake")
    write_batch(spark, [finding("a")], path, "1")
    plan = query_findings(lake.read_scored(spark, path).filter("source = 'custom'"), days_back=7, limit=5, as_of=DAY)
    text = plan._jdf.queryExecution().toString()
    scan = text[text.rindex("FileScan"):]
    assert "PartitionFilters: []" not in scan and "custom" in scan[scan.index("PartitionFilters"):]


def test_stream_alerts_equals_batch_dedup(spark, tmp_path):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    rows = [finding("hot" if i % 3 else f"id{i % 5}", DAY + timedelta(hours=i * 5, seconds=i % 2)) for i in range(60)]
    rows += [finding("low", severity=3), finding("custom", source="custom")]
    rows.sort(key=lambda r: r[4])
    for part in range(5):
        drop_file(spark, rows[part * 13:part * 13 + 13], inbox, f"{part}.json")
        jobs.stream_alerts(feed(spark, inbox), out, checkpoint, job="t", ts=at_time()).awaitTermination()
    alerts = spark.read.parquet(out)
    high = event_frame(spark, [r for r in rows if r[5] not in ("low", "custom")])
    want = ttl_dedup(high, id_column="id", ts=at_time())
    assert sorted((r.id, r.claimed_at) for r in alerts.collect()) == sorted((r.finding_id, r.claimed_at) for r in want.collect())
    assert alerts.filter(F.col("subject").startswith("[8] GuardDuty finding")).count() == alerts.count()


def claims_of(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_held_alerts_equal_batch_dedup_in_any_order(spark, tmp_path):
    """Events come out of order, across files and restarts; a flush of the watermark releases the last ones."""
    rng = random.Random(5)
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    rows = [finding(f"id{rng.randrange(6)}", DAY + timedelta(minutes=rng.randrange(6000), microseconds=rng.randrange(10**6))) for _ in range(300)]
    rows += [finding("hot", DAY + timedelta(minutes=13 * i)) for i in range(300)] + [finding("low", severity=3)]
    rows.sort(key=lambda r: datetime.fromisoformat(r[4]).timestamp() + rng.uniform(-86_000, 0))  # up to a day late
    for part in range(0, len(rows), 121):
        drop_file(spark, rows[part:part + 121], inbox, f"{part:03d}.json")
        jobs.stream_alerts(feed(spark, inbox), out, checkpoint, job="t", ts=at_time(), hold=86_400).awaitTermination()
    drop_file(spark, [finding("flush", DAY + timedelta(days=30))], inbox, "999.json")
    last = jobs.stream_alerts(feed(spark, inbox), out, checkpoint, job="t", ts=at_time(), hold=86_400)
    last.awaitTermination()
    want = ttl_dedup(event_frame(spark, [r for r in rows if r[5] != "low"]), id_column="id", ts=at_time())
    assert claims_of(spark.read.parquet(out).select("id", "claimed_at")) == claims_of(want.select("finding_id", "claimed_at"))
    # Every id but the flush has left the state, its timer and its waiting alerts with it.
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_alert_state_is_bounded_by_live_claims(spark, tmp_path):
    """Each day brings ids of its own; claims that ended a day ago are gone, and no batch reads the alert table."""
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    sizes = []
    for day in range(6):
        rows = [finding(f"d{day}i{i}", DAY + timedelta(days=day, seconds=i)) for i in range(40)]
        drop_file(spark, rows, inbox, f"{day}.json")
        query = jobs.stream_alerts(feed(spark, inbox), out, checkpoint, job="t", ts=at_time(), hours=12)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        shutil.rmtree(out) if day == 3 else None  # whatever became of earlier alerts, claims still hold
    assert max(sizes[2:]) <= max(sizes[:2])
    rows = [finding("d5i0", DAY + timedelta(days=5, hours=11)), finding("d5i1", DAY + timedelta(days=5, hours=12, seconds=1))]
    drop_file(spark, rows, inbox, "9.json")
    jobs.stream_alerts(feed(spark, inbox), out, checkpoint, job="t", ts=at_time(), hours=12).awaitTermination()
    counts = dict(claims_of(spark.read.parquet(out).groupBy("id").count()))
    assert counts["d5i0"] == 1 and counts["d5i1"] == 2 and len(counts) == 80


METRIC = "ts timestamp, name string, dim string, value double, failures int"


def metric_rows():
    start = datetime(2026, 5, 20, tzinfo=timezone.utc)
    minutes = [0, 1, 6, 12, 40, 41, 47, 90, 300, 301, 600]
    rows = [(start + timedelta(minutes=m), name, "d", float(m), 1 if name == "bad" or m == 90 else 0) for m in minutes for name in ("bad", "good")]
    return rows + [(start + timedelta(minutes=900), "tick", "d", 0.0, 0)]


def test_stream_alarms_equal_batch(spark, tmp_path):
    rows = metric_rows()
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for part in range(0, len(rows), 4):
        drop_file(spark, rows[part:part + 4], inbox, f"{part:03d}.json", METRIC)
        jobs.stream_alarms(feed(spark, inbox, METRIC), out, checkpoint, ts=F.col("ts"), value=F.col("failures")).awaitTermination()
    got = sorted((r.name, r.at, r.state) for r in spark.read.parquet(out).collect())
    horizon = int(rows[-1][0].timestamp()) - 3600
    frame = spark.createDataFrame(rows, METRIC)
    sums = window_sums(frame, ts=F.col("ts"), keys=["name"], value=F.col("failures"))
    want = sorted((r.name, r.at, r.state) for r in alarm_states(sums, horizon=horizon).collect())
    assert got == want and ("good", int(rows[0][0].timestamp()) + 90 * 60, "ALARM") in want
    only_alarm = alarm_states(sums, horizon=horizon, announce_ok=False)
    assert {r.state for r in only_alarm.collect()} == {"ALARM"}


def test_stream_metrics_close_windows(spark, tmp_path):
    rows = metric_rows()
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    drop_file(spark, rows, inbox, "a.json", METRIC)
    jobs.stream_metrics(feed(spark, inbox, METRIC), out, str(tmp_path / "cp"), ts=F.col("ts")).awaitTermination()
    first = spark.read.parquet(out).filter("name = 'bad'").orderBy("window_start").first()
    assert (first.samples, first.sum_value, first.avg_value) == (2, 1.0, 0.5)


def test_late_rows_are_kept(spark, tmp_path):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[finding("a")], [finding("b", DAY - timedelta(minutes=59)), finding("c", DAY - timedelta(minutes=61))], [finding("d", DAY + timedelta(hours=3))]]
    for i, rows in enumerate(batches):
        drop_file(spark, rows, inbox, f"{i}.json")
        jobs.late_data(feed(spark, inbox), out, checkpoint, job="t", ts=at_time()).awaitTermination()
    accepted, late = spark.read.parquet(f"{out}/accepted"), spark.read.parquet(f"{out}/late")
    assert sorted(r.id for r in accepted.collect()) == ["a", "b", "d"]
    assert [(r.id, r.reason) for r in late.collect()] == [("c", "too late")]


def test_late_rows_need_only_the_mark_before(spark, tmp_path):
    """The newest event of a batch long past still counts, though the batches between hold older ones and nothing
    but the last mark is left; without that one the stream stops instead of taking late rows for good ones."""
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: jobs.late_data(feed(spark, inbox), out, checkpoint, job="t", ts=at_time()).awaitTermination()
    for i, minutes in enumerate([0, -30, -45]):
        drop_file(spark, [finding(f"f{i}", DAY + timedelta(minutes=minutes))], inbox, f"{i}.json")
        run()
    marks = sorted((tmp_path / "out" / "marks").iterdir())
    assert len(marks) == 3
    for gone in marks[:2]:
        gone.rename(tmp_path / gone.name)
    drop_file(spark, [finding("old", DAY - timedelta(minutes=61)), finding("new", DAY - timedelta(minutes=59))], inbox, "3.json")
    run()
    assert [r.id for r in spark.read.parquet(f"{out}/late").collect()] == ["old"]
    last = sorted((tmp_path / "out" / "marks").iterdir())[-1]
    last.rename(tmp_path / last.name)
    drop_file(spark, [finding("x")], inbox, "4.json")
    with pytest.raises(Exception, match="no mark of the batch before"):
        run()


def test_stream_score(spark, tmp_path):
    from tests.test_scale_paths import feature_frame
    from watchtide.operators.iforest import Hyperparameters, iforest_fit
    from watchtide.operators.scoring import score_findings

    model = iforest_fit(feature_frame(spark, n=300), key="id", params=Hyperparameters(n_estimators=10))
    path, out = tmp_path / "lake", str(tmp_path / "out")
    write_batch(spark, [finding(f"f{i}", DAY + timedelta(hours=i)) for i in range(10)], str(path), "1")
    folder = next(p.parent for p in path.rglob("*.json"))
    (folder / "broken.json").write_text("not json\n")
    source = lake.stream_findings(spark, str(path), max_files=2)
    jobs.stream_score(source, out, str(tmp_path / "cp"), job="t", model=model, scored_at=F.lit(DAY)).awaitTermination()
    got = {r.finding_id: r.anomaly_score for r in lake.read_scored(spark, f"{out}/scored").collect()}
    batch = score_findings(lake.read_findings(spark, str(path)).drop("year", "month", "day"), model)
    assert got == {r.finding_id: pytest.approx(r.anomaly_score) for r in batch.collect()} and len(got) == 10
    assert read_table(spark, f"{out}/capture", "finding_id string").count() == 10
    assert [r.reason for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["malformed"]
    with pytest.raises(ValueError):
        jobs.stream_score(source, out, str(tmp_path / "cp2"), job="t", model=model, rarity="batch")

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from watchtide.functions import features as feat
from watchtide.functions import findings as fx
from watchtide.operators.alerts import format_alert, triage_parse
from watchtide.operators.config_lookup import resource_config_lookup
from watchtide.operators.features import category_counts, extract_features
from watchtide.operators.normalize import finding_to_event, merge_scores, normalize_findings, with_partition_columns
from watchtide.operators.query import RESULT_COLUMNS, clamp_limit, query_findings
from watchtide.operators.requests import validate_requests
from watchtide.operators.routing import route, route_high_severity
from watchtide.schemas import EVENT, FEATURE_COLUMNS, SCORED, TRAINING

NOW = datetime(2026, 5, 20, tzinfo=timezone.utc)


def events(spark, *rows):
    made = []
    for row in rows:
        row = dict(row)
        if "detail" in row and not isinstance(row["detail"], (str, type(None))):
            row["detail"] = json.dumps(row["detail"])
        made.append(tuple(row.get(f.name) for f in EVENT.fields))
    return spark.createDataFrame(made, EVENT)


def guardduty(**detail):
    return {"source": "aws.guardduty", "detail_type": "GuardDuty Finding", "account": "111122223333", "region": "us-east-1", "detail": detail}


def hub(*findings, **more):
    return {
        "source": "aws.securityhub", "detail_type": "Security Hub Findings - Imported", "account": "999988887777",
        "region": "us-east-1", "detail": {"findings": list(findings)}, **more,
    }


@pytest.mark.parametrize(
    "severity,label",
    [
        (8.5, "high"), (7.0, "high"), (5.0, "medium"), (4.0, "medium"), (2.0, "low"), (0, "informational"),
        (-3, "informational"), ("8.5", "high"), (None, "unknown"), ("not-a-number", "unknown"), (True, "low"),
        ("NaN", "informational"), ([7], "unknown"),
    ],
)
def test_severity_labels(spark, severity, label):
    assert normalize_findings(events(spark, guardduty(id="a", severity=severity))).first().severity == label


def test_absent_severity_and_detail(spark):
    bare = {"source": "aws.guardduty"}
    rows = normalize_findings(events(spark, guardduty(id="a"), bare, {"detail": "not json", "source": "custom.x"})).collect()
    assert [r.severity for r in rows] == ["informational", "informational", "unknown"]
    assert [r.finding_id for r in rows] == ["a", "unknown", "unknown"]
    assert rows[1].raw_detail == "{}" and rows[1].account_id == "unknown" and rows[1].detail_type == "unknown"


@pytest.mark.parametrize(
    "resource,arn",
    [
        ({"resourceType": "Instance", "instanceDetails": {"instanceId": "i-1"}}, "arn:aws:ec2:eu-west-1:5:instance/i-1"),
        ({"resourceType": "AccessKey", "accessKeyDetails": {"userName": "ann"}}, "arn:aws:iam::5:user/ann"),
        ({"resourceType": "S3Bucket", "s3BucketDetails": [{"arn": "arn:aws:s3:::b"}]}, "arn:aws:s3:::b"),
        ({"resourceType": "S3Bucket", "s3BucketDetails": []}, ""),
        ({"resourceType": "Instance"}, ""),
        ({"resourceType": "Other"}, ""),
    ],
)
def test_guardduty_arn(spark, resource, arn):
    row = normalize_findings(events(spark, guardduty(id="a", region="eu-west-1", accountId="5", resource=resource))).first()
    assert row.resource_arn == arn


def test_hub_and_custom(spark):
    rows = normalize_findings(
        events(
            spark,
            hub({"Id": "x/1", "Severity": {"Label": "CRITICAL"}, "Resources": [{"Id": "arn:r"}]}, {"Id": "second"}),
            hub(),
            {"source": "custom.a", "detail": {"finding_id": "f9", "severity": "Low", "resource_arn": "arn:z"}},
            {"detail": {"id": "", "finding_id": "f8", "severity": 5.0}},
            {"detail": {"id": "n", "severity": None}},
        )
    ).collect()
    assert [(r.source, r.finding_id, r.severity, r.resource_arn) for r in rows] == [
        ("securityhub", "x/1", "critical", "arn:r"),
        ("securityhub", "unknown", "unknown", ""),
        ("custom", "f9", "Low", "arn:z"),
        ("custom", "f8", "5.0", ""),
        ("custom", "n", "None", ""),
    ]


def test_key_layout(spark):
    findings = normalize_findings(events(spark, guardduty(id="arn:aws/x:1", severity=8)))
    row = with_partition_columns(findings, F.lit(datetime(2026, 3, 7, tzinfo=timezone.utc))).first()
    assert row.object_key == "enriched/guardduty/2026/03/07/arn_aws_x_1.json"


def test_finding_to_event(spark):
    detail = {
        "type": "Recon:EC2", "resource": {"accessKeyDetails": {"userType": "AssumedRole"}},
        "service": {"action": {"networkConnectionAction": {"remoteIpDetails": {"ipAddressV4": "203.0.113.50"}}}},
    }
    findings = normalize_findings(events(spark, guardduty(**detail), {"source": "s", "detail": "not valid json"}))
    good, bad = finding_to_event(findings).collect()
    assert (good.eventsource, good.eventname, good.sourceipaddress) == ("guardduty.amazonaws.com", "Recon:EC2", "203.0.113.50")
    assert json.loads(good.useridentity) == {"type": "AssumedRole"} and good.errorcode is None
    assert (bad.eventsource, bad.eventname, bad.sourceipaddress) == ("custom.amazonaws.com", "UnknownFinding", "0.0.0.0")


def test_json_scalar(spark):
    df = spark.createDataFrame([('{"a":{"b":1},"c":"{x","d":[1],"e":2.5,"f":null}',), ("{bad",)], "j string")
    got = df.select(*[fx.json_scalar(F.col("j"), f"$.{k}").alias(k) for k in "acdef"]).collect()
    assert tuple(got[0]) == (None, "{x", None, "2.5", None)
    assert tuple(got[1]) == (None,) * 5


def test_merge_scores_fills_missing(spark):
    df = spark.createDataFrame([("a", None, None)], "finding_id string, anomaly_score double, is_anomaly boolean")
    row = merge_scores(df, scored_at=F.lit(NOW), model_endpoint="m").first()
    assert (row.anomaly_score, row.is_anomaly, row.model_endpoint) == (0.0, False, "m")


def test_routing(spark):
    df = events(
        spark,
        guardduty(id="n", severity=7), guardduty(id="quoted", severity="9"), guardduty(id="low", severity=6.9),
        hub({"Id": "split", "Severity": {"Label": "HIGH"}, "Workflow": {"Status": "NEW"}, "RecordState": "ARCHIVED"},
            {"Severity": {"Label": "LOW"}, "RecordState": "ACTIVE"}),
        hub({"Id": "second"}, {"Severity": {"Label": "CRITICAL"}, "Workflow": {"Status": "NEW"}, "RecordState": "ACTIVE"}),
        {"detail": {}},
    )
    assert [json.loads(r.detail)["id"] for r in route(df, "route_guardduty_high").collect()] == ["n"]
    assert [json.loads(r.detail)["findings"][0]["Id"] for r in route(df, "route_securityhub_high").collect()] == ["second"]
    assert route(df, "route_all").count() == 5
    assert route_high_severity(df).count() == 2
    with pytest.raises(ValueError):
        route(df, "nope")


def test_triage_and_alert(spark):
    df = events(
        spark,
        guardduty(id="gd", type="T", severity=8, region="us-east-1", description="d" * 900, resource={"resourceType": "Instance"}),
        hub({"Id": "sh", "Title": "t", "Severity": {"Label": "HIGH"}, "AwsAccountId": "8", "Region": "us-west-2", "Resources": [{"Type": "B"}]}),
        {"detail": {"id": "x1", "title": "manual test"}},
        {"source": "aws.guardduty", "account": "x" * 200, "detail": {}},
    )
    gd, sh, other, long = format_alert(triage_parse(df), triage=F.when(F.col("kind") == "SecurityHub", "isolate")).collect()
    assert gd.subject == "[8] GuardDuty finding in account 111122223333" and gd.resource == "Instance"
    assert "Description:\n" + "d" * 800 + "\n" in gd.body and "not attached" in gd.body
    assert (sh.account, sh.region, sh.resource) == ("8", "us-west-2", "B")
    assert "----- AI analyst triage -----\nisolate\n" in sh.body and "not attached" not in sh.body
    assert (other.kind, other.id, other.title) == ("Unknown", "x1", "manual test")
    assert len(long.subject) == 100 and long.subject.endswith("...")


def scored(spark, *rows):
    base = {"source": "guardduty", "severity": "high", "enriched_at": "2026-05-19T00:00:00+00:00", "is_anomaly": True, "anomaly_score": 0.1}
    made = [tuple({**base, **r}.get(f.name) for f in SCORED.fields) for r in rows]
    return spark.createDataFrame(made, SCORED)


def ids(df):
    return [r.finding_id for r in df.collect()]


def test_query_findings(spark):
    df = scored(
        spark,
        {"finding_id": "null", "anomaly_score": None},
        {"finding_id": "b", "anomaly_score": -0.2}, {"finding_id": "a", "anomaly_score": -0.2},
        {"finding_id": "old", "enriched_at": "2026-05-12T23:00:00Z", "anomaly_score": -9.0},
        {"finding_id": "zone", "enriched_at": "2026-05-12T22:00:00-05:00", "anomaly_score": -1.0},
        {"finding_id": "bad", "enriched_at": "junk"},
        {"finding_id": "crit", "severity": "critical", "is_anomaly": False},
    )
    got = query_findings(df, as_of=NOW)
    assert tuple(got.columns) == RESULT_COLUMNS
    assert ids(got) == ["zone", "a", "b", "crit", "null"]
    assert ids(query_findings(df, severity="HIGH ", only_anomalies="True", limit="2", as_of=NOW)) == ["zone", "a"]
    assert ids(query_findings(df, days_back="not-a-number", as_of=NOW)) == ids(got)
    assert "old" in ids(query_findings(df, days_back="30", as_of=NOW))
    assert "old" in ids(query_findings(df, days_back=10**9, as_of=NOW))
    assert ids(query_findings(df, days_back=-5, as_of=NOW)) == []
    for wrong in ({"severity": "critical"}, {"severity": "x' OR '1'='1"}, {"source": "nope"}):
        with pytest.raises(ValueError):
            query_findings(df, **wrong)


@pytest.mark.parametrize("limit,kept", [(25, 25), ("10", 10), (9999, 100), (0, 1), ("abc", 25), (None, 25)])
def test_limit(limit, kept):
    assert clamp_limit(limit) == kept


def training(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in TRAINING.fields) for r in rows], TRAINING)


def test_features(spark):
    df = training(
        spark,
        {"eventtime": "2026-05-23T14:30:00Z", "eventsource": "s", "eventname": "GetObject", "sourceipaddress": "10.0.1.42",
         "useridentity": '{"type": "AssumedRole"}', "awsregion": "r"},
        {"eventtime": "2026-05-22T03:15:00Z", "eventsource": "s", "eventname": "ConsoleLogin", "sourceipaddress": "2001:db8::1",
         "useridentity": '{"type": "Root"}', "errorcode": "", "awsregion": "r"},
        {"useridentity": "{not valid json}", "eventsource": "q"},
        {},
    )
    rows = extract_features(df).collect()
    assert tuple(extract_features(df).columns) == FEATURE_COLUMNS
    assert rows[0].hour_of_day == 14 / 24 and rows[0].day_of_week == 5 / 7
    assert (rows[0].is_weekend, rows[0].is_business_hours, rows[0].is_assumed_role, rows[0].is_root_user) == (1, 1, 1, 0)
    assert (rows[1].is_weekend, rows[1].is_business_hours, rows[1].is_root_user, rows[1].is_error_response) == (0, 0, 1, 1)
    assert (rows[1].is_console_action, rows[1].ip_octet_variance) == (1, 0)
    octets = [10, 0, 1, 42]
    assert rows[0].ip_octet_variance == pytest.approx(sum((o - 53 / 4) ** 2 for o in octets) / 4 / 10000)
    assert [r.event_source_rarity for r in rows] == [0.0, 0.0, 0.5, 1.0]
    assert (rows[3].hour_of_day, rows[3].day_of_week, rows[3].is_weekend, rows[3].is_business_hours) == (0.5, 3 / 7, 0, 0)


def test_feature_modes(spark):
    df = training(spark, {"eventsource": "s", "eventname": "n"}, {"eventsource": "t"})
    single = extract_features(df, rarity="single").collect()
    assert [(r.event_source_rarity, r.event_name_rarity, r.region_rarity) for r in single] == [(0, 0, 1), (0, 1, 1)]
    counts = category_counts(training(spark, *[{"eventsource": "s"}] * 4, {"eventsource": "u"}))
    baseline = extract_features(df, rarity="baseline", counts=counts).collect()
    assert [r.event_source_rarity for r in baseline] == [0.0, 1.0]
    empty = extract_features(df.limit(0))
    assert empty.count() == 0 and tuple(empty.columns) == FEATURE_COLUMNS
    with pytest.raises(ValueError):
        extract_features(df, rarity="baseline")


@pytest.mark.parametrize("ip,zero", [("1.2.3", True), ("a.b.c.d", True), (None, True), ("300.0.0.0", False), (" 1.2.3.4", False)])
def test_ip_variance(spark, ip, zero):
    got = spark.createDataFrame([(ip,)], "ip string").select(feat.ip_octet_variance(feat.octets(F.col("ip")))).first()[0]
    assert (got == 0.0) == zero


def test_requests(spark):
    rows = [
        (1, '{"question": " hi \\n", "session_id": "s1"}', "sub", "name"),
        (2, "not json", None, "name"), (3, "[1]", None, None), (4, None, "", None), (5, '{"question": "   "}', None, None),
        (6, json.dumps({"question": "x" * 4001}), None, None), (7, json.dumps({"question": "x" * 4000}), None, None),
    ]
    df = spark.createDataFrame(rows, "request_id long, body string, sub string, username string")
    got = {r.request_id: r for r in validate_requests(df).collect()}
    assert (got[1].question, got[1].session_id, got[1].user_id, got[1].error) == ("hi", "s1", "sub", None)
    assert "valid JSON" in got[2].error and got[2].user_id == "name"
    assert "JSON object" in got[3].error and got[3].user_id == "unknown"
    assert "required" in got[4].error and "required" in got[5].error
    assert "too long" in got[6].error and got[7].error is None
    assert got[7].session_id.startswith("sess-") and len(got[7].session_id) == 21


def test_config_lookup_prefers_raw_id(spark):
    items = spark.createDataFrame(
        [("i-1", "T", "r", str(n), n) for n in range(5)] + [("a/i-1", "T", "r", "raw", 9)],
        "resource_id string, resource_type string, aws_region string, configuration string, capture_time int",
    )
    asked = spark.createDataFrame(
        [(1, "i-1"), (2, "a/i-1"), (3, "x:y/i-1"), (4, "none"), (5, "a b"), (6, " "), (7, "i-1/")], "request_id int, resource_id string"
    )
    got = {}
    for r in resource_config_lookup(asked, items).orderBy("request_id", "position").collect():
        got.setdefault(r.request_id, []).append((r.configuration, r.error))
    assert [c for c, _ in got[1]] == ["4", "3", "2"]
    assert [c for c, _ in got[2]] == ["raw"]
    assert [c for c, _ in got[3]] == ["4", "3", "2"]
    assert got[4] == [(None, None)] and got[7] == [(None, None)]
    assert "Invalid" in got[5][0][1] and "No resource_id" in got[6][0][1]

"""Events near findings and cited ids against brute force, with hot resources cut into parts."""

import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators.context import cited_findings, event_context, events_near

AT = 1_700_000_000


def frames(spark, seed=3):
    draw = random.Random(seed)
    place = lambda: draw.choice(["hot", "hot", "hot", "a", "b", None])
    when = lambda: draw.choice([None] + [AT + draw.randrange(4000)] * 12)
    findings = [(f"f-{i % 50}", place(), when()) for i in range(60)]
    events = [(i, place(), when(), "x") for i in range(500)] + [(7, "hot", AT + 100, "x")] * 3
    schema = "resource_arn string, at long"
    return (
        findings, events, spark.createDataFrame(findings, f"finding_id string, {schema}"),
        spark.createDataFrame(events, f"event_id long, {schema}, _bin string"),  # a name the operator uses, too
    )


@pytest.mark.parametrize("before, after, cell_rows", [(60, 30, 100_000), (60, 30, 5), (0, 0, 2), (5000, 0, 40)])
def test_pairs_equal_brute_force(spark, before, after, cell_rows):
    findings, events, f, e = frames(spark)
    got = events_near(
        f, e, finding_ts=F.timestamp_seconds("at"), event_ts=F.timestamp_seconds("at"), before=before, after=after, cell_rows=cell_rows
    )
    want = sorted(
        (fid, eid, at - ft) for fid, where, ft in findings for eid, place, at, _x in events
        if where is not None and where == place and ft is not None and at is not None and -before <= at - ft <= after
    )
    assert sorted(map(tuple, got.collect())) == want
    context = {r.finding_id: (r.events, r.first_seconds, r.last_seconds) for r in event_context(got).collect()}
    for fid, (n, first, last) in context.items():
        apart = [s for i, _e, s in want if i == fid]
        assert (n, first, last) == (len(apart), min(apart), max(apart))
    assert set(context) == {w[0] for w in want}


def test_empty_sides_and_bad_windows(spark):
    _findings, _events, f, e = frames(spark)
    ts = {"finding_ts": F.timestamp_seconds("at"), "event_ts": F.timestamp_seconds("at")}
    assert events_near(f.limit(0), e, **ts).collect() == [] and events_near(f, e.limit(0), **ts).collect() == []
    with pytest.raises(ValueError):
        events_near(f, e, before=-1, **ts)


def test_cited_ids(spark):
    rows = [(1, "see f-1, f-2 and f-1"), (2, "nothing"), (3, None), (4, ""), (5, "af-1 f-9."), (5, "f-9")]
    answers = spark.createDataFrame(rows, "id long, answer string")
    findings = spark.createDataFrame([("f-1",), ("f-1",), ("f-3",), (None,)], "finding_id string")
    got = sorted(map(tuple, cited_findings(answers, findings, key=["id"]).collect()))
    assert got == [(1, "f-1", True), (1, "f-2", False), (5, "f-9", False), (5, "f-9", False)]
    assert cited_findings(answers.limit(0), findings, key=["id"]).collect() == []

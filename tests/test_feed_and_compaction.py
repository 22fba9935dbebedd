"""Readers learn of loads by announcements; merged days are scanned in place and late rows still win."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_lake_and_streams import DAY, at_time, event_frame, finding, stored
from watchtide.operators.normalize import normalize_findings
from watchtide.plans import lake_queries
from watchtide.plans.registry import Inputs
from watchtide.sources import feed, lake
from watchtide.sources.compaction import MARKS, compact, read_current
from watchtide.sources.tables import append_load, read_table


def write(spark, rows, path, load, *queues):
    findings = normalize_findings(event_frame(spark, rows), enriched_at=at_time(), keep=["time"])
    lake.write_findings(findings, path, ts=at_time(), load=load, announce=queues)


def test_announcements_name_what_was_written(spark, tmp_path):
    path, one, two = (str(tmp_path / n) for n in ("lake", "one", "two"))
    write(spark, [finding("a"), finding("b", DAY + timedelta(days=1)), finding("c", source="aws.securityhub")], path, "1", one, two)
    write(spark, [], path, "2", one)
    got = sorted((r.source, r.day, r.load) for r in spark.read.schema(feed.ANNOUNCEMENT).json(one).collect())
    assert got == [("guardduty", "20", "1"), ("guardduty", "21", "1"), ("securityhub", "20", "1")]
    assert spark.read.schema(feed.ANNOUNCEMENT).json(two).count() == 3
    assert sorted((f[0], f[3], f[4]) for f in feed.folders_of_load(spark, path, "1")) == got
    assert feed.folders_of_load(spark, path, "2") == []
    bad = spark.createDataFrame([("x", "a/../b", "2026", "05", "20", "1")], feed.ANNOUNCEMENT).collect()
    with pytest.raises(ValueError, match="no folder"):
        feed.read_folders(spark, path, bad)
    gone = spark.createDataFrame([("x", "custom", "1999", "05", "20", "1")], feed.ANNOUNCEMENT).collect()
    assert feed.read_folders(spark, path, gone).collect() == []


def test_stream_takes_each_load_once_and_archives_it(spark, tmp_path):
    path, queue, out, archive, cp = (str(tmp_path / n) for n in ("lake", "queue", "out", "archive", "cp"))

    def run():
        told = feed.stream_announcements(spark, queue, archive=archive, max_files=1)
        take = lambda batch, n: append_load(feed.announced_rows(batch, path).select("finding_id"), out, str(n))
        told.writeStream.foreachBatch(take).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()

    for n in range(4):
        write(spark, [finding(f"f{n}", DAY + timedelta(days=n))], path, str(n), queue)
    write(spark, [finding("untold")], path, "9")
    run()
    write(spark, [finding("f4")], path, "4", queue)
    run()
    assert sorted(r.finding_id for r in spark.read.parquet(out).collect()) == [f"f{n}" for n in range(5)]
    left = [p for p in (tmp_path / "queue").glob("*.json")]
    assert len(left) <= 2  # files of committed batches have left the queue: a trigger lists only new ones
    with pytest.raises(ValueError, match="outside"):
        feed.stream_announcements(spark, queue, archive=f"{queue}/old")


def test_score_stream_over_announcements(spark, tmp_path):
    from tests.test_scale_paths import feature_frame
    from watchtide.operators.iforest import Hyperparameters, iforest_fit
    from watchtide.streaming import jobs

    model = iforest_fit(feature_frame(spark, n=200), key="id", params=Hyperparameters(n_estimators=5))
    path, queue, out = (str(tmp_path / n) for n in ("lake", "queue", "out"))
    write(spark, [finding(f"f{i}", DAY + timedelta(hours=i)) for i in range(6)], path, "1", queue)
    folder = next(p.parent for p in (tmp_path / "lake").rglob("*.json"))
    (folder / "broken.json").write_text("not json\n")
    told = feed.stream_announcements(spark, queue, archive=str(tmp_path / "archive"))
    jobs.stream_score(
        told, out, str(tmp_path / "cp"), job="t", model=model, scored_at=F.lit(DAY), lake_path=path
    ).awaitTermination()
    assert sorted(r.finding_id for r in lake.read_scored(spark, f"{out}/scored").collect()) == [f"f{i}" for i in range(6)]
    assert [r.reason for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["malformed"]


def test_compaction_is_incremental_and_late_rows_win(spark, tmp_path):
    path, mirror, told = (str(tmp_path / n) for n in ("lake", "mirror", "told"))
    current = lambda **o: stored(read_current(spark, path, mirror, told, **o))
    assert current() == [] and compact(spark, path, mirror, told) is None
    write(spark, [finding("a/b", DAY + timedelta(days=d)) for d in range(4)] + [finding("n")], path, "1", told)
    assert current() == stored(lake.read_findings(spark, path))  # all tail
    assert compact(spark, path, mirror, told) == 1 and compact(spark, path, mirror, told) is None
    assert current() == stored(lake.read_findings(spark, path))  # all mirrored
    newer, older = DAY + timedelta(hours=2), DAY - timedelta(hours=2)
    write(spark, [finding("a:b", newer), finding("n", older), finding("z", newer)], path, "2", told)
    want = stored(lake.read_findings(spark, path))
    assert current() == want and ("guardduty", "20", "a:b", newer.isoformat()[:19]) in want
    assert ("guardduty", "20", "n", DAY.isoformat()[:19]) in want
    assert current(start=date(2026, 5, 21)) == stored(lake.read_findings(spark, path, start=date(2026, 5, 21)))
    before = sorted(p.name for p in (tmp_path / "mirror" / "rows").rglob("*day=21/*"))
    assert compact(spark, path, mirror, told) == 2
    assert sorted(p.name for p in (tmp_path / "mirror" / "rows").rglob("*day=21/*")) == before == ["load=g1"]
    assert current() == want
    write(spark, [finding("z", newer + timedelta(hours=1))], path, "2", told)  # a load repeated, now with other rows
    assert ("guardduty", "20", "z", (newer + timedelta(hours=1)).isoformat()[:19]) in current()


def test_a_generation_without_marks_is_never_read(spark, tmp_path, monkeypatch):
    path, mirror, told = (str(tmp_path / n) for n in ("lake", "mirror", "told"))
    write(spark, [finding("a"), finding("b", DAY + timedelta(days=1))], path, "1", told)
    rows = lake.read_findings(spark, path).withColumn("finding_id", F.lit("half-done")).withColumn("load", F.lit("g1"))
    rows.write.partitionBy("source", "year", "month", "day", "load").parquet(f"{mirror}/rows")
    want = stored(lake.read_findings(spark, path))
    assert stored(read_current(spark, path, mirror, told)) == want
    assert compact(spark, path, mirror, told) == 1 and stored(read_current(spark, path, mirror, told)) == want
    assert read_table(spark, f"{mirror}/marks", MARKS).count() == 2


def test_mirrored_rows_are_not_shuffled(spark, tmp_path):
    path, mirror, told = (str(tmp_path / n) for n in ("lake", "mirror", "told"))
    write(spark, [finding(f"f{i}", DAY + timedelta(days=i % 3)) for i in range(30)], path, "1", told)
    compact(spark, path, mirror, told)
    plan = read_current(spark, path, mirror, told)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    write(spark, [finding("f0", DAY + timedelta(hours=1))], path, "2", told)
    joined = read_current(spark, path, mirror, told)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # that of the tail and the few rows it may overwrite
    assert stored(joined) == stored(lake.read_findings(spark, path))


def test_loads_of_a_query_parse_each_finding_once(spark):
    """A load's filter reads stored columns; pushed below the parse it would repeat it for each mention."""
    t = Inputs(spark, SMALL)
    findings = lake_queries._stored_findings(t)
    some = findings.filter(F.col("severity") == "high")
    assert "from_json" not in some._jdf.queryExecution().optimizedPlan().toString().lower()
    want = lake_queries._enriched(t).filter(F.col("severity") == "high")
    assert some.columns == want.columns
    assert some.drop("resource_tags").exceptAll(want.drop("resource_tags")).count() == 0 and some.count() == want.count() > 0

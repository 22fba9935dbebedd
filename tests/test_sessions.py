"""The stored conversation log: loads, replays, and what reading one session opens."""

from pyspark.sql import functions as F

from watchtide.operators.requests import session_history
from watchtide.sources.sessions import BUCKETS, TURNS, store_turns, stored_turns


def turns(spark, sessions, each, day):
    return spark.createDataFrame(
        [(f"s{s}", f"2024-01-{day:02d}T00:{n // 60:02d}:{n % 60:02d}", "u", f"q{n}", "a", 1_700_000_000 + day) for s in range(sessions) for n in range(each)],
        TURNS,
    )


def scan_metric(rows, name):
    plan = rows._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply(name).value()


def test_loads_add_and_replays_replace(spark, tmp_path):
    path = str(tmp_path / "log")
    first, second = turns(spark, 30, 4, 1), turns(spark, 40, 3, 2)
    for load, rows in (("a", first), ("b", second), ("a", first)):
        store_turns(rows, path, load=load)
    want = sorted(map(tuple, first.union(second).collect()))
    assert sorted(map(tuple, stored_turns(spark, path).collect())) == want
    one = [tuple(r) for r in session_history(stored_turns(spark, path, "s7")).collect()]
    assert one == [r for r in want if r[0] == "s7"] and len(one) == 7
    assert stored_turns(spark, path, "s39").count() == 3 and stored_turns(spark, path, "nobody").count() == 0
    kept = stored_turns(spark, path, as_of=F.timestamp_seconds(F.lit(1_700_000_001)))
    assert kept.count() == second.count()


def test_one_session_opens_one_bucket(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = turns(spark, 2000, 3, 1).union(spark.createDataFrame([(None, "t", "u", "q", "a", 1)], TURNS))
    store_turns(rows, path, load="a")
    every, one = stored_turns(spark, path), stored_turns(spark, path, "s1234")
    assert every.count() == 6001 and sorted(r["question"] for r in one.collect()) == ["q0", "q1", "q2"]
    every = stored_turns(spark, path)
    assert len(every.collect()) == 6001
    files = scan_metric(every, "numFiles")
    assert files >= BUCKETS and scan_metric(one, "numFiles") <= files // BUCKETS + 1
    assert scan_metric(one, "numOutputRows") < 6001 // 16
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "(bucket" in plan and "EqualTo(session_id,s1234)" in plan


def test_no_table_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    assert stored_turns(spark, path, "s1").collect() == []
    store_turns(spark.createDataFrame([], TURNS), path, load="a")
    assert stored_turns(spark, path).collect() == []


def test_a_session_with_most_rows_is_split(spark, tmp_path):
    path = str(tmp_path / "log")
    long = spark.range(60_000).select(
        F.lit("hot").alias("session_id"), F.col("id").cast("string").alias("timestamp"), F.lit("u").alias("user_id"),
        F.sha2(F.col("id").cast("string"), 512).alias("question"), F.lit("a").alias("answer"), F.col("id").alias("expires_at"),
    )
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
        store_turns(long.unionByName(turns(spark, 50, 2, 1)), path, load="a")
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
    found = stored_turns(spark, path, "hot")
    assert len(found.collect()) == 60_000 and scan_metric(found, "numFiles") > 4

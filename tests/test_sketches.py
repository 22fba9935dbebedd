"""Quantile sketches hold their accuracy however they are merged."""

import math
import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators.sketches import bucket_of, bucket_value, hourly, sketch_quantiles, sketch_windows


def exact(values, p):
    return sorted(values)[math.floor((len(values) - 1) * p)]


def test_hours_rolled_from_windows_are_within_the_accuracy(spark):
    draw = random.Random(7)
    rows = [
        (draw.choice(["hot", "hot", "cold"]), f"d{draw.randrange(3)}", draw.choice([-1, 1]) * 10 ** draw.uniform(-6, 6), draw.randrange(7200))
        for _ in range(4000)
    ] + [("zero", "d0", 0.0, 5), ("zero", "d1", -3.0, 5), ("zero", "d1", 0.0, 6)]
    df = spark.createDataFrame(rows, "name string, dim string, value double, at long")
    for accuracy in (0.01, 0.001):
        sketches = sketch_windows(df, ts=F.timestamp_seconds("at"), accuracy=accuracy)
        got = hourly(sketches, ["name"], {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}, accuracy).collect()
        groups = {}
        for name, _dim, value, at in rows:
            groups.setdefault((at - at % 3600, name), []).append(value)
        assert len(got) == len(groups)
        for r in got:
            values = groups[(r.hour_start, r.name)]
            assert r.samples == len(values) and r.sum_value == pytest.approx(sum(values), abs=1e-3)
            for name, p in (("p0", 0.0), ("p10", 0.1), ("p50", 0.5), ("p99", 0.99), ("p100", 1.0)):
                want = exact(values, p)
                assert abs(r[name] - want) <= accuracy * abs(want) * (1 + 1e-9), (r, name, want)


def test_merging_in_any_order_gives_the_same_sketch(spark):
    df = spark.range(500).select(
        F.concat(F.lit("m"), F.col("id") % 2).alias("name"), F.concat(F.lit("d"), F.col("id") % 5).alias("dim"),
        (F.col("id") * 3).cast("double").alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
    )
    fine = sketch_windows(df, ts=F.col("ts"))
    coarse = sketch_windows(df.withColumn("dim", F.lit("all")), ts=F.col("ts"))
    a = sketch_quantiles(fine, ["name"]).orderBy("name").collect()
    assert a == sketch_quantiles(coarse.repartition(7), ["name"]).orderBy("name").collect()


def test_edges(spark):
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "value double").withColumns(
        {"name": F.lit(None).cast("string"), "dim": F.lit("d"), "ts": F.lit(None).cast("timestamp"), "bucket": F.lit("clash")}
    )
    sketches = sketch_windows(df, ts=F.col("ts"))
    row = sketch_quantiles(sketches, ["name"], {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    assert row.samples == 6 and (row.min_value, row.max_value) == (-1.7e308, 1.7e308)
    assert abs(row.low / -1.7e308 - 1) <= 0.01 and abs(row.high / 1.7e308 - 1) <= 0.01 and abs(row.mid) < 1e-300
    assert sketch_quantiles(sketch_windows(df.limit(0), ts=F.col("ts")), ["name"]).collect() == []
    back = spark.createDataFrame([(v,) for v in (1e-5, 0.3, 1.0, 77.0, -4.0)], "v double")
    for r in back.select("v", bucket_value(bucket_of(F.col("v"))).alias("b")).collect():
        assert abs(r.b - r.v) <= 0.01 * abs(r.v) * (1 + 1e-9)
    with pytest.raises(ValueError, match="accuracy"):
        bucket_of(F.col("v"), 0.0)

"""Mergeable quantile sketches as plain rows: counts per logarithmic bucket (after Masson, Rim and Lee, 2019).

A value falls into bucket ceil(log_g |v|) of its sign, g = (1 + a) / (1 - a). Any value of a bucket is within the
relative accuracy `a` of its middle, so a quantile is too, however many sketches were added up. Adding is a sum of
counts: windows roll up to hours and across dimensions without their samples, and in any order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.operators.metrics import PERIOD_SECONDS, window_start

ACCURACY = 0.01
PERCENTILES = {"p50": 0.5, "p99": 0.99}
ORIGIN = 2**40  # added to the index of a bucket, so that the order of buckets is that of values, zero in the middle


def _gamma(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("the accuracy of a sketch lies between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def bucket_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """Bucket of a finite value; buckets order as their values do."""
    index = F.ceil(F.log(F.abs(value)) / F.lit(math.log(_gamma(accuracy)))).cast("long") + F.lit(ORIGIN)
    return F.when(value > 0, index).when(value < 0, -index).otherwise(F.lit(0).cast("long"))


def bucket_value(bucket: Column, accuracy: float = ACCURACY) -> Column:
    """The value that no value of the bucket is further from than by the accuracy."""
    gamma = _gamma(accuracy)
    # In two factors: the top of the range of doubles must not overflow on the way.
    half = F.pow(F.lit(gamma), (F.abs(bucket) - F.lit(ORIGIN)) / F.lit(2.0))
    return F.signum(bucket.cast("double")) * half * (half * F.lit(2 / (gamma + 1)))


def _totals() -> list[Column]:
    return [
        F.sum("samples").alias("samples"), F.sum("sum_value").alias("sum_value"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
    ]


def _measures(value: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("samples"), F.sum(value).alias("sum_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
    ]


def _finite(samples: DataFrame, value: str) -> DataFrame:
    number = F.col(value).cast("double")
    return samples.withColumn(value, number).filter(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(math.inf)))


def sketch_windows(
    samples: DataFrame, *, ts: Column, keys: Sequence[str] = ("name", "dim"), value: str = "value", accuracy: float = ACCURACY
) -> DataFrame:
    """Sketches per period and key, one row per bucket: (window_start, *keys, bucket, samples, sum, min, max).

    One shuffle of counts that combine on the map side, so a hot key sends a row per bucket and task. Null, not-a-number
    and infinite values are left out; rows without a time fall into the period null.
    """
    rows = _finite(samples, value).select(window_start(ts).alias("window_start"), *keys, value)
    return rows.withColumn("bucket", bucket_of(F.col(value), accuracy)).groupBy("window_start", *keys, "bucket").agg(*_measures(value))


def stream_sketch_windows(
    samples: DataFrame, *, ts: Column, lateness: str, keys: Sequence[str] = ("name", "dim"), value: str = "value",
    accuracy: float = ACCURACY,
) -> DataFrame:
    """`sketch_windows` of a stream: closed windows. The state holds a row per window, key and bucket, no samples."""
    rows = _finite(samples, value).withColumn("_at", ts.cast("timestamp")).withWatermark("_at", lateness)
    window = F.window("_at", f"{PERIOD_SECONDS} seconds").alias("w")
    counted = rows.groupBy(window, *keys, bucket_of(F.col(value), accuracy).alias("bucket")).agg(*_measures(value))
    kept = [c for c in counted.columns if c != "w"]
    return counted.select(F.unix_timestamp("w.start").alias("window_start"), *kept)


def merge_sketches(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Sketches added up over all that `by` does not name."""
    return sketches.groupBy(*by, "bucket").agg(*_totals())


def sketch_quantiles(
    sketches: DataFrame, by: Sequence[str], percentiles: Mapping[str, float] = PERCENTILES, accuracy: float = ACCURACY
) -> DataFrame:
    """Samples, sum, average and percentiles per group of `by`, from sketches of one accuracy.

    A percentile p is the value of rank floor(p * (n - 1)), within the relative accuracy, and never outside the
    smallest and the largest value. Groups are ranked over their buckets: some thousands at most, however many values.
    """
    merged = merge_sketches(sketches, by)
    line = Window.partitionBy(*by)
    upto = line.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumns({"_upto": F.sum("samples").over(upto), "_n": F.sum("samples").over(line)})
    found = [
        F.min_by(bucket_value(F.col("bucket"), accuracy), F.when(F.col("_upto") > F.floor((F.col("_n") - 1) * F.lit(p)), F.col("bucket"))).alias(name)
        for name, p in percentiles.items()
    ]
    summed = ranked.groupBy(*by).agg(*_totals(), *found)
    clamped = {name: F.least(F.greatest(F.col(name), F.col("min_value")), F.col("max_value")) for name in percentiles}
    return summed.withColumns(clamped).withColumn("avg_value", F.col("sum_value") / F.col("samples"))


def hourly(sketches: DataFrame, keys: Sequence[str], percentiles: Mapping[str, float] = PERCENTILES, accuracy: float = ACCURACY) -> DataFrame:
    """Quantiles per hour and key, from the sketches of shorter windows; keys left out are rolled up."""
    start = F.col("window_start")
    return sketch_quantiles(
        sketches.withColumn("hour_start", start - F.pmod(start, F.lit(3600))), ["hour_start", *keys], percentiles, accuracy
    )

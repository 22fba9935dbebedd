"""Five-minute metric roll-ups, API status counts, alarms and budget thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.operators.quantiles import HOT_ROWS, grouped_percentiles

# Resolution, alarm threshold, budget notifications (percent of the limit).
PERIOD_SECONDS = 300
ALARM_THRESHOLD = 1.0
BUDGET_NOTICES = (("ACTUAL", 80), ("ACTUAL", 100), ("FORECASTED", 100))


def window_start(ts: Column) -> Column:
    """Start of the period that holds `ts`, in epoch seconds."""
    seconds = F.unix_timestamp(ts)
    return seconds - F.pmod(seconds, F.lit(PERIOD_SECONDS))


def metric_rollup(
    samples: DataFrame,
    *,
    ts: Column,
    keys: Sequence[str] = ("name", "dim"),
    value: str = "value",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Sum, average, p50 and p99 per period and key; percentiles are exact."""
    rows = samples.select(window_start(ts).alias("window_start"), *keys, value)
    return grouped_percentiles(
        rows,
        ["window_start", *keys],
        value,
        {"p50": 0.5, "p99": 0.99},
        [F.sum(value).alias("sum_value"), F.avg(value).alias("avg_value"), F.count(value).alias("samples")],
        hot_rows=hot_rows,
    )


def api_status_rollup(log: DataFrame, *, ts: Column, status: str = "status") -> DataFrame:
    """Requests, client errors and server errors per period."""
    family = F.floor(F.col(status) / 100)
    return log.groupBy(window_start(ts).alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(family == 4).alias("errors_4xx"),
        F.count_if(family == 5).alias("errors_5xx"),
    )


def window_sums(samples: DataFrame, *, ts: Column, keys: Sequence[str], value: Column) -> DataFrame:
    return samples.groupBy(window_start(ts).alias("window_start"), *keys).agg(F.sum(value).alias("total"))


def alarm_states(
    sums: DataFrame,
    *,
    horizon: int | Column,
    keys: Sequence[str] = ("name",),
    threshold: float = ALARM_THRESHOLD,
    announce_ok: bool = True,
) -> DataFrame:
    """State changes (keys, at, state) of an alarm on per-period sums.

    A period breaches when its total reaches `threshold`; a period without data
    does not. State starts as OK. Only breaching periods are looked at: one
    opens an alarm unless the period before it breached too, and one closes it
    when the next period, complete at `horizon` (epoch seconds), does not.
    """
    hot = sums.filter(F.col("total") >= threshold)
    line = Window.partitionBy(*keys).orderBy("window_start")
    start = F.col("window_start")
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    follows = F.coalesce(F.lag(start).over(line) == start - PERIOD_SECONDS, F.lit(False))
    continues = F.coalesce(F.lead(start).over(line) == start + PERIOD_SECONDS, F.lit(False))
    closes = ~continues & (start + 2 * PERIOD_SECONDS <= horizon)
    flagged = hot.select(*keys, "window_start", follows.alias("_follows"), closes.alias("_closes"))
    changes = [F.when(~F.col("_follows"), F.struct(start.alias("at"), F.lit("ALARM").alias("state")))]
    if announce_ok:
        changes.append(
            F.when(F.col("_closes"), F.struct((start + PERIOD_SECONDS).alias("at"), F.lit("OK").alias("state")))
        )
    return flagged.select(*keys, F.explode(F.array_compact(F.array(*changes))).alias("c")).select(*keys, "c.*")


def budget_eval(costs: DataFrame, *, ts: Column, cost: Column, limit: float, as_of: Column) -> DataFrame:
    """Monthly cost against a limit: one row per month and notification, with `exceeded`.

    The forecast scales the cost so far to the whole month; a finished month
    forecasts its own total.
    """
    month = F.trunc(ts, "MM")
    notices = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(percent).alias("percent")) for kind, percent in BUDGET_NOTICES
    ])
    monthly = costs.groupBy(month.alias("month")).agg(F.sum(cost).alias("actual"))
    month = F.col("month")
    forecast = F.col("actual") * F.dayofmonth(F.last_day(month)) / F.least(
        F.greatest(F.datediff(as_of, month), F.lit(1)), F.dayofmonth(F.last_day(month))
    )
    spent = F.when(F.col("kind") == "ACTUAL", F.col("actual")).otherwise(F.col("forecast"))
    return (
        monthly.withColumn("forecast", forecast)
        .withColumn("notice", F.explode(notices))
        .select(F.date_format("month", "yyyy-MM").alias("month"), "actual", "forecast", "notice.*")
        .withColumn("exceeded", spent > F.lit(limit) * F.col("percent") / 100)
    )

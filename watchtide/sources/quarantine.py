"""Bad records: kept with a reason, retried, then held for a while."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attempts before a record stays put, and how long it is kept.
MAX_ATTEMPTS = 3
KEEP_DAYS = 14


def parse_records(lines: DataFrame, schema: T.StructType, *, text: str = "value") -> DataFrame:
    """JSON lines as rows of `schema`, plus the line itself when it cannot be read."""
    corrupt = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(F.col(text), corrupt, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("_r", parsed).select("*", "_r.*").drop("_r")


def bad_reason(required: Sequence[str]) -> Column:
    reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed")
    for name in required:
        reason = reason.when(F.col(name).isNull(), f"missing {name}")
    return reason


def split_bad(records: DataFrame, *, required: Sequence[str] = ("finding_id", "source")) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a `reason`). One bad record never takes its batch down."""
    reason = bad_reason(required)
    good = records.filter(reason.isNull()).drop("_corrupt_record")
    return good, records.filter(reason.isNotNull()).withColumn("reason", reason)


def quarantine_rows(bad: DataFrame, *, at: Column, text: str, attempts: Column | None = None) -> DataFrame:
    """Rows of the quarantine table: record text, reason, attempts and expiry (epoch second)."""
    return bad.select(
        F.col(text).alias("record"),
        "reason",
        (F.lit(1) if attempts is None else attempts).cast("int").alias("attempts"),
        (F.unix_timestamp(at) + KEEP_DAYS * 86400).alias("expires_at"),
    )


def retry_quarantine(
    quarantine: DataFrame, schema: T.StructType, *, at: Column, required: Sequence[str] = ("finding_id", "source")
) -> tuple[DataFrame, DataFrame]:
    """(recovered rows, rows still bad with one more attempt). Rows out of attempts are returned as they are."""
    due = quarantine.filter(F.col("attempts") < MAX_ATTEMPTS)
    good, bad = split_bad(
        parse_records(due.select("record", "attempts"), schema, text="record"), required=required
    )
    again = quarantine_rows(bad, at=at, text="record", attempts=F.col("attempts") + 1)
    spent = quarantine.filter(F.col("attempts") >= MAX_ATTEMPTS)
    return good.drop("record", "attempts"), again.unionByName(spent)

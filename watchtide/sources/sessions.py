"""The conversation log, stored so that a session is read from one bucket and few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.sources.tables import read_table

BUCKETS = 64
TURNS = "session_id string, timestamp string, user_id string, question string, answer string, expires_at long"


def _bucket(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def store_turns(turns: DataFrame, path: str, *, load: str) -> None:
    """Writes one load of stored turns (`operators.requests.store_turn`); repeating the load replaces it alone.

    Rows move once, to the files of their bucket; a bucket that a long session fills is split over tasks. Files are
    sorted by session and time and hold a Bloom filter of their sessions.
    """
    rows = turns.withColumn("bucket", _bucket(F.col("session_id")))
    (
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "session_id", "timestamp")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#session_id", "true")
        .partitionBy("bucket")
        .parquet(f"{path}/load={load}")
    )


def stored_turns(spark: SparkSession, path: str, session_id: str | None = None, *, as_of: Column | None = None) -> DataFrame:
    """Turns of one session, or of all, that have not expired at `as_of` (if given), in no order.

    A session names its bucket to the scan, so other folders are not opened; inside, row groups are skipped by
    bounds and Bloom filters. A table not written yet is empty; turns without a session are read with the rest only.
    """
    rows = read_table(spark, path, TURNS + ", load string, bucket int")
    if session_id is not None:
        rows = rows.filter((F.col("bucket") == _bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
    if as_of is not None:
        rows = rows.filter(F.col("expires_at") > F.unix_timestamp(as_of))
    return rows.drop("load", "bucket")

"""Top-k per key in two steps, so that a hot key is cut down in many tasks first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_k_per(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, *, salt: Column, ties: bool = False
) -> DataFrame:
    """The first k rows of each key under `order`, with their `rank`; `order` must be total, or `ties` keeps all rows
    that are equal to the k-th."""
    place = F.rank if ties else F.row_number
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn("rank", place().over(local)).filter(F.col("rank") <= k).drop("rank", "_salt")
    return kept.withColumn("rank", place().over(final)).filter(F.col("rank") <= k)

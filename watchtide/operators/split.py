"""Seeded, exact train / validation split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.operators.quantiles import order_statistic

# Seed and share of the validation set.
SEED, VALIDATION_FRACTION = 42, 0.2


def shuffle_key(key: Column, seed: int) -> Column:
    """Uniform hex text; sorting by it is a seeded shuffle that does not depend on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _hex(share: float) -> str:
    return f"{min(int(max(share, 0.0) * 2**64), 2**64 - 1):016x}"


def train_val_split(
    rows: DataFrame, *, key: str, seed: int = SEED, validation_fraction: float = VALIDATION_FRACTION
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) with exactly int(n * (1 - fraction)) train rows; `key` is unique.

    The split point is one order statistic of a uniform hash, so only a sliver
    of hashes around the expected place is sorted and the rows themselves are
    only filtered.
    """
    hashed = rows.withColumn("_shuffle", shuffle_key(F.col(key), seed))
    n = hashed.count()
    train_rows = int(n * (1.0 - validation_fraction))
    if train_rows == 0:
        return rows.limit(0), rows
    share = train_rows / n
    slack = 8.0 * math.sqrt(share * (1.0 - share) / n) + 2.0 / n
    last = order_statistic(hashed, "_shuffle", train_rows - 1, _hex(share - slack), _hex(share + slack))
    in_train = F.col("_shuffle") <= last
    return hashed.filter(in_train).drop("_shuffle"), hashed.filter(~in_train).drop("_shuffle")


def with_split(rows: DataFrame, *, key: str, seed: int = SEED) -> DataFrame:
    """`rows` with a `split` column holding train or validation."""
    train, validation = train_val_split(rows, key=key, seed=seed)
    return train.withColumn("split", F.lit("train")).unionByName(
        validation.withColumn("split", F.lit("validation"))
    )

"""Joins against a side that is usually small, broadcast only after its size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Rough size of the rows of `df`, from their JSON text."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Left or inner join that never shuffles `big` while `small` stays under `limit` bytes.

    `small` is written once, measured, and broadcast when it fits. Beyond the
    limit the join is left to the planner, where adaptive execution splits hot
    keys of `big`.
    """
    small = materialize(small)
    if measured_bytes(small) <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)

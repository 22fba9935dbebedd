"""Resource configuration lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The accepted form of a resource id and the number of items returned for one.
SAFE_ID = r"^[A-Za-z0-9\-_/:.]{1,256}$"
MAX_ITEMS = 3
ITEM_COLUMNS = ("resource_id", "resource_type", "aws_region", "configuration", "capture_time")


def latest_config(items: DataFrame, *, per_resource: int = MAX_ITEMS, tie: Sequence[str] = ("configuration",)) -> DataFrame:
    """The newest configuration items of each resource, with their position.

    The rank filter also runs before the shuffle, so each task sends at most
    `per_resource` rows of a resource.
    """
    newest = Window.partitionBy("resource_id").orderBy(F.desc("capture_time"), *[F.desc(c) for c in tie])
    return items.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= per_resource)


def id_candidates(resource_id: Column) -> tuple[Column, Column, Column]:
    """(cleaned id, tail after the last ':' or '/', error) of a requested id."""
    cleaned = F.trim(resource_id)
    tail = F.element_at(F.split(cleaned, "[:/]"), -1)
    usable_tail = F.when((tail != "") & (tail != cleaned), tail)
    error = F.when(F.coalesce(cleaned, F.lit("")) == "", "No resource_id provided.").when(
        ~cleaned.rlike(SAFE_ID), "Invalid resource_id format."
    )
    return cleaned, usable_tail, error


def resource_config_lookup(
    requests: DataFrame, items: DataFrame, *, request_key: str = "request_id", tie: Sequence[str] = ("configuration",)
) -> DataFrame:
    """Configuration items for requested ids: the id itself first, else its tail.

    One row per found item with its position, or one row with a null position
    and an `error`, or neither when nothing was found. Items collapse to at most
    three per resource before the joins, so each request meets one row per side.
    """
    cleaned, tail, error = id_candidates(F.col("resource_id"))
    # Rows without a usable key get one of their own that matches nothing ('#' is no id
    # character), so they spread out instead of meeting in one task.
    own = F.concat(F.lit("#"), F.col(request_key).cast("string"))
    asked = requests.select(
        request_key,
        F.col("resource_id").alias("requested"),
        error.alias("error"),
        F.when(error.isNull(), cleaned).otherwise(own).alias("_id"),
        F.coalesce(F.when(error.isNull(), tail), own).alias("_tail"),
    )
    found = (
        latest_config(items, tie=tie)
        .groupBy("resource_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", *ITEM_COLUMNS))).alias("_items"))
    )
    by_id = found.select(F.col("resource_id").alias("_id"), F.col("_items").alias("_direct"))
    by_tail = found.select(F.col("resource_id").alias("_tail"), F.col("_items").alias("_by_tail"))
    matched = asked.join(by_id, "_id", "left").join(by_tail, "_tail", "left")
    return matched.select(
        request_key, "requested", "error", F.explode_outer(F.coalesce("_direct", "_by_tail")).alias("_item")
    ).select(request_key, "requested", "error", "_item.*")

"""Category counts, rarity lookup and the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions import features as feat
from watchtide.operators.small_side import BROADCAST_BYTES
from watchtide.schemas import FEATURE_COLUMNS
from watchtide.session import materialize

# Rarity feature to the category column behind it.
RARITY_SOURCES = {
    "event_source_rarity": "eventsource",
    "event_name_rarity": "eventname",
    "region_rarity": "awsregion",
}
ROW_BYTES = 64  # fixed part of one category row
RARITY_MODES = ("batch", "single", "baseline")


def category_counts(events: DataFrame, columns: Sequence[str] = tuple(RARITY_SOURCES.values())) -> DataFrame:
    """(category, value, n, top_n) per category column, nulls left out.

    One scan for all columns: rows unpivot before the count, and the count is
    combined on the map side, so a hot value moves one row per task.
    """
    counts = (
        events.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in columns
        ])).alias("c"))
        .select("c.*")
        .filter(F.col("value").isNotNull())
        .groupBy("category", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    tops = counts.groupBy("category").agg(F.max("n").alias("top_n"))  # one row per listed column
    return counts.join(F.broadcast(tops), "category")


def rarity_lookup(
    events: DataFrame, counts: DataFrame, columns: Sequence[str] = tuple(RARITY_SOURCES)
) -> DataFrame:
    """Adds the rarity columns from a table of category counts; null or unseen gives 1.

    `counts` is a written table (see `materialize`). It is measured per category;
    categories that fit are broadcast, so the events do not move.
    """
    sizes = dict(
        counts.groupBy("category").agg(F.sum(F.octet_length("value") + F.lit(ROW_BYTES))).collect()
    )
    for name in columns:
        column = RARITY_SOURCES[name]
        side = counts.filter(F.col("category") == column).select(
            F.col("value").alias(column), F.col("n").alias("_n"), F.col("top_n").alias("_top")
        )
        if sizes.get(column, 0) <= BROADCAST_BYTES:
            side = F.broadcast(side)
        events = (
            events.join(side, column, "left")
            .withColumn(name, feat.rarity(F.col("_n"), F.col("_top")))
            .drop("_n", "_top")
        )
    return events


def _single_event_rarity(events: DataFrame) -> DataFrame:
    """Rarity of a batch that holds one event: 0 for a known category, 1 for null."""
    return events.withColumns(
        {name: F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for name, c in RARITY_SOURCES.items()}
    )


def with_parts(events: DataFrame, ts: Column) -> DataFrame:
    """Adds `_ts`, `_identity` and `_octets`, each parsed once for the features that read it."""
    return events.withColumns(
        {
            "_ts": ts,
            "_identity": feat.identity_type(F.col("useridentity")),
            "_octets": feat.octets(F.col("sourceipaddress")),
        }
    )


def plain_features() -> dict[str, Column]:
    """The nine features that need one row only, over the columns of `with_parts`."""
    ts, identity = F.col("_ts"), F.col("_identity")
    return {
        "hour_of_day": feat.hour_of_day(ts),
        "day_of_week": feat.day_of_week(ts),
        "is_weekend": feat.is_weekend(ts),
        "is_business_hours": feat.is_business_hours(ts),
        "is_root_user": feat.is_root_user(identity),
        "is_assumed_role": feat.is_assumed_role(identity),
        "is_error_response": feat.is_error_response(F.col("errorcode")),
        "is_console_action": feat.is_console_action(F.col("eventname")),
        "ip_octet_variance": feat.ip_octet_variance(F.col("_octets")),
    }


def extract_features(
    events: DataFrame,
    *,
    keep: Sequence[str] = (),
    rarity: str = "batch",
    counts: DataFrame | None = None,
    ts: Column | None = None,
) -> DataFrame:
    """The twelve features in contract order, after the `keep` columns.

    rarity="batch" counts categories within `events` (fitting), "single" treats
    each event as its own batch (no shuffle), "baseline" reads `counts` saved
    with a model. A stream needs one of the last two.
    """
    if rarity not in RARITY_MODES:
        raise ValueError(f"unknown rarity mode {rarity!r}; known: {RARITY_MODES}")
    if rarity == "baseline" and counts is None:
        raise ValueError("rarity='baseline' needs the counts saved with the model")
    needed = list(dict.fromkeys([*keep, *RARITY_SOURCES.values()]))
    at = F.try_to_timestamp(F.col("eventtime")) if ts is None else ts
    base = with_parts(events, at).select(*needed, *[c.alias(n) for n, c in plain_features().items()])
    if rarity == "single":
        base = _single_event_rarity(base)
    else:
        base = rarity_lookup(base, materialize(category_counts(events)) if rarity == "batch" else counts)
    return base.select(*keep, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURE_COLUMNS])

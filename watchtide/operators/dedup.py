"""De-duplication: alert claims with a time to live, and last write wins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEDUP_HOURS = 24


def _claims_of_sorted(window: int):
    """Scans rows sorted by (finding_id, claimed_at) and keeps each id's claims.

    Between batches only one id and its last claim are remembered, so memory
    does not grow with the rows of an id. Inside a batch all ids advance
    together, one claim per step.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_id, open_claim = None, None
        for rows in batches:
            if rows.empty:
                continue
            ids = rows["finding_id"].to_numpy(dtype=object)
            seconds = rows["claimed_at"].to_numpy(dtype=np.int64)
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ends = np.r_[starts[1:], len(ids)]
            # One sorted axis for all ids: each id gets its own stretch, wide enough
            # for a claim plus its window to stay inside.
            low = seconds.min() if open_claim is None else min(seconds.min(), open_claim)
            width = int(max(seconds.max(), low) - low + window + 1)
            group = np.repeat(np.arange(len(starts)), ends - starts)
            axis = group * width + (seconds - low)
            position = starts.copy()
            if open_id is not None and ids[0] == open_id:
                position[0] = np.searchsorted(axis, min(open_claim - low + window, width - 1))
            kept, active = [], np.flatnonzero(position < ends)
            last = {}
            while len(active):
                at = position[active]
                kept.append(at)
                if active[-1] == len(starts) - 1:
                    last["claim"] = int(seconds[at[-1]])
                target = active * width + (seconds[at] - low) + window
                position[active] = np.searchsorted(axis, target)
                active = active[position[active] < ends[active]]
            if ids[-1] != open_id:
                open_claim = None
            open_id, open_claim = ids[-1], last.get("claim", open_claim)
            if kept:
                yield rows.iloc[np.sort(np.concatenate(kept))]

    return scan


def ttl_dedup(
    events: DataFrame,
    *,
    id_column: str = "finding_id",
    ts: Column,
    hours: int = DEDUP_HOURS,
    claims: DataFrame | None = None,
) -> DataFrame:
    """Claims (finding_id, claimed_at, expires_at) in epoch seconds.

    The first event of an id claims it; later ones are suppressed until the
    claim is `hours` old, and never extend it. Claims are made by the second, so
    equal (id, second) rows collapse first, with a map-side combine: a hot id
    brings at most one row per second, however many events it has. The scan is
    by id over spilled, sorted partitions.

    `claims` holds claims made earlier (finding_id, claimed_at); events they
    still cover are suppressed.
    """
    window = hours * 3600
    seconds = (
        events.select(F.col(id_column).alias("finding_id"), F.unix_timestamp(ts).alias("claimed_at"))
        .filter(F.col("finding_id").isNotNull() & F.col("claimed_at").isNotNull())
        .distinct()
    )
    if claims is not None:
        latest = claims.groupBy("finding_id").agg(F.max("claimed_at").alias("_held"))
        seconds = (
            seconds.join(latest, "finding_id", "left")
            .filter(F.col("_held").isNull() | (F.col("claimed_at") >= F.col("_held") + window))
            .drop("_held")
        )
    scanned = (
        seconds.repartition("finding_id")
        .sortWithinPartitions("finding_id", "claimed_at")
        .mapInPandas(_claims_of_sorted(window), "finding_id string, claimed_at long")
    )
    return scanned.withColumn("expires_at", F.col("claimed_at") + window)


def claim_check(
    events: DataFrame, claims: DataFrame, *, ts: Column, id_column: str = "finding_id", hours: int = DEDUP_HOURS
) -> DataFrame:
    """Events whose id holds no claim that is live at the event's time.

    Time is cut into slots of `hours`; a claim stands in each slot it touches (one or two, if it lasts that long),
    and an event looks only into its own slot of its id, so a long history of claims costs an event nothing.
    """
    slot = hours * 3600
    touched = F.sequence(F.floor(F.col("claimed_at") / slot), F.floor((F.col("expires_at") - 1) / slot))
    held = claims.filter("expires_at > claimed_at").select(
        F.col("finding_id").alias("_id"), "claimed_at", "expires_at", F.explode(touched).alias("_slot")
    )
    second = F.unix_timestamp(ts)
    same = (F.col(id_column) == F.col("_id")) & (F.floor(second / slot) == F.col("_slot"))
    live = (second >= F.col("claimed_at")) & (second < F.col("expires_at"))
    return events.join(held, same & live, "left_anti")


def last_write_wins(
    findings: DataFrame,
    *,
    keys: Sequence[str] = ("source", "year", "month", "day", "safe_id"),
    order: Sequence[str] = ("enriched_at", "raw_detail"),
) -> DataFrame:
    """Newest row per object key, as an overwriting store would keep it.

    Each task keeps one row per key before the shuffle, so a key with a large
    share of all rows stays cheap. The sort compares the last key first: ids tell
    rows apart at once, where sources and days would not. Keys partition the
    window, so filters on them reach the scan.
    """
    newest = Window.partitionBy(*reversed(keys)).orderBy(*[F.desc(c) for c in order])
    return findings.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") == 1).drop("_age")

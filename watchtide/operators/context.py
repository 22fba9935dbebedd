"""What stands behind a finding: the audit events of its resource around its time, and the findings an answer cites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.operators.small_side import join_checked
from watchtide.session import materialize

BEFORE, AFTER = 3600, 300  # seconds around a finding
CELL_ROWS = 100_000  # events of a resource and time bin that one task compares
CITED = r"\bf-[0-9]+\b"


def events_near(
    findings: DataFrame, events: DataFrame, *, finding_ts: Column, event_ts: Column, resource: str = "resource_arn",
    keep: Sequence[str] = ("finding_id",), event_keep: Sequence[str] = ("event_id",), before: int = BEFORE,
    after: int = AFTER, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(*keep, *event_keep, seconds): each finding with each event of its resource from `before` seconds before to
    `after` seconds after it, whole seconds, both ends included; `seconds` is event minus finding.

    Time is cut into bins as long as the window. An event lies in one bin, a finding looks into the two or so that its
    window touches, and they join by resource and bin, so a resource's history costs a finding nothing. Bins of a
    resource with more than `cell_rows` events are cut into parts by a hash of the event; findings go to each part.
    Every pair meets once. Rows without a resource or a time have no pairs; repeated rows are rows of their own.
    """
    if before < 0 or after < 0 or cell_rows < 1:
        raise ValueError("the window and its cells have a size")
    width = before + after + 1
    seen = events.select(
        F.col(resource).alias("_resource"), F.unix_timestamp(event_ts).alias("_event_at"), F.struct(*event_keep).alias("_event"),
    ).filter("_resource IS NOT NULL AND _event_at IS NOT NULL").withColumn("_bin", F.floor(F.col("_event_at") / F.lit(width)))
    at = F.unix_timestamp(finding_ts)
    bins = F.sequence(F.floor((at - before) / width), F.floor((at + after) / width))
    asked = findings.select(
        F.col(resource).alias("_resource"), at.alias("_at"), F.struct(*keep).alias("_finding"), F.explode(bins).alias("_bin"),
    ).filter("_resource IS NOT NULL")

    cell = ["_resource", "_bin"]
    full = seen.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell_rows)
    full = materialize(full.select(*cell, F.ceil(F.col("_n") / F.lit(cell_rows)).cast("int").alias("_parts")))
    if full.isEmpty():
        seen, asked = seen.withColumn("_part", F.lit(0)), asked.withColumn("_part", F.lit(0))
    else:
        parts = F.coalesce("_parts", F.lit(1))
        seen = join_checked(seen, full, cell, "left").withColumn("_part", F.pmod(F.xxhash64("_event"), parts).cast("int"))
        asked = join_checked(asked, full, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    apart = F.col("_event_at") - F.col("_at")
    pairs = asked.drop("_parts").join(seen.drop("_parts"), [*cell, "_part"]).filter(apart.between(-before, after))
    return pairs.select("_finding.*", "_event.*", apart.alias("seconds"))


def event_context(near: DataFrame, by: Sequence[str] = ("finding_id",), *, failed: Column | None = None) -> DataFrame:
    """Per finding that has events near: their number, the first and the last distance in time, and failed calls.

    Counts combine on the map side, right behind the join; no finding's events meet in one place.
    """
    failures = F.count_if(failed) if failed is not None else F.lit(None).cast("long")
    return near.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.min("seconds").alias("first_seconds"), F.max("seconds").alias("last_seconds"),
        failures.alias("failures"),
    )


def cited_findings(
    answers: DataFrame, findings: DataFrame, *, key: Sequence[str], text: str = "answer", pattern: str = CITED,
    finding_id: str = "finding_id",
) -> DataFrame:
    """(*key, cited_id, known): the finding ids that each answer names, once each, and whether such a finding exists.

    Ids are told from the text by `pattern`. Distinct cited ids are looked up, not answers: an id cited by a third of
    all answers crosses the join once. Answers that cite nothing, and null ones, give no row.
    """
    named = answers.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("cited_id"))
    ids = materialize(named.select("cited_id").distinct())
    found = join_checked(findings.select(F.col(finding_id).alias("cited_id")), ids, ["cited_id"], "left_semi").distinct()
    known = materialize(ids.join(found.withColumn("known", F.lit(True)), "cited_id", "left"))
    joined = join_checked(named, known, ["cited_id"], "left")
    return joined.select(*key, "cited_id", F.coalesce("known", F.lit(False)).alias("known"))

"""Structured Streaming jobs on the same operators as the batch jobs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from watchtide.operators.alerts import format_alert, triage_parse
from watchtide.operators.dedup import DEDUP_HOURS
from watchtide.operators.iforest import IsolationForest
from watchtide.operators.metrics import ALARM_THRESHOLD, PERIOD_SECONDS
from watchtide.operators.normalize import normalize_findings
from watchtide.operators.routing import route_high_severity
from watchtide.operators.scoring import score_with_features
from watchtide.operators.sketches import stream_sketch_windows
from watchtide.schemas import FEATURE_COLUMNS
from watchtide.sources.tables import append_load, read_table, score_capture
from watchtide.sources.feed import announced_rows
from watchtide.sources.lake import DAY_COLUMNS, write_findings
from watchtide.sources.quarantine import quarantine_rows, split_bad

# Fixed value: the oldest an event may be when it is handled, in seconds.
MAX_EVENT_AGE = 3600
LATENESS = f"{MAX_EVENT_AGE} seconds"
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AVAILABLE_NOW = {"availableNow": True}


def _load(job: str, batch_id: int) -> str:
    """Every stream counts its batches from 0; the job's name keeps the loads of two streams in one lake apart."""
    if not re.fullmatch(r"[A-Za-z0-9_.]+", job):
        raise ValueError("a job name is made of letters, digits, dots and underscores")
    return f"{job}-{batch_id}"


def stream_normalize(
    events: DataFrame, path: str, checkpoint: str, *, job: str, enriched_at: Column | None = None,
    announce: Sequence[str] = (), trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Event envelopes into the enriched lake; a replayed micro-batch replaces its own load.

    `job` names this stream among all that write to the lake; one checkpoint, one name. Without `enriched_at` the
    stamp is the batch's time in the offset log, so a batch replayed a day later lands in its first folder.
    Consumers in `announce` are told of each load.
    """
    stamp = F.current_timestamp() if enriched_at is None else enriched_at
    events = events.withColumn("_stamp", stamp)
    _load(job, 0)

    def write(batch: DataFrame, batch_id: int) -> None:
        findings = normalize_findings(batch, enriched_at=F.col("_stamp"), keep=["_stamp"])
        write_findings(findings, path, ts=F.col("_stamp"), load=_load(job, batch_id), announce=announce)

    return (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def stream_score(
    findings: DataFrame, path: str, checkpoint: str, *, job: str, model: IsolationForest, rarity: str = "single",
    counts: DataFrame | None = None, model_version: str = "1", scored_at: Column | None = None,
    lake_path: str | None = None, trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """New findings to the scored lake, with a capture of inputs and outputs and a quarantine of bad rows.

    With `lake_path` the stream is one of announcements (`stream_announcements`), and a batch reads the folders of
    that lake which they name.
    """
    if rarity == "batch":
        raise ValueError("rarity within a micro-batch depends on its size; use 'single' or 'baseline'")
    stamp = F.col("_stamp")
    scored_at = F.current_timestamp() if scored_at is None else scored_at
    if lake_path is None:
        findings = findings.withColumn("_stamp", scored_at)
    _load(job, 0)

    def write(batch: DataFrame, batch_id: int) -> None:
        load = _load(job, batch_id)
        if lake_path is not None:
            batch = announced_rows(batch, lake_path).withColumn("_stamp", scored_at)
        good, bad = split_bad(batch, required=("finding_id", "source"))
        scored = score_with_features(
            good.drop(*DAY_COLUMNS, "load"), model, rarity=rarity, counts=counts, scored_at=stamp,
            model_endpoint=model_version,
        ).persist()
        try:
            write_findings(scored.drop(*FEATURE_COLUMNS), f"{path}/scored", ts=stamp, load=load, prefix="scored")
            append_load(score_capture(scored, model_version=model_version), f"{path}/capture", load)
        finally:
            scored.unpersist()
        plain = F.to_json(F.struct(*(c for c in bad.columns if c != "_stamp")))
        record = bad.withColumn("_record", F.coalesce("_corrupt_record", plain))
        append_load(quarantine_rows(record, at=stamp, text="_record"), f"{path}/quarantine", load)

    return (
        findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def high_severity_alerts(events: DataFrame, *, ts: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Alert records of the events that match an alerting rule. The filter comes first."""
    timed = route_high_severity(events).withColumn("ts", ts.cast("timestamp"))
    return triage_parse(timed, keep=["ts", *keep])


class ClaimProcessor(StatefulProcessor):
    """Per id: its last claim, until a timer at the end of that claim's window clears it.

    Without holding, alerts claim as they arrive, those of a batch in event-time order, and one older than the last
    claim is a repeat. With holding, alerts wait until the watermark has passed their second, so that they claim in
    event-time order whatever order they came in. An id has one timer, at its next waiting second or the end of its
    claim; it is kept with the claim, so that an id costs one read and one write of its state.
    """

    def __init__(self, window: int, hold: bool) -> None:
        self.window, self.hold = window, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", "claimed_at long, timer long")
        if self.hold:
            self.waiting = handle.getMapState("waiting", "second long", "place string, alert string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  (the API's names)
        firsts: dict[int, tuple[str, str]] = {}
        for row in rows:
            if row.second not in firsts or row.place < firsts[row.second][0]:
                firsts[row.second] = (row.place, row.alert)
        last, timer = self.state.get() or (None, None)
        if self.hold:
            for second, first in firsts.items():
                held = self.waiting.getValue((second,)) if self.waiting.containsKey((second,)) else None
                if held is None or first[0] < held[0]:
                    self.waiting.updateValue((second,), first)
            soonest = min(firsts)
            self._keep(last, timer, soonest if timer is None else min(timer, soonest))
        else:
            claims = self._claims(last, firsts)
            if claims:
                self._keep(claims[-1], timer, claims[-1] + self.window)
            yield from self._rows(key, claims, firsts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        last, _timer = self.state.get()
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        soonest = None
        if self.hold:
            due = {second: tuple(first) for (second,), first in self.waiting.iterator() if second < passed}
            for second in due:
                self.waiting.removeKey((second,))
            claims = self._claims(last, due)
            last = claims[-1] if claims else last
            soonest = min((second for (second,) in self.waiting.keys()), default=None)
            yield from self._rows(key, claims, due)
        if last is not None and last + self.window < passed:
            last = None
        if soonest is None and last is not None:
            soonest = last + self.window
        if soonest is None:
            self.state.clear()
        else:
            self._keep(last, None, soonest)

    def _claims(self, last: int | None, firsts: dict[int, tuple[str, str]]) -> list[int]:
        claims = []
        for second in sorted(firsts):
            if last is None or second >= last + self.window:
                claims.append(second)
                last = second
        return claims

    def _rows(self, key: tuple, claims: list[int], firsts: dict[int, tuple[str, str]]) -> Iterator[Row]:
        return (Row(id=key[0], claimed_at=second, alert=firsts[second][1]) for second in claims)

    def _keep(self, last: int | None, timer: int | None, wanted: int) -> None:
        """The state, and the id's one timer at the end of the wanted second."""
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer((timer + 1) * 1000)
            self.handle.registerTimer((wanted + 1) * 1000)
        self.state.update((last, wanted))

    def close(self) -> None:
        pass


def claim_alerts(alerts: DataFrame, *, hours: int = DEDUP_HOURS, hold: int | None = None) -> DataFrame:
    """The alerts of a stream (id, ts, …) that claim their id, with `claimed_at`: one per id and window.

    Of several alerts of an id in the claiming second the first one stands. `hold` seconds make alerts wait for
    earlier ones that come up to so much later; without it they claim at once, and what is older than its id's last
    claim is a repeat. Alerts that come later than `hold` (else the window) behind the newest are dropped, as by any
    watermark; alerts without an id or a time are left out.
    """
    columns = alerts.schema
    told = alerts.filter("id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", f"{hours * 3600 if hold is None else hold} seconds")
    row = F.struct(*alerts.columns)
    # Places order alerts of one second: microseconds since the second, then a hash of the whole row.
    place = F.concat(F.lpad((F.unix_micros("ts") % 1_000_000).cast("string"), 6, "0"), F.hex(F.xxhash64(row)))
    rows = told.select("ts", "id", F.unix_timestamp("ts").alias("second"), place.alias("place"), F.to_json(row).alias("alert"))
    alerts.sparkSession.conf.set(STATE_STORE_CONF, ROCKSDB_STORE)  # the only store that keeps timers
    claimed = rows.groupBy("id").transformWithState(
        ClaimProcessor(hours * 3600, hold is not None), "id string, claimed_at long, alert string", "Append", "EventTime"
    )
    return claimed.select("claimed_at", F.from_json("alert", columns).alias("_a")).select("_a.*", "claimed_at")


def stream_alerts(
    events: DataFrame, path: str, checkpoint: str, *, job: str, ts: Column, hours: int = DEDUP_HOURS,
    hold: int | None = None, trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """High-severity events to formatted alerts, one per id and window (`claim_alerts`).

    Claims are keyed state: a batch reads no alert written before, and an id leaves the state when its claim ends.
    State and output commit by batch; a replayed batch replaces exactly its own alerts.
    """
    _load(job, 0)

    def write(batch: DataFrame, batch_id: int) -> None:
        day = F.date_format(F.timestamp_seconds("claimed_at"), "yyyy-MM-dd")
        append_load(format_alert(batch).withColumn("claim_day", day), path, _load(job, batch_id), by=("claim_day",))

    claimed = claim_alerts(high_severity_alerts(events, ts=ts), hours=hours, hold=hold)
    return (
        claimed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def stream_rollup(samples: DataFrame, *, ts: Column, keys: Sequence[str] = ("name", "dim")) -> DataFrame:
    """Closed five-minute windows; percentiles are sketches, so state stays small."""
    return (
        samples.withColumn("ts", ts.cast("timestamp"))
        .withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", f"{PERIOD_SECONDS} seconds").alias("w"), *keys)
        .agg(
            F.sum("value").alias("sum_value"),
            F.avg("value").alias("avg_value"),
            F.count("value").alias("samples"),
            F.percentile_approx("value", 0.5, 10_000).alias("p50"),
            F.percentile_approx("value", 0.99, 10_000).alias("p99"),
        )
    )


def stream_metrics(
    samples: DataFrame, path: str, checkpoint: str, *, ts: Column, keys: Sequence[str] = ("name", "dim"),
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    rolled = stream_rollup(samples, ts=ts, keys=keys)
    flat = rolled.select(F.unix_timestamp("w.start").alias("window_start"), *[c for c in rolled.columns if c != "w"])
    return (
        flat.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def stream_sketches(
    samples: DataFrame, path: str, checkpoint: str, *, ts: Column, keys: Sequence[str] = ("name", "dim"),
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Quantile sketches of closed windows, which later roll up to hours and across keys (`operators/sketches.py`)."""
    closed = stream_sketch_windows(samples, ts=ts, lateness=LATENESS, keys=keys)
    return (
        closed.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


class AlarmProcessor(StatefulProcessor):
    """Per metric: emits state changes; a timer at the end of the next window notices silence.

    The state is the last breaching window of an open alarm. Windows reach it
    closed and in watermark order, one row per window.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("last_breach", "start long")

    def _changes(self, key: tuple, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(*key, at, state) for at, state in found], columns=["name", "at", "state"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  (the API's names)
        last = self.open.get()[0] if self.open.exists() else None
        if last is not None:
            self.handle.deleteTimer((last + 2 * PERIOD_SECONDS) * 1000)
        windows = pd.concat(list(rows))
        found = []
        for start in sorted(windows.loc[windows["total"] >= self.threshold, "window_start"]):
            start = int(start)
            if last is not None and start > last + PERIOD_SECONDS:
                found.append((last + PERIOD_SECONDS, "OK"))
                last = None
            if last is None:
                found.append((start, "ALARM"))
            last = start
        due = None if last is None else (last + 2 * PERIOD_SECONDS) * 1000
        if due is not None and due <= timerValues.getCurrentWatermarkInMs():
            found.append((last + PERIOD_SECONDS, "OK"))
            due = None
        if due is None:
            self.open.clear()
        else:
            self.open.update((last,))
            self.handle.registerTimer(due)
        yield from self._changes(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        last = self.open.get()[0]
        self.open.clear()
        yield from self._changes(key, [(last + PERIOD_SECONDS, "OK")])

    def close(self) -> None:
        pass


def alarm_stream(samples: DataFrame, *, ts: Column, value: Column, threshold: float = ALARM_THRESHOLD) -> DataFrame:
    """State changes (name, at, state) of an alarm on five-minute sums, silent windows included."""
    sums = (
        samples.select(ts.cast("timestamp").alias("ts"), "name", value.alias("_v"))
        .withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", f"{PERIOD_SECONDS} seconds").alias("w"), "name")
        .agg(F.sum("_v").alias("total"))
        .select("name", F.window_time("w").alias("closed_at"), F.unix_timestamp("w.start").alias("window_start"), "total")
    )
    samples.sparkSession.conf.set(STATE_STORE_CONF, ROCKSDB_STORE)  # the only store that keeps timers
    return sums.groupBy("name").transformWithStateInPandas(
        AlarmProcessor(threshold), "name string, at long, state string", "Append", "EventTime"
    )


def stream_alarms(
    samples: DataFrame, path: str, checkpoint: str, *, ts: Column, value: Column,
    threshold: float = ALARM_THRESHOLD, trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    changes = alarm_stream(samples, ts=ts, value=value, threshold=threshold)
    return (
        changes.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def split_late(rows: DataFrame, *, ts: Column, newest: Column) -> tuple[DataFrame, DataFrame]:
    """(in time, too late): a row is late when it is older than the newest event seen by the age limit."""
    age = F.unix_timestamp(newest) - F.unix_timestamp(ts)
    late = F.coalesce(age > MAX_EVENT_AGE, F.lit(False))
    return rows.filter(~late), rows.filter(late)


def late_data(
    events: DataFrame, path: str, checkpoint: str, *, job: str, ts: Column, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Sorts a stream into `accepted` and `late` tables; late rows are kept, never dropped.

    A row is compared with the newest event of the batches before its own, as a watermark would. Each batch leaves
    the newest event up to and with it in a place of its own, so the next one reads one row by its path and lists
    nothing, however many came before; a replayed batch finds the same mark and writes the same rows. Streams that
    close windows drop what their watermark has passed; feed them the `accepted` table, and nothing is lost unseen.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, load = batch.sparkSession, _load(job, batch_id)
        marked = batch.withColumn("_ts", ts.cast("timestamp"))
        mark = None
        if batch_id > 0:
            before = read_table(spark, f"{path}/marks/{_load(job, batch_id - 1)}", "newest timestamp").collect()
            if not before:
                raise RuntimeError(f"batch {batch_id} of {job} finds no mark of the batch before it in {path}/marks")
            mark = before[0][0]
        newest = F.lit(mark).cast("timestamp")
        good, late = split_late(marked, ts=F.col("_ts"), newest=newest)
        append_load(good.drop("_ts"), f"{path}/accepted", load)
        append_load(late.drop("_ts").withColumn("reason", F.lit("too late")), f"{path}/late", load)
        top = marked.agg(F.greatest(F.max("_ts"), newest).alias("newest"))  # nulls do not count
        top.write.mode("overwrite").parquet(f"{path}/marks/{load}")

    return (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )

"""Structured Streaming versions of the shop-floor jobs.

Every job reads the event table as a file stream, runs with ``trigger(availableNow=True)`` and
writes each micro-batch from the executors (``foreachBatch`` -> Parquet append) into a keyed
changelog under the shared checkpoint folder. The result is the changelog reconciled to the
latest version of each key, which is the batch answer; a re-run micro-batch (after a lost
executor) only appends an identical version, so the reconciled result stays exact.

Aggregations run in update or append mode with a watermark on event time (the delay bounds the state);
the shift and downtime windows are tumbling / sliding ``window`` aggregates; the state-duration
job keeps the events of each open (machine, time slice) in ``applyInPandasWithState`` and threads late ones
in; page sessions use ``session_window``. Append mode holds a window back until the watermark passes it, so
a finished replay is closed by a heartbeat: one row far ahead in time that arrives after all others.
``streaming.late`` routes the rows behind a watermark to a side table.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from millrun.functions import scalar as P
from millrun.operators import plant
from millrun.session import ensure_checkpoint_dir
from millrun.sources import bindings as B
from millrun.sources.tables import Tables

DEFAULT_WATERMARK = "30 days"
#: New files of the event folder that one micro-batch reads, unless the caller says otherwise.
FILES_PER_TRIGGER = 64
#: The heartbeat's lead over the newest event: more than any watermark delay and window.
HEARTBEAT_LEAD = dt.timedelta(days=4000)


class StreamTables(Tables):
    """A ``Tables`` whose ``events`` is a file stream over the events table (or over ``path``), and over the heartbeat folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = FILES_PER_TRIGGER, path: str | None = None):
        super().__init__(spark, sf_dir)
        schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
        self.heartbeats = _scratch(spark, "heartbeats")
        spark.createDataFrame([], schema).write.parquet(self.heartbeats)
        # a glob lets the file source watch one file as well as a folder of new files
        folders = (path or os.path.join(sf_dir, "events*.parquet"), self.heartbeats)
        both = [file_stream(spark, schema, f, max_files_per_trigger) for f in folders]
        # watermarks need TIMESTAMP (the table stores zone-less timestamps; the session is UTC)
        self.__dict__["events"] = both[0].unionByName(both[1]).withColumn("ts", F.col("ts").cast("timestamp"))
        self.__dict__["static"] = Tables(spark, sf_dir)  # batch side for stream-static joins

    def heartbeat(self) -> None:
        """Land one row ``HEARTBEAT_LEAD`` after the newest event. It belongs to no machine or user of the tables, passes every job's
        filters (so that the watermark sees it), and its own windows never close."""
        newest = self.static.events.agg(F.max("ts")).first()[0]
        if newest is not None:
            row = (-1, newest + HEARTBEAT_LEAD, -1, "error", 50.0, '{"k": 10}')
            schema = self.static.events.select("event_id", "ts", "user_id", "event_type", "value", "props").schema
            self.spark.createDataFrame([row], schema).write.mode("append").parquet(self.heartbeats)


def file_stream(spark: SparkSession, schema: StructType, path: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def run_to_changelog(stream: DataFrame, name: str, output_mode: str = "update", then_close: StreamTables | None = None) -> DataFrame:
    """Run ``stream`` to completion (available-now) and return its changelog with ``_batch``.

    A micro-batch overwrites its own folder, so one that is run again after a failure leaves no second copy.
    With ``then_close`` the heartbeat lands after the first run, and a second run from the same
    checkpoint closes what the watermark then passes.
    """
    spark = stream.sparkSession
    base = _scratch(spark, name)
    log = os.path.join(base, "log")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(log, f"_batch={batch_id}"))

    def run() -> None:
        q = (
            stream.writeStream.outputMode(output_mode)
            .foreachBatch(sink)
            .option("checkpointLocation", os.path.join(base, "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()

    run()
    if then_close is not None:
        then_close.heartbeat()
        run()
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    # Spark doesn't write the folder of a stream that never had a batch.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(os.path.join(log, "_batch=-1"))
    return spark.read.schema(schema).parquet(log)


def last_batch(log: DataFrame) -> DataFrame:
    """Reconcile a complete-mode changelog: the whole result table of the last micro-batch."""
    return log.join(log.agg(F.max("_batch").alias("_batch")), "_batch").drop("_batch")


def latest_per_key(log: DataFrame, keys: list[str]) -> DataFrame:
    """Reconcile a changelog: the version of each key from its latest micro-batch."""
    cols = [c for c in log.columns if c not in keys and c != "_batch"]
    r = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("_batch")).alias("r"))
    return r.select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


# ---- ST1: telemetry clean ------------------------------------------------------------------------


def telemetry_clean_stream(st: StreamTables, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST1 = P8 + P9 + W1 as a stream: keyed (machine, hour) replace by the newest ingest time."""
    raw = B.machine_telemetry_raw(st)
    valid = P.in_range_filter(raw, plant.TELEMETRY_BOUNDS).filter(F.col("ts").isNotNull() & F.col("machine_id").isNotNull())
    payload = ["oee_pct", "temp_c", "cycle_time_sec", "power_kw", "units_count", "ingest_ts"]
    agg = valid.withWatermark("ts", watermark).groupBy("machine_id", "ts").agg(
        F.max_by(F.struct(*payload), F.struct("ingest_ts", "oee_pct", "temp_c", "units_count", "cycle_time_sec", "power_kw")).alias("r")
    ).select("machine_id", "ts", *[F.col(f"r.{c}").alias(c) for c in payload])
    latest = latest_per_key(run_to_changelog(agg, "telemetry"), ["machine_id", "ts"])
    sid, period = P.shift_of("ts")
    return latest.select("machine_id", "ts", *payload[:-1], sid.alias("shift_id"), period.alias("shift_period"), "ingest_ts")


def telemetry_first_stream(st: StreamTables, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST1, cheap mode: the first version of each (machine, hour) to arrive, once, in append mode.

    ``dropDuplicatesWithinWatermark`` keeps a key for the watermark's span instead of a row, and rows go on
    at once; of versions in one micro-batch any may be first. Use ``telemetry_clean_stream`` where the newest must win.
    """
    raw = B.machine_telemetry_raw(st)
    valid = P.in_range_filter(raw, plant.TELEMETRY_BOUNDS).filter(F.col("ts").isNotNull() & F.col("machine_id").isNotNull())
    first = valid.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["machine_id", "ts"])
    sid, period = P.shift_of("ts")
    return run_to_changelog(first, "telemetry_first", "append").drop("_batch").select(
        "machine_id", "ts", sid.alias("shift_id"), period.alias("shift_period"), "oee_pct", "temp_c", "cycle_time_sec", "power_kw", "units_count", "ingest_ts"
    )


# ---- ST2: shift OEE windows ------------------------------------------------------------------------


def shift_oee_stream(st: StreamTables, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST2: average OEE (> 0) per 12-hour shift window (06:00 / 18:00 starts) and line, plus the
    plant, over valid readings. The plant row is re-added from the additive line sums."""
    raw = B.machine_telemetry_raw(st)
    valid = P.in_range_filter(raw, plant.TELEMETRY_BOUNDS).filter(F.col("oee_pct") > 0)
    master = B.machine_master(st.static).select("machine_id", "line")  # static side of a stream-static join
    j = valid.withWatermark("ts", watermark).join(master, "machine_id", "left")
    agg = j.groupBy(F.window("ts", "12 hours", "12 hours", "6 hours").alias("w"), "line").agg(
        F.sum(F.round(F.col("oee_pct") * 100).cast("bigint")).alias("sum_h"), F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("shift_start"), F.coalesce("line", F.lit("~")).alias("line"), "sum_h", "n")
    latest = latest_per_key(run_to_changelog(agg, "shift_oee"), ["shift_start", "line"])
    plant_rows = latest.groupBy("shift_start").agg(F.sum("sum_h").alias("sum_h"), F.sum("n").alias("n")).withColumn("line", F.lit("ALL"))
    both = latest.filter(F.col("line") != "~").unionByName(plant_rows)
    return both.select("shift_start", "line", P.round_half_up(F.col("sum_h") / F.col("n") / 100.0, 1).alias("avg_oee"),
                       F.col("n").cast("bigint").alias("readings"))


def oee_by_shift_stream(st: StreamTables, last_n: int = 14, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST2 = A10: two chained stateful operators in append mode, W1 per (machine, hour) and then OEE sums per window and line.

    A shift is made of whole 6-hour windows (the night shift of a day of its first and its last, Q2), so the windows, each
    emitted once when the watermark passes it, add up to the shifts of the batch.
    """
    raw = B.machine_telemetry_raw(st)
    valid = P.in_range_filter(raw, plant.TELEMETRY_BOUNDS).filter(F.col("machine_id").isNotNull())
    order = F.struct("ingest_ts", "oee_pct", "temp_c", "units_count", "cycle_time_sec", "power_kw")
    newest = valid.withWatermark("ts", watermark).groupBy("machine_id", "ts").agg(F.max_by("oee_pct", order).alias("oee_pct"))
    master = B.machine_master(st.static).select("machine_id", "line")
    lines = newest.filter(F.col("oee_pct") > 0).join(master, "machine_id", "left")
    sums = lines.groupBy(F.window("ts", "6 hours").alias("w"), "line").agg(
        F.sum(F.round(F.col("oee_pct") * 100).cast("bigint")).alias("sum_h"), F.count(F.lit(1)).alias("n")
    )
    log = run_to_changelog(sums.select(F.col("w.start").alias("start"), "line", "sum_h", "n"), "oee_by_shift", "append", st)
    sid, period = P.shift_of("start")
    parts = log.withColumns({"shift_id": sid, "shift_period": period})
    levels = parts.groupingSets(
        [["shift_id", "shift_period", "line"], ["shift_id", "shift_period"]], "shift_id", "shift_period", "line"
    ).agg(F.grouping_id().alias("gid"), F.sum("sum_h").alias("sum_h"), F.sum("n").alias("n"))
    return plant.shift_oee_wide(levels, last_n)


# ---- ST3: state duration with keyed state ----------------------------------------------------------

_EVENT_COLS = ["event_id", "machine_id", "event_ts", "state", "idle_reason"]
#: The events of an open slice, in order, column by column.
_STATE_SCHEMA = "event_id array<string>, event_us array<bigint>, state array<string>, idle_reason array<string>"
_OUT_SCHEMA = "event_id string, machine_id string, slice timestamp, event_ts timestamp, state string, idle_reason string, next_in_slice timestamp"


def _slice_threader(seconds: int):
    def thread(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Per (machine, slice): sort this batch's events in among the kept ones; emit each new event, and each event that
        a new one now follows, with the time of the next event in the slice (NULL for its last). When the watermark
        passes the slice's end no more of its events can come, and its state goes."""
        if state.hasTimedOut:
            state.remove()
            return
        frames = [b[_EVENT_COLS].assign(new=True) for b in batches]
        if state.exists:
            ids, us, states, reasons = state.get
            kept = {"event_id": ids, "machine_id": key[0], "event_ts": pd.to_datetime(us, unit="us"), "state": states, "idle_reason": reasons}
            frames.append(pd.DataFrame(kept).assign(new=False))
        cur = pd.concat(frames, ignore_index=True).sort_values(["event_ts", "event_id"], kind="mergesort", ignore_index=True)
        cur["slice"] = key[1]
        cur["next_in_slice"] = cur["event_ts"].shift(-1)
        changed = cur["new"] | cur["new"].shift(-1, fill_value=False)
        yield cur.loc[changed, ["event_id", "machine_id", "slice", "event_ts", "state", "idle_reason", "next_in_slice"]]
        us = (cur["event_ts"] - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)
        reasons = [None if pd.isna(x) else x for x in cur["idle_reason"]]
        state.update((cur["event_id"].tolist(), us.tolist(), cur["state"].tolist(), reasons))
        end = int(pd.Timestamp(key[1]).timestamp() * 1000) + seconds * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    return thread


def state_duration_stream(st: StreamTables, watermark: str = DEFAULT_WATERMARK, slice_seconds: int = plant.SLICE_SECONDS) -> DataFrame:
    """ST3 = W2 + P13 as a stream, whatever the order of arrival within the watermark's delay.

    State is kept per (machine, time slice) that the watermark has not passed, so a hot machine is spread over tasks and
    each holds a slice's events at most. An event's successor in a later slice comes from the table of slice heads
    (machines x slices rows). Events later than the delay are dropped; ``late.split_late`` keeps them.
    """
    raw = B.production_events_raw(st).filter(
        F.col("event_ts").isNotNull() & F.col("machine_id").isNotNull() & F.col("state").isin(*plant.STATES)
    )
    rows = raw.select(*_EVENT_COLS).withWatermark("event_ts", watermark).withColumn("slice", plant.slice_start("event_ts", slice_seconds))
    out = rows.groupBy("machine_id", "slice").applyInPandasWithState(
        _slice_threader(slice_seconds), _OUT_SCHEMA, _STATE_SCHEMA, "update", GroupStateTimeout.EventTimeTimeout
    )
    latest = latest_per_key(run_to_changelog(out, "state_duration"), ["event_id"])
    latest = plant.with_next_head(latest, "machine_id", "event_ts", "slice", "next_in_slice", "next_event_ts")
    secs = F.unix_timestamp("next_event_ts") - F.unix_timestamp("event_ts")
    return latest.select(
        "event_id", "machine_id", "event_ts", "state", "next_event_ts",
        F.when(F.col("next_event_ts").isNotNull(), F.floor((secs * 20 + 60) / 120) / 10).alias("duration_minutes"),
        P.downtime_category("state", "idle_reason").alias("downtime_category"),
    )


# ---- ST4 / ST5: keyed latest snapshots ---------------------------------------------------------------


def alarm_snapshot_stream(st: StreamTables, as_of: str, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST4: latest version of each alarm (by ingest time), then the active-alarm view."""
    raw = B.alarm_events_raw(st)
    cols = [c for c in raw.columns if c != "alarm_id"]
    agg = raw.withWatermark("ingest_ts", watermark).groupBy("alarm_id").agg(
        F.max_by(F.struct(*cols), F.col("ingest_ts")).alias("r")
    ).select("alarm_id", *[F.col(f"r.{c}").alias(c) for c in cols])
    latest = latest_per_key(run_to_changelog(agg, "alarms"), ["alarm_id"])
    return plant.alarms_active(plant.alarms_silver(latest, B.machine_master(st.static), as_of))


def latest_event_stream(st: StreamTables, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Latest event of each machine (update mode)."""
    raw = B.production_events_raw(st).filter(F.col("state").isin(*plant.STATES) & F.col("machine_id").isNotNull())
    payload = ["event_id", "event_ts", "state", "fault_code", "fault_msg", "idle_reason", "maintenance_type"]
    agg = raw.withWatermark("event_ts", watermark).groupBy("machine_id").agg(
        F.max_by(F.struct(*payload), F.struct("event_ts", "event_id")).alias("e")
    ).select("machine_id", "e.*")
    return latest_per_key(run_to_changelog(agg, "machine_state"), ["machine_id"])


def machine_state_stream(st: StreamTables, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST5 = J7: the snapshot of every machine from its latest event and the cleaned telemetry, both streamed."""
    events, telemetry = latest_event_stream(st, watermark), telemetry_clean_stream(st, watermark)
    shifts = plant.shifts_silver(B.shift_records_raw(st.static))
    return plant.machine_state(B.machine_master(st.static), telemetry, events, shifts)


# ---- ST6: sliding downtime ---------------------------------------------------------------------------


def downtime_sliding_stream(st: StreamTables, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST6: downtime minutes per reason over 7-day windows sliding by a day."""
    dt = plant.downtime_events(B.dt_mst(st))
    agg = dt.withWatermark("start_ts", watermark).groupBy(F.window("start_ts", "7 days", "1 day").alias("w"), "reason_desc").agg(
        F.sum("duration_minutes").alias("downtime_minutes"), F.count(F.lit(1)).alias("events")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "reason_desc", "downtime_minutes", "events")
    return latest_per_key(run_to_changelog(agg, "downtime"), ["window_start", "reason_desc"])


def downtime_pareto_stream(st: StreamTables, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST6 on A12's table: the state durations of ST3 are written, and a second job streams that table into a pane per (day, reason).

    The panes are all the state there is (days x reasons, however many events), so this job needs no watermark and the order of
    the table's files is of no matter; the windows slide over the panes.
    """
    durations = state_duration_stream(st, watermark)
    table = _scratch(st.spark, "durations")
    durations.write.parquet(table)
    panes = plant.downtime_panes(file_stream(st.spark, durations.schema, table, FILES_PER_TRIGGER))
    return plant.sliding_pareto(latest_per_key(run_to_changelog(panes, "downtime_panes"), ["day", "reason"]))


# ---- ST7: late data audit ----------------------------------------------------------------------------


def late_data_audit_stream(st: StreamTables, on_time_min: int = 15, late_min: int = 45) -> DataFrame:
    """ST7: readings by arrival delay (ingest time - event hour): on_time / late / too_late."""
    raw = B.machine_telemetry_raw(st)
    delay = (F.unix_timestamp("ingest_ts") - F.unix_timestamp("ts")) / 60.0
    cls = F.when(delay < on_time_min, F.lit("on_time")).when(delay < late_min, F.lit("late")).otherwise(F.lit("too_late"))
    agg = raw.groupBy(cls.alias("arrival")).agg(F.count(F.lit(1)).alias("readings"))
    return latest_per_key(run_to_changelog(agg, "late_audit", output_mode="complete"), ["arrival"])


# ---- ST8: page sessions ------------------------------------------------------------------------------


def page_time_log(t: Tables) -> DataFrame:
    """Engagement log: user, page, seconds, clicks, time (from the event table)."""
    e = t.events
    return e.select(
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("username"),
        F.concat(F.lit("app-"), (F.col("user_id") % 3).cast("string")).alias("app_name"),
        F.col("event_type").alias("page"),
        F.floor("value").cast("int").alias("seconds_spent"),
        B.props_k().alias("click_count"),
        F.col("ts").alias("recorded_at"),
    )


def page_sessions_stream(st: StreamTables, gap: str = "30 minutes", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST8: per-user sessions (30-minute inactivity gap) with events, seconds and clicks.

    Append mode: a session is emitted once, when the watermark has passed its end, and only open sessions stay in state.
    """
    log = page_time_log(st)
    agg = log.withWatermark("recorded_at", watermark).groupBy("username", F.session_window("recorded_at", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("seconds_spent").cast("bigint").alias("seconds"),
        F.sum("click_count").cast("bigint").alias("clicks"),
    ).select("username", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events", "seconds", "clicks")
    return run_to_changelog(agg, "sessions", "append", st).drop("_batch")

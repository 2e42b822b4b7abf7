"""Streams replayed from many files, out of order: each equals its batch twin, and no late row vanishes."""

import datetime as dt
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrun.operators import plant
from millrun.plans.catalog import QUERIES
from millrun.sources import bindings as B
from millrun.sources.tables import Tables
from millrun.streaming import jobs as J
from millrun.streaming import late as L


def lines(df, cols=None):
    return sorted(map(str, df.select(*(cols or df.columns)).collect()))


@pytest.fixture(scope="module")
def shuffled(spark, sf_dir, tmp_path_factory):
    """The events in three files, the newest first, read one a micro-batch."""
    ev = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    base = tmp_path_factory.mktemp("events")
    rows = ev.withColumn("_p", F.lit(3) - F.ntile(3).over(Window.orderBy("ts", "event_id")))
    for i in range(3):
        rows.where(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(str(base / f"events_{i}"))
    return lambda: J.StreamTables(spark, sf_dir, max_files_per_trigger=1, path=str(base / "events_*"))


def test_shift_oee_in_append_mode_equals_batch(spark, sf_dir, shuffled):
    assert lines(J.oee_by_shift_stream(shuffled(), watermark="60 days")) == lines(QUERIES["oee_by_shift"](spark, sf_dir))


def test_state_durations_by_slice_equal_batch(spark, sf_dir, shuffled):
    cols = ["event_id", "machine_id", "event_ts", "state", "next_event_ts", "duration_minutes", "downtime_category"]
    want = lines(QUERIES["state_events_silver"](spark, sf_dir), cols)
    assert lines(J.state_duration_stream(shuffled(), watermark="60 days", slice_seconds=6 * 3600), cols) == want


def test_sessions_in_append_mode_equal_batch(spark, sf_dir, shuffled):
    assert lines(J.page_sessions_stream(shuffled(), watermark="60 days")) == lines(QUERIES["page_sessions_stream"](spark, sf_dir))


def test_first_version_comes_once(spark, sf_dir, shuffled):
    batch = plant.telemetry_silver(B.machine_telemetry_raw(Tables(spark, sf_dir)))
    got = J.telemetry_first_stream(shuffled(), watermark="60 days")
    assert lines(got, ["machine_id", "ts", "shift_id"]) == lines(batch, ["machine_id", "ts", "shift_id"])
    raw = B.machine_telemetry_raw(Tables(spark, sf_dir)).select("machine_id", F.col("ts").cast("timestamp"), F.col("ingest_ts").cast("timestamp"), "oee_pct")
    assert got.select(*raw.columns).exceptAll(raw).count() == 0


def test_machine_state_of_streams(spark, sf_dir, shuffled):
    assert lines(J.machine_state_stream(shuffled(), watermark="60 days")) == lines(QUERIES["machine_state"](spark, sf_dir))


def test_slices_of_any_length_give_the_same_durations(spark):
    ts = dt.datetime
    times = [ts(2024, 1, 1, 0, 0), ts(2024, 1, 1, 0, 59, 59), ts(2024, 1, 1, 1, 0), ts(2024, 1, 1, 1, 0), ts(2024, 1, 4, 23, 59, 59), ts(2024, 1, 9)]
    ev = spark.createDataFrame([(f"{i}", "M-1", t) for i, t in enumerate(times)], "event_id string, machine_id string, event_ts timestamp")
    for seconds in (60, 3600, 86400, 10**8):
        out = {r["event_id"]: r["next_event_ts"] for r in plant.state_duration(ev, "machine_id", "event_ts", "event_id", seconds=seconds).collect()}
        assert [out[f"{i}"] for i in range(6)] == [*times[1:], None]


def events_with_arrival(spark, sf_dir, arrival):
    rows = B.production_events_raw(Tables(spark, sf_dir)).select("event_id", F.col("event_ts").cast("timestamp").alias("event_ts"))
    return rows.withColumn("arrival_slice", arrival)


def brute_late(rows, delay):
    """Row by row: late if behind the newest event of all earlier slices, less the delay."""
    out = {}
    for piece in sorted({r["arrival_slice"] for r in rows}):
        seen = [r["event_ts"] for r in rows if r["arrival_slice"] < piece and r["event_ts"]]
        for r in rows:
            if r["arrival_slice"] == piece and seen and r["event_ts"] and r["event_ts"] < max(seen) - delay:
                out[r["event_id"]] = max(seen) - delay
    return out


@pytest.mark.parametrize("arrival", ["pmod(xxhash64(event_id), 5)", "5 - ntile(5) over (order by event_ts)"])
def test_late_rows_of_a_shuffled_replay(spark, sf_dir, arrival):
    rows = events_with_arrival(spark, sf_dir, F.expr(arrival))
    main, late = L.split_late(L.Landing(rows, "arrival_slice", "t"), "event_ts", "3 days", "t")
    want = brute_late(rows.collect(), dt.timedelta(days=3))
    got = {r["event_id"]: r["watermark"] for r in late.collect()}
    assert got == want and len(got) > 100
    batch = rows.drop("arrival_slice")
    assert lines(main.unionByName(late.select(*batch.columns))) == lines(batch)
    days = L.reconciled(main, late, batch, [F.to_date("event_ts").alias("day")]).collect()
    assert all(d["missing"] == 0 and d["on_time_rows"] + d["late_rows"] == d["batch_rows"] for d in days)


def test_late_split_of_a_batch_run_twice(spark, sf_dir):
    """A micro-batch that is run again (its sink called twice) replaces what it wrote."""
    rows = events_with_arrival(spark, sf_dir, F.expr("pmod(xxhash64(event_id), 3)"))
    landing = L.Landing(rows, "arrival_slice", "twice")
    split = L.LateSplit(landing.stream(), "twice", "event_ts", "1 day")
    once = split.sink
    split.sink = lambda batch, i: (once(batch, i), once(batch, i))[0]
    for piece in landing.slices:
        landing.land(piece)
        split.run()
    main, late = split.tables()
    want = brute_late(rows.collect(), dt.timedelta(days=1))
    assert {r["event_id"] for r in late.collect()} == set(want)
    assert main.count() + late.count() == rows.count()


def test_late_split_of_nulls_and_of_no_rows(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 9), 0), ("b", None, 1), ("c", dt.datetime(2024, 1, 1), 1), ("c", dt.datetime(2024, 1, 1), 1)],
                                 "event_id string, event_ts timestamp, k int")
    main, late = L.split_late(L.Landing(rows, "k", "nulls"), "event_ts", "1 hour", "nulls")
    assert sorted(r[0] for r in main.collect()) == ["a", "b"] and sorted(r[0] for r in late.collect()) == ["c", "c"]
    main, late = L.split_late(L.Landing(rows.limit(0), "k", "none"), "event_ts", "1 hour", "none")
    assert main.count() == late.count() == 0


def test_streams_over_no_events(spark, sf_dir, tmp_path):
    ev = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    os.makedirs(tmp_path / "sf")
    for name in ("events",):
        ev.limit(0).write.parquet(str(tmp_path / "sf" / f"{name}.parquet"))
    st = J.StreamTables(spark, str(tmp_path / "sf"))
    assert J.page_sessions_stream(st).count() == 0
    assert J.telemetry_first_stream(J.StreamTables(spark, str(tmp_path / "sf"))).count() == 0
    assert J.state_duration_stream(J.StreamTables(spark, str(tmp_path / "sf"))).count() == 0

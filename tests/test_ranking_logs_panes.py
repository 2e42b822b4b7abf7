"""Whole ranking of alarms, sliding downtime windows, the engagement log, capped statements, status slugs, category facts of the network."""

import datetime as dt

from pyspark.sql import functions as F

from millrun.operators import field, planning, plant
from millrun.sources import io as IO


def test_ranking_counts_on_over_slices_and_ties(spark):
    rows = [(f"A{i:04d}", 1 + (i % 3 == 0), dt.datetime(2024, 1, 1 + i % 5)) for i in range(3000)]
    active = spark.createDataFrame(rows, "alarm_id string, severity_rank int, triggered_ts timestamp").repartition(5)
    got = {r["alarm_id"]: r["alarm_rank"] for r in plant.alarm_ranking(active).collect()}
    want = sorted(rows, key=lambda r: (r[1], -r[2].timestamp(), r[0]))
    assert got == {r[0]: i for i, r in enumerate(want, 1)}
    assert plant.alarm_ranking(active.limit(0)).count() == 0


def test_alarms_of_listed_machines(spark):
    alarms = spark.createDataFrame([("a", "m1"), ("b", "m2"), ("c", None)], "alarm_id string, machine_id string")
    machines = spark.createDataFrame([("m1",), ("m1",), (None,)], "machine_id string")
    assert [r["alarm_id"] for r in plant.alarms_for_machine(alarms, machines).collect()] == ["a"]


STOPS = "event_ts timestamp, state string, downtime_category string, duration_minutes double"


def test_windows_slide_by_a_day(spark):
    rows = [
        (dt.datetime(2024, 1, 10, 23, 59), "fault", "Breakdown", 30.0),
        (dt.datetime(2024, 1, 12), "idle", "Starved", 10.0),
        (dt.datetime(2024, 1, 12), "running", "Breakdown", 99.0),
        (dt.datetime(2024, 1, 12), "fault", None, 99.0),
        (dt.datetime(2024, 1, 12), "fault", "Breakdown", None),
    ]
    events = spark.createDataFrame(rows, STOPS)
    out = plant.sliding_pareto(plant.downtime_panes(events), 3).collect()
    got = {(r["window_start"].day, r["reason"]): (r["window_end"].day, r["minutes"], r["pct"]) for r in out}
    assert got == {
        (8, "Breakdown"): (11, 30.0, 100.0), (9, "Breakdown"): (12, 30.0, 100.0), (10, "Breakdown"): (13, 30.0, 75.0),
        (10, "Starved"): (13, 10.0, 25.0), (11, "Starved"): (14, 10.0, 100.0), (12, "Starved"): (15, 10.0, 100.0),
    }
    assert plant.sliding_pareto(plant.downtime_panes(events.limit(0))).count() == 0


def test_window_before_the_clock_is_the_pareto(spark):
    rows = [(dt.datetime(2024, 1, 30) - dt.timedelta(hours=7 * i), "idle", f"r{i % 3}", 1.5 * i) for i in range(40)]
    events = spark.createDataFrame(rows, STOPS)
    window = plant.sliding_pareto(plant.downtime_panes(events)).where("window_end = timestamp'2024-01-31'")
    want = plant.downtime_pareto(events, "2024-01-31 00:00:00")
    assert sorted(map(tuple, window.select("reason", "minutes", "pct").collect())) == sorted(map(tuple, want.collect()))


def test_log_rows_are_typed_and_old_files_lack_clicks(spark, tmp_path):
    path = str(tmp_path / "log")
    old = spark.createDataFrame([("u", "p", 5)], "username string, page string, seconds_spent int")
    IO.event_log_rows(old).drop("click_count").write.parquet(path)
    calls = spark.createDataFrame(
        [("v", "p'; DROP TABLE x", "7", None, "extra"), (None, "q", "seven", "3", "extra")],
        "username string, page string, seconds_spent string, click_count string, detail string",
    )
    IO.event_log_append_rows(calls, path)
    log = IO.read_event_log(spark, path)
    assert log.columns == ["username", "company_name", "page", "seconds_spent", "click_count", "app_name", "recorded_at"]
    got = sorted((r["page"], r["username"], r["seconds_spent"], r["click_count"]) for r in log.collect())
    assert got == [("p", "u", 5, None), ("p'; DROP TABLE x", "v", 7, 0), ("q", None, 0, 3)]


def test_statement_cut_only_beyond_the_cap(spark):
    for n, cut in ((9, False), (10, False), (11, True)):
        rows, truncated = IO.adhoc_sql(spark, f"SELECT id FROM range({n}) ORDER BY id DESC", cap=10)
        assert truncated is cut
        assert [r["id"] for r in rows.collect()] == list(range(n))[::-1][:10]


def test_statement_runs_once(spark):
    rows, truncated = IO.adhoc_sql(spark, "SELECT id, rand() AS r FROM range(50)", cap=20)
    assert truncated and rows.collect() == rows.collect()


def test_status_slugs(spark):
    rows = [("r", "IN_PROGRESS", dt.date(2001, 1, 1), 2), ("r", "in-progress", dt.date(2002, 1, 1), 3),
            ("r", "CLOSED", dt.date(2001, 1, 1), 4), ("r", None, dt.date(2001, 1, 1), 5)]
    orders = spark.createDataFrame(rows, "rig_id string, status string, due_date date, estimated_hours int")
    got = {r["status"]: (r["work_orders"], r["hours"], r["overdue"]) for r in field.work_orders_by_status(orders, "2001-12-01").collect()}
    assert got == {"in-progress": (2, 5, 1), "closed": (1, 4, 0), None: (1, 5, 0)}


NETWORK = "product_category string, sku string, branch_id string, location_type string, region string, available_stock int, safety_stock int, unit_cost double, primary_origin string, carrier_flag string"


def _network(spark, rows):
    return spark.createDataFrame([(c, k, b, loc, "", s, f, 2.0, "x", "1") for c, k, b, loc, s, f in rows], NETWORK)


def test_roles_by_category(spark):
    rows = [
        ("A", "s1", "b1", "HUB", 9, 1), ("A", "s1", "b2", "SPOKE", 0, 4), ("A", "s2", "b3", "DEPOT", 5, 5),  # stated roles; others drop out
        ("B", "s1", "b1", "SPOKE", 1, 4), ("B", "s1", "b2", "SPOKE", 8, 1), ("B", "s2", "b3", None, 8, 1),  # no hub: by stock, ties by id
        ("C", "s1", "b1", "SPOKE", 1, 4),  # one row
        ("D", "s1", "b1", "SPOKE", 1, 4), ("D", "s2", "b1", "SPOKE", 1, 4),  # one branch
        (None, "s1", "b1", "hub ", 9, 0), (None, "s1", "b2", " spoke", 0, 3),
    ]
    roles = planning.network_roles(_network(spark, rows))
    got = sorted((r["product_category"], r["sku"], r["branch_id"], r["role"]) for r in roles.collect())
    assert got == [
        ("A", "s1", "b1", "HUB"), ("A", "s1", "b2", "SPOKE"),
        ("B", "s1", "b1", "SPOKE"), ("B", "s1", "b2", "HUB"), ("B", "s2", "b3", "SPOKE"),
        ("Default", "s1", "b1", "HUB"), ("Default", "s1", "b2", "SPOKE"),
    ]
    assert planning.network_roles(_network(spark, rows).limit(0)).count() == 0


def test_no_shuffle_of_the_network_by_category_alone(spark):
    rows = [("A", f"s{i}", f"b{i % 4}", "HUB" if i % 4 else "SPOKE", i, 3) for i in range(50)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = planning.network_roles(_network(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert joins and all("branch_id" in j for j in joins)


def test_sliding_windows_of_a_shuffled_stream_equal_batch(spark, sf_dir, tmp_path):
    import os

    from millrun.plans.catalog import QUERIES
    from millrun.streaming import jobs as J

    ev = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    for i in range(2):
        ev.where(F.col("event_id") % 2 == i).coalesce(1).write.parquet(str(tmp_path / f"events_{i}"))
    st = J.StreamTables(spark, sf_dir, max_files_per_trigger=1, path=str(tmp_path / "events_*"))
    got, want = J.downtime_pareto_stream(st, watermark="60 days"), QUERIES["downtime_pareto_sliding"](spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))

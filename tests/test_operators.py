"""Literal-row tests for the quirks of SURVEY §2.15 and properties of §5 (small fixtures, exact)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrun.functions import scalar as P
from millrun.functions.similarity import jaro_winkler
from millrun.operators import commercial, erp, lab, plant, planning, text
from millrun.sources import io as IO


def rows(df, order=None):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def test_delivery_status_three_valued(spark):
    """Q6 + edge rows: both dates NULL -> Pending; plan NULL + actual set -> NULL flag but Late;
    unparsable date -> treated as missing."""
    lips = spark.createDataFrame([("1", "1", "m", 5, "EA"), ("2", "1", "m", 5, "EA"), ("3", "1", "m", 5, "EA"), ("4", "1", "m", 5, "EA")],
                                 "vbeln string, posnr string, matnr string, lfimg int, vrkme string")
    likp = spark.createDataFrame([("1", "c", None, None, "x"), ("2", "c", None, "2020-01-05", "x"), ("3", "c", "2020-01-10", "2020-01-05", "x"),
                                  ("4", "c", "2020-02-30", "2020-01-05", "x")],
                                 "vbeln string, kunnr string, lfdat string, wadat_ist string, tragr string")
    d = {r["delivery_number"]: r for r in rows(erp.delivery_lines(lips, likp))}
    assert d["1"]["delivery_status"] == "Pending" and d["1"]["on_time_delivery"] is None
    assert d["2"]["delivery_status"] == "Late" and d["2"]["on_time_delivery"] is None
    assert d["3"]["delivery_status"] == "On Time" and d["3"]["delivery_variance_days"] == -5
    assert d["4"]["planned_delivery_date"] is None and d["4"]["delivery_status"] == "Late"


def test_kpi_on_empty_input(spark):
    """Every global KPI returns one row for empty input (zero denominators -> 0)."""
    empty = spark.createDataFrame([], erp.delivery_lines(
        spark.createDataFrame([], "vbeln string, posnr string, matnr string, lfimg int, vrkme string"),
        spark.createDataFrame([], "vbeln string, kunnr string, lfdat string, wadat_ist string, tragr string")).schema)
    r = rows(erp.kpi_delivery(empty))
    assert len(r) == 1 and r[0]["total_delivery_lines"] == 0 and r[0]["on_time_delivery_rate_pct"] == 0.0


def test_telemetry_ranges_dedupe_and_shift(spark):
    """P8 bounds (inclusive), NULL drops, newest ingest wins, Q2 shift naming at 05:59/06:00/17:59/18:00."""
    ts = lambda h, m=0: dt.datetime(2024, 1, 2, h, m)
    raw = spark.createDataFrame([
        ("M-1", ts(5, 59), 0.0, -50.0, 1.0, 1.0, 1, ts(6)), ("M-1", ts(6), 100.0, 500.0, 1.0, 1.0, 2, ts(7)),
        ("M-1", ts(17, 59), 100.1, 20.0, 1.0, 1.0, 3, ts(18)), ("M-1", ts(18), None, 20.0, 1.0, 1.0, 4, ts(19)),
        ("M-2", ts(9), 50.0, 20.0, 0.0, 1.0, 5, ts(10)),
        ("M-3", ts(9), 10.0, 20.0, 1.0, 1.0, 6, ts(10)), ("M-3", ts(9), 20.0, 20.0, 1.0, 1.0, 7, ts(11)),
        ("M-3", ts(9), 30.0, 20.0, 1.0, 1.0, 8, ts(10, 30)),
    ], "machine_id string, ts timestamp, oee_pct double, temp_c double, cycle_time_sec double, power_kw double, units_count int, ingest_ts timestamp")
    out = {(r["machine_id"], r["ts"]): r for r in rows(plant.telemetry_silver(raw))}
    assert set(out) == {("M-1", ts(5, 59)), ("M-1", ts(6)), ("M-3", ts(9))}
    assert out[("M-3", ts(9))]["oee_pct"] == 20.0  # newest ingest_ts
    assert out[("M-1", ts(5, 59))]["shift_id"] == "2024-01-02-N" and out[("M-1", ts(6))]["shift_id"] == "2024-01-02-D"


def test_state_duration_ties_single_and_buckets(spark):
    """Single event -> NULL; equal timestamps ordered by event id; next event across days."""
    ts = dt.datetime
    ev = spark.createDataFrame([
        ("1", "M-1", ts(2024, 1, 1, 23, 0)), ("2", "M-1", ts(2024, 1, 3, 1, 0)), ("4", "M-1", ts(2024, 1, 3, 2, 0)),
        ("3", "M-1", ts(2024, 1, 3, 2, 0)), ("9", "M-2", ts(2024, 1, 1, 1, 0)),
    ], "event_id string, machine_id string, event_ts timestamp")
    out = {r["event_id"]: r["next_event_ts"] for r in rows(plant.state_duration(ev, "machine_id", "event_ts", "event_id"))}
    assert out["1"] == ts(2024, 1, 3, 1, 0)  # crosses an empty day
    assert out["3"] == ts(2024, 1, 3, 2, 0) and out["4"] is None and out["9"] is None


def test_mtbf_sentinel_and_flag(spark):
    """One fault -> 9999 and not flagged; a 200 h gap is not flagged (strictly below)."""
    ts = dt.datetime
    ev = spark.createDataFrame([
        ("1", "M-1", ts(2024, 1, 1), "fault", 60.0), ("2", "M-2", ts(2024, 1, 1), "fault", 30.0),
        ("3", "M-2", ts(2024, 1, 9, 8), "fault", 90.0), ("4", "M-2", ts(2024, 1, 10), "fault", None),
    ], "event_id string, machine_id string, event_ts timestamp, state string, duration_minutes double")
    master = spark.createDataFrame([("M-1", "A", "one"), ("M-2", "A", "two")], "machine_id string, line string, name string")
    out = {r["machine_id"]: r for r in rows(plant.mtbf_by_machine(ev, master, "2024-01-31 00:00:00"))}
    assert out["M-1"]["mtbf_hrs"] == 9999.0 and out["M-1"]["flagged"] is False
    assert out["M-2"]["mtbf_hrs"] == 200.0 and out["M-2"]["flagged"] is False and out["M-2"]["mttr_hrs"] == 1.0


@pytest.mark.parametrize("n_words,expected", [(0, []), (1, [1]), (520, [520]), (521, [521, 1]), (600, [600, 80]), (601, [600, 81])])
def test_chunk_boundaries(spark, n_words, expected):
    """Chunk sizes for 0, 1, 520, 521, 600, 601 words (tail kept inside the previous chunk)."""
    doc = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n_words)))], "doc_id long, text string")
    got = [len(r["content"].split(" ")) for r in rows(text.chunk_documents(doc, "doc_id", "text"), ["chunk_index"])]
    assert got == expected


def test_chunks_cover_every_word(spark):
    doc = spark.createDataFrame([(7, "  a\n b   c " * 700)], "doc_id long, text string")
    ch = rows(text.chunk_documents(doc, "doc_id", "text"), ["chunk_index"])
    words = set()
    for r in ch:
        words.update((r["chunk_index"] * 520 + i) for i in range(len(r["content"].split(" "))))
    assert words == set(range(2100))


def test_fuzzy_exact_case_and_blocking_is_exact(spark):
    """M1-M3: same text in another case is EXACT; blocking returns every non-LOW pair of all pairs."""
    names = spark.createDataFrame([(1, "Red Widget"), (2, "red widget"), (3, "red widgets"), (4, "blue bolt"), (5, "")],
                                  "sku_id long, sku_description string")
    m = {(r["sku_id_a"], r["sku_id_b"]): r for r in rows(text.fuzzy_match(names, "sku_id", "sku_description"))}
    assert m[(1, 2)]["match_tier"] == "EXACT"
    g = text.with_grams(names, "sku_description")
    allp = g.alias("a").join(g.alias("b"), F.col("a.sku_id") < F.col("b.sku_id")).select(
        F.col("a.sku_id").alias("id_a"), F.col("b.sku_id").alias("id_b"))
    brute = {(r["sku_id_a"], r["sku_id_b"]) for r in rows(text.score_pairs(allp, g, "sku_id", "sku_description"))
             if r["match_tier"] != "LOW"}
    assert brute == set(m)


def test_jaro_winkler_properties():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611111111)
    assert jaro_winkler("", "") == 1.0 and jaro_winkler("abc", "") == 0.0
    assert jaro_winkler("dixon", "dicksonx") == jaro_winkler("dicksonx", "dixon")


def test_transfer_plan_properties(spark):
    """O2: shifts sum to zero per SKU, hubs never ship more than their stock, needs met first,
    duplicate (sku, branch) rows summed (Q10), no hub -> inferred."""
    rows_in = [
        ("S1", "B0", "x", "HUB", "FL", "cat", 10, 0, 1.0, "Carrier"), ("S1", "B1", "x", "SPOKE", "FL", "cat", 0, 4, 1.0, "Carrier"),
        ("S1", "B2", "x", "SPOKE", "FL", "cat", 1, 20, 1.0, "Carrier"), ("S1", "B2", "x", "SPOKE", "FL", "cat", 1, 0, 1.0, "Carrier"),
        ("S2", "B0", "x", "HUB", "", "cat", 3, 0, 2.0, None), ("S2", "B1", "x", "SPOKE", "", "cat", 0, 1, 2.0, None),
        ("S3", "B0", "x", "", "FL", "cat2", 50, 0, 1.0, "1"), ("S3", "B1", "x", "", "FL", "cat2", 0, 10, 1.0, "1"),
    ]
    net = spark.createDataFrame(rows_in, "sku string, branch_id string, primary_origin string, location_type string, region string, "
                                         "product_category string, available_stock int, safety_stock int, unit_cost double, carrier_flag string")
    plan = rows(planning.transfer_plan(net))
    by = {(r["SKU"], r["Branch_ID"]): r["Recommended_Stock_Shift"] for r in plan}
    for sku in ("S1", "S2", "S3"):
        assert sum(v for (s, _), v in by.items() if s == sku) == 0
    assert by[("S1", "B0")] == -10 and by[("S1", "B1")] == 4 and by[("S1", "B2")] == 6  # needs 4 + 18, supply 10
    assert by[("S2", "B1")] == 1 and by[("S3", "B0")] == -10 and by[("S3", "B1")] == 10


def test_merges_idempotent(spark):
    """IO6 / IO7 / IO9: key twice in the source, re-run gives the same table, other parents stay."""
    tgt = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    src = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    once = IO.merge_upsert(tgt, src, ["k"])
    assert rows(once, ["k"]) == rows(IO.merge_upsert(once, src, ["k"]), ["k"])
    assert {r["k"]: r["v"] for r in rows(once)} == {1: "a", 2: "x", 3: "z"}
    ins = IO.merge_insert_only(tgt, src, ["k"])
    assert {r["k"]: r["v"] for r in rows(ins)} == {1: "a", 2: "b", 3: "y"}
    kids = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, c string")
    new = spark.createDataFrame([(1, "z")], "p int, c string")
    assert sorted((r["p"], r["c"]) for r in rows(IO.replace_children(kids, new, "p"))) == [(1, "z"), (2, "c")]


def test_dense_index_matches_dense_rank(spark):
    """W9 at scale: the index by range slices equals a global dense rank, for sparse, hashed and text ids."""
    ids = spark.createDataFrame([(i,) for i in (5, 3, 3, 1000, 7, 2 ** 21 + 1, 2 ** 20)], "id long")
    got = {r["id"]: r["group_no"] for r in rows(lab.dense_index(ids, "id"))}
    assert got == {3: 1, 5: 2, 7: 3, 1000: 4, 2 ** 20: 5, 2 ** 21 + 1: 6}
    many = spark.range(0, 20000, 1, 5).select(F.hash("id").cast("string").alias("id"))
    got = [r["id"] for r in lab.dense_index(many, "id").orderBy("group_no").collect()]
    assert got == sorted({r["id"] for r in many.collect()})


def test_safe_ratio_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "n double, d double")
    got = [r["r"] for r in df.select(P.safe_ratio("n", "d").alias("r")).collect()]
    assert got == [None, None, 1.5]
    assert spark.range(1).select(P.round_half_up(F.lit(1050.21375), 4).alias("x")).first()["x"] in (1050.2137, 1050.2138)


def test_stream_replay_equals_batch(spark, sf_dir):
    """ST1: the same events in three out-of-order files give the batch telemetry_silver."""
    from millrun.sources import bindings as B
    from millrun.sources.tables import Tables
    from millrun.streaming import jobs as J

    d = tempfile.mkdtemp(prefix="millrun-replay-")
    ev = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    parts = [ev.filter(F.col("event_id") % 3 == i) for i in (2, 0, 1)]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(os.path.join(d, f"events_{i}.parquet"))
    st = J.StreamTables(spark, sf_dir, max_files_per_trigger=1)
    st.__dict__["events"] = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
                             .parquet(os.path.join(d, "events_*.parquet", "*.parquet")).withColumn("ts", F.col("ts").cast("timestamp")))
    stream = J.telemetry_clean_stream(st)
    batch = plant.telemetry_silver(B.machine_telemetry_raw(Tables(spark, sf_dir)))
    key = ["machine_id", "ts"]
    assert rows(stream.select(*batch.columns), key) == rows(batch, key)


def test_step_evaluation_visibility_numbering(spark):
    """P30/P31/W10/A42 edge rows: bound equal to value passes; blank -> NULL; text in a number step
    -> NULL; numeric prefix "12mm" -> 12; hidden mandatory step (Q16); instruction numbering; the
    newest of two responses wins."""
    runs = spark.createDataFrame([(1, 7, "completed"), (2, 7, "completed")], "id bigint, procedure_id int, status string")
    sections = spark.createDataFrame([(71, 7)], "id int, procedure_id int")
    steps = spark.createDataFrame([
        (701, 71, 1, "instruction", True, "{}", None),
        (702, 71, 2, "pass_fail", False, "{}", None),
        (703, 71, 3, "number", True, '{"lower": 10, "upper": 40}', None),
        (704, 71, 4, "number", True, '{"upper": 5}', '{"step_id": 702, "value": "Pass"}'),
        (705, 71, 5, "instruction", True, "{}", None),
        (706, 71, 6, "text", False, "{}", None),
    ], "id int, section_id int, order_index int, step_type string, is_mandatory boolean, tolerances_json string, condition_json string")
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    resp = spark.createDataFrame([
        ("a", 1, 702, "Pass", t0), ("b", 1, 703, "40", t0), ("c", 1, 704, "5", t0), ("d", 1, 706, "", t0),
        ("e", 2, 702, "Fail", t0), ("f", 2, 702, "Pass", t1),  # newest wins -> Pass
        ("g", 2, 703, "12mm", t0), ("h", 2, 704, "n/a", t0),
    ], "id string, run_id bigint, step_id int, value string, created_at timestamp")
    res = lab.step_results(runs, sections, steps, resp)
    r = {(x["run_id"], x["step_id"]): x for x in rows(res)}
    assert r[(1, 703)]["passed"] is True and r[(1, 704)]["passed"] is True  # both bounds inclusive
    assert r[(1, 706)]["passed"] is None and r[(1, 701)]["passed"] is None
    assert r[(2, 703)]["passed"] is True and r[(2, 704)]["passed"] is None  # prefix number; text -> NULL
    assert r[(1, 704)]["visible"] is True and r[(2, 702)]["value"] == "Pass"
    assert [r[(1, s)]["step_number"] for s in (701, 702, 703, 704, 705, 706)] == [1, 2, 3, 4, 2, 6]
    # run 3 never answered step 702 -> step 704 hidden; it is mandatory and unanswered
    runs3 = spark.createDataFrame([(3, 7, "completed")], "id bigint, procedure_id int, status string")
    resp3 = spark.createDataFrame([("x", 3, 703, "20", t0)], "id string, run_id bigint, step_id int, value string, created_at timestamp")
    r3 = rows(lab.run_completion(lab.step_results(runs3, sections, steps, resp3)))[0]
    assert r3["run_passed"] is True and r3["run_passed_all_mandatory"] is False  # Q16 fixed vs faithful
    h = {x["step_id"]: x for x in rows(lab.step_results(runs3, sections, steps, resp3))}
    assert h[704]["visible"] is False and h[704]["step_number"] is None
    assert [h[s]["step_number"] for s in (701, 705)] == [1, 2]


def test_cascade_special_cases(spark):
    """Normal chain stops below 0.05; nothing starved -> final assembly at 0.85 h; shared final
    assembly down -> each line's last station at 0.82 h. C3: revenue = units x source unit value."""
    from millrun.operators import reliability as R

    route = R.route_table(spark)
    out = spark.createDataFrame([("o1", "A", 3, 2.0), ("o2", "B", 0, 0.5), ("o3", "A", 4, 1.0)],
                                "outage_id string, line string, idx int, hours double")
    c = {(x["outage_id"], x["station"]): x for x in rows(R.cascade_raw(out, route))}
    assert set(k for k in c if k[0] == "o1") == {("o1", "FAL-ASM-01")} and c[("o1", "FAL-ASM-01")]["impact_hours"] == 2.0
    assert set(k for k in c if k[0] == "o2") == {("o2", "FAL-ASM-01")} and c[("o2", "FAL-ASM-01")]["impact_hours"] == 0.5 * 0.85
    assert {k[1] for k in c if k[0] == "o3"} == {"BDY-INS-01", "PNT-INS-01", "PTN-DYN-01"}
    assert all(abs(c[k]["impact_hours"] - 0.82) < 1e-12 for k in c if k[0] == "o3")
    k = {x["outage_id"]: x for x in rows(R.impact_kpis(R.cascade_raw(out, route)))}
    assert k["o1"]["units_lost"] == 120 and k["o1"]["revenue_impact"] == 120 * 1200.0  # source value, not the starved one
    assert k["o3"]["units_lost"] == round(0.82 * (38 + 28 + 11)) and k["o3"]["delivery_risk"] == "LOW"


def test_rebalance_pairs_properties(spark):
    """Outflow <= excess, inflow <= need, total moved = min(total excess, total need), pairs
    <= sources + targets - 1; equal start points and duplicate (sku, branch) rows."""
    net = spark.createDataFrame([
        ("S1", "B0", 50, 10, 2.0), ("S1", "B1", 0, 30, 2.0), ("S1", "B2", 5, 25, 2.0), ("S1", "B3", 40, 10, 2.0),
        ("S1", "B3", 0, 0, 2.0),  # duplicate row of B3 is summed
        ("S2", "B0", 0, 10, 1.0), ("S2", "B1", 100, 0, 1.0),  # need before excess in branch order
        ("S3", "B0", 5, 10, 1.0),  # need only: no pairs
    ], "sku string, branch_id string, available_stock int, safety_stock int, unit_cost double")
    p = rows(planning.rebalance_pairs(net), ["sku", "from_branch", "to_branch"])
    s1 = [(r["from_branch"], r["to_branch"], r["qty"]) for r in p if r["sku"] == "S1"]
    assert s1 == [("B0", "B1", 30), ("B0", "B2", 10), ("B3", "B2", 10)]  # excess 40 + 30, need 30 + 20
    assert [(r["from_branch"], r["to_branch"], r["qty"]) for r in p if r["sku"] == "S2"] == [("B1", "B0", 10)]
    assert not [r for r in p if r["sku"] == "S3"]
    assert p[0]["freight_cost"] == 3.0


def test_calibration_due_and_health_faults(spark):
    """Annual +365, Periodic +90, other +180; overdue vs as_of. P42: code kept only below 70."""
    from millrun.operators import field

    d = dt.date(2001, 1, 1)
    cals = spark.createDataFrame([("c1", "e", d, "Annual", "Pass"), ("c2", "e", d, "Periodic", "Pass"), ("c3", "e", d, "Initial", "Fail")],
                                 "cal_id string, equipment_id string, cal_date date, cal_type string, cal_result string")
    r = {x["cal_id"]: x for x in rows(field.calibration_due(cals, "2001-06-01"))}
    assert r["c1"]["next_due_date"] == dt.date(2002, 1, 1) and r["c1"]["overdue"] is False
    assert r["c2"]["next_due_date"] == dt.date(2001, 4, 1) and r["c2"]["overdue"] is True and r["c2"]["days_to_due"] == -61
    assert r["c3"]["next_due_date"] == dt.date(2001, 6, 30)
    ts = dt.datetime(2024, 1, 1)
    h = spark.createDataFrame([("h1", "e", ts, 69.9, "FC-001"), ("h2", "e", ts, 70.0, "FC-002"), ("h3", "e", ts, 50.0, None)],
                              "health_id string, equipment_id string, snapshot_ts timestamp, overall_health_score double, fault_code string")
    f = {x["health_id"]: x for x in rows(field.health_faults(h))}
    assert f["h1"]["fault_code"] == "FC-001" and f["h1"]["fault_description"] == "High bearing temperature"
    assert f["h2"]["fault_code"] is None and f["h2"]["code_valid"] is False  # score exactly 70 is not below 70
    assert f["h3"]["code_valid"] is True and f["h3"]["fault_description"] is None


def test_latest_overlay_and_pages(spark):
    """The newest enhancement wins; an override other than PASS / FAIL is ignored; no
    enhancement keeps the machine result. S4/S5: pages and recent rows are newest first."""
    t0 = dt.datetime(2024, 1, 1)
    rd = spark.createDataFrame([(1, "M-1", t0, "FAIL"), (2, "M-1", t0 + dt.timedelta(hours=1), "PASS"), (3, "M-2", t0, "FAIL")],
                               "reading_id bigint, machine_id string, recorded_at timestamp, result_raw string")
    en = spark.createDataFrame([
        (10, 1, "M-1", 1, '{"result": "FAIL"}', 3, t0), (11, 1, "M-1", 1, '{"result": "PASS"}', 3, t0 + dt.timedelta(minutes=5)),
        (20, 2, "M-1", 1, '{"result": "MAYBE"}', 3, t0),
    ], "id bigint, bronze_reading_id bigint, machine_id string, technician_id int, override_values string, confidence_in_data int, created_at timestamp")
    r = {x["reading_id"]: x for x in rows(lab.latest_overlay(rd, en))}
    assert r[1]["enhancement_id"] == 11 and r[1]["effective_result"] == "PASS" and r[1]["enhancements"] == 2
    assert r[2]["override_result"] is None and r[2]["effective_result"] == "PASS"
    assert r[3]["enhancement_id"] is None and r[3]["enhancements"] == 0 and r[3]["effective_result"] == "FAIL"
    assert [x["reading_id"] for x in lab.readings_page(rd, 2, 1).collect()] == [3, 1]  # ties on time: id desc
    assert [x["reading_id"] for x in lab.readings_page(rd, 5, before=(t0 + dt.timedelta(hours=1), 2)).collect()] == [3, 1]
    assert [x["reading_id"] for x in lab.recent_across(rd, 1).collect()] == [2]


def test_chosen_scan_partitions_and_pruning(spark, sf_dir):
    """A scan is dealt out only where the caller says so; filters and column pruning still reach it."""
    from millrun.sources import tables as T

    plain = T.read_table(spark, sf_dir, "lineitem")
    assert "Repartition" not in plain._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("millrun.scanPartitions", "lineitem=3,events=2")
    try:
        wide = T.read_table(spark, sf_dir, "lineitem")
    finally:
        spark.conf.unset("millrun.scanPartitions")
    assert wide.rdd.getNumPartitions() == 3
    q = wide.filter(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    ref = plain.filter(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, ref.collect()))


def test_unknown_supplier_is_not_high_risk(spark):
    from millrun.operators import commercial

    df = spark.createDataFrame([(None, 10.0), (20.0, 5.0), (35.0, 3.0), (90.0, 2.0)], "on_time_pct double, spend_usd double")
    assert commercial.value_at_risk(df).first().asDict() == {"high_risk_suppliers": 1, "value_at_risk_usd": 8.0}


def test_cosine_of_zero_vector_is_null(spark):
    from millrun.functions.similarity import cosine

    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0]


def test_no_local_scratch_on_a_cluster():
    from types import SimpleNamespace as N

    from millrun.session import ensure_checkpoint_dir

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        fake = N(conf=N(get=lambda *a: None), sparkContext=N(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(fake)


def test_chunk_udtf_matches_builtin(spark, sf_dir):
    """T2 UDTF form gives exactly the built-in chunks over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = text.chunk_documents(docs, "doc_id", "text")
    b = text.chunk_documents_udtf(docs, "doc_id", "text")
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ordinal_within_null_group(spark):
    """Rows of a null group are numbered like any group's, also where only part of the key is null."""
    from millrun.operators.ordinals import ordinal_within

    rows = [(g, h, k) for k, (g, h) in enumerate([(None, 1), (1, None), (None, None), (1, 1)] * 5)]
    df = spark.createDataFrame(rows, "g int, h int, k int")
    want = df.withColumn("ix", F.row_number().over(Window.partitionBy("g", "h").orderBy("k")) - 1)
    got = ordinal_within(df, ["g", "h"], ["k"], "ix")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 20


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ordinal_within_hot_group(spark, adaptive, tmp_path):
    """Skew-proof ordinals equal row_number - 1 per group over a million rows with payload columns, two
    thirds of them in one group that spans several slices; written out, no row is lost."""
    from pyspark.sql import Window

    from millrun.operators.ordinals import ordinal_within

    n = 1_000_000
    group = F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string")))
    df = spark.range(n).select(
        group.alias("g"), (F.col("id") * 7919 % 9973).alias("o"), F.col("id").alias("k"),
        F.sha1(F.col("id").cast("string")).alias("a"), F.repeat(F.col("id").cast("string"), 3).alias("b"),
    )
    key = "spark.sql.adaptive.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, adaptive)
    try:
        ordinal_within(df, ["g"], ["o", "k"], "ix").write.parquet(f"{tmp_path}/out")
        got = spark.read.parquet(f"{tmp_path}/out")
        ref = df.withColumn("ix", (F.row_number().over(Window.partitionBy("g").orderBy("o", "k")) - 1).cast("int"))
        assert got.count() == n
        assert got.join(ref, ["g", "o", "k", "a", "b", "ix"], "left_semi").count() == n
    finally:
        spark.conf.set(key, old)


def test_pareto_shares_sum_to_100(spark, sf_dir):
    """SURVEY §5 property: downtime Pareto shares sum to 100 within rounding (one 0.05 per reason),
    and the cumulative share ends at that sum."""
    import __spark_entry__ as entry

    qs = entry.queries()
    p = rows(qs["downtime_pareto"](spark, sf_dir))
    assert p and abs(sum(r["pct"] for r in p) - 100.0) <= 0.05 * len(p) + 1e-9
    c = rows(qs["pareto_cumulative"](spark, sf_dir))
    assert c and max(r[k] for r in c for k in r if "cum" in k) <= 100.0 + 0.05 * len(c) + 1e-9


def _brute_pairs(rows_in):
    """Reference O4 pairing by explicit interval walks (plain Python on a tiny fixture)."""
    agg = {}
    for sku, br, st, sf, cost in rows_in:
        a = agg.setdefault((sku, br), [0, 0, cost])
        a[0] += st
        a[1] += sf
        a[2] = min(a[2], cost)
    out = {}
    for sku in sorted({k[0] for k in agg}):
        brs = sorted(b for s, b in agg if s == sku)
        src = [(b, max(agg[(sku, b)][0] - agg[(sku, b)][1], 0)) for b in brs]
        dst = [(b, max(agg[(sku, b)][1] - agg[(sku, b)][0], 0)) for b in brs]
        src, dst = [x for x in src if x[1] > 0], [x for x in dst if x[1] > 0]
        i = j = 0
        rem_s = src[0][1] if src else 0
        rem_d = dst[0][1] if dst else 0
        while i < len(src) and j < len(dst):
            q = min(rem_s, rem_d)
            out[(sku, src[i][0], dst[j][0])] = out.get((sku, src[i][0], dst[j][0]), 0) + q
            rem_s -= q
            rem_d -= q
            if rem_s == 0:
                i += 1
                rem_s = src[i][1] if i < len(src) else 0
            if rem_d == 0:
                j += 1
                rem_d = dst[j][1] if j < len(dst) else 0
    return out


def test_rebalance_pairs_against_brute_force(spark):
    """O4 equals an explicit two-pointer walk over the excess and need intervals on random networks."""
    import random

    rnd = random.Random(7)
    data = [(f"S{rnd.randint(0, 4)}", f"B{rnd.randint(0, 6)}", rnd.randint(0, 60), rnd.randint(0, 60), 1.0)
            for _ in range(120)]
    net = spark.createDataFrame(data, "sku string, branch_id string, available_stock int, safety_stock int, unit_cost double")
    got = {(r["sku"], r["from_branch"], r["to_branch"]): r["qty"] for r in rows(planning.rebalance_pairs(net))}
    assert got == _brute_pairs(data)


def test_partitioned_roundtrip_is_idempotent(spark, sf_dir):
    """IO5: a rerun overwrites only the days it writes (dynamic partition overwrite), so running the
    round trip twice gives the same result and prunes to the last seven days."""
    import __spark_entry__ as entry

    q = entry.queries()["io_partitioned_roundtrip"]
    first = sorted(map(tuple, q(spark, sf_dir).collect()))
    second = q(spark, sf_dir)
    assert sorted(map(tuple, second.collect())) == first and first
    assert "PartitionFilters: [isnotnull(reading_date" in second._jdf.queryExecution().executedPlan().toString()


def test_state_duration_stream_out_of_order(spark, sf_dir):
    """ST3 equals the batch answer when files arrive interleaved, and when the newest arrive first."""
    from millrun.plans.catalog import QUERIES
    from millrun.streaming import jobs as J

    ev = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    cols = ["event_id", "machine_id", "event_ts", "state", "next_event_ts", "duration_minutes", "downtime_category"]
    want = sorted(map(str, QUERIES["state_events_silver"](spark, sf_dir).select(*cols).collect()))
    late = F.lit(3) - F.ntile(3).over(Window.orderBy("ts", "event_id"))
    for part in (F.col("event_id") % 3, late):
        d = tempfile.mkdtemp(prefix="millrun-late-")
        for i, name in enumerate("abc"):
            ev.withColumn("_p", part).where(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(os.path.join(d, name))
        st = J.StreamTables(spark, sf_dir)
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "*"))
        st.__dict__["events"] = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        got = J.state_duration_stream(st, watermark="4000 days").select(*cols)
        assert sorted(map(str, got.collect())) == want


def test_make_buy_decisions(spark):
    """dearer or unknown -> Buy, clearly cheaper -> Make, little cheaper or a full plant -> Hybrid."""
    items = [("a", "p", 10.0, 1), ("b", "p", 10.0, 1), ("c", "p", 10.0, 1), ("d", "p", 10.0, 1), ("a", "q", 10.0, 9), ("b", "q", 10.0, 1)]
    lines = spark.createDataFrame(items, "material_number string, plant string, unit_price double, ordered_quantity int")
    costs = spark.createDataFrame([("a", 5.0), ("b", 9.8), ("c", 10.1)], "material_number string, internal_cost double")
    got = {(r["material_number"], r["plant"]): r["decision"] for r in rows(commercial.make_buy(lines, costs))}
    assert got == {("a", "p"): "Make", ("b", "p"): "Hybrid", ("c", "p"): "Buy", ("d", "p"): "Buy", ("a", "q"): "Hybrid", ("b", "q"): "Hybrid"}


def test_days_of_supply_rate_and_floor(spark):
    """Demand of the last 365 days only; under 7 days of it is a stockout; no demand is excess."""
    inv = spark.createDataFrame([("a", 6), ("b", 20), ("c", 60), ("d", 91), ("e", 0), ("f", 5)], "material_number string, unrestricted_stock int")
    sold = [(m, 365, "2001-06-01") for m in "abcde"] + [("f", 365, "2000-11-30"), ("a", 9999, "2000-12-01"), ("b", 9999, "2025-02-30")]
    orders = spark.createDataFrame(sold, "material_number string, order_quantity int, order_date string")
    got = {r["material_number"]: r for r in rows(planning.days_of_supply(inv, orders, "2001-12-01"))}
    assert {k: r["health"] for k, r in got.items()} == {
        "a": "stockout", "b": "at_risk", "c": "optimal", "d": "excess", "e": "stockout", "f": "excess"}
    assert got["a"]["days_of_supply"] == 6.0 and got["a"]["annual_demand"] == 365 and got["f"]["days_of_supply"] is None


def test_exception_values_and_optional_filters(spark):
    """USD only from lines that carry a price. P32: lists match any value, None is no filter."""
    dl = spark.createDataFrame([("Late", None, dt.date(2020, 1, 1), 3), ("Pending", dt.date(2020, 1, 2), None, 4), ("On Time", None, None, 9)],
                               "delivery_status string, planned_delivery_date date, actual_delivery_date date, delivered_quantity int")
    ol = spark.createDataFrame([(True, "2020-01-01", 2, 10.5), (False, "2020-01-01", 7, 99.0)],
                               "is_rejected boolean, order_date string, order_quantity int, net_value_usd double")
    got = {r["exception_type"]: r for r in rows(commercial.exception_summary(dl, ol, "2020-01-11"))}
    assert (got["late_delivery"]["units"], got["late_delivery"]["value_usd"], got["late_delivery"]["avg_age_days"]) == (3, None, 10.0)
    assert (got["pending_delivery"]["units"], got["rejected_line"]["units"], got["rejected_line"]["value_usd"]) == (4, 2, 10.5)
    assert P.dynamic_filter(dl, delivery_status=["Late", "Pending"], delivered_quantity=None).count() == 2
    assert P.dynamic_filter(dl, delivery_status="Late", delivered_quantity=4).count() == 0
    assert P.dynamic_filter(dl).count() == 3


def test_delivery_kpis_count_distinct_across_documents(spark):
    """One delivery of two lines and one without a header; a material of both counts once."""
    lips = spark.createDataFrame([("1", "1", "m", 5, "EA"), ("1", "2", "n", 6, "EA"), ("2", "1", "m", 7, "EA")],
                                 "vbeln string, posnr string, matnr string, lfimg int, vrkme string")
    likp = spark.createDataFrame([("1", "c", "2020-01-10", "2020-01-13", "x")],
                                 "vbeln string, kunnr string, lfdat string, wadat_ist string, tragr string")
    r = rows(erp.kpi_delivery(erp.delivery_lines(lips, likp)))[0]
    assert r == {"total_deliveries": 2, "total_delivery_lines": 3, "total_units_delivered": 18, "unique_customers": 1,
                 "unique_materials_delivered": 2, "on_time_delivery_rate_pct": 0.0, "avg_delivery_variance_days": 3.0}


def test_spread_deals_by_rows_where_the_session_has_fewer_tasks(spark):
    from millrun.session import spread

    df = spark.range(1000).select(F.col("id").cast("string").alias("vbeln"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = spread(df, "vbeln", rows_a_task=1000 // (4 * n))
    assert wide.rdd.getNumPartitions() >= 4 * n and wide.count() == 1000
    assert spread(df, "vbeln", rows_a_task=1000) is df


def test_demand_monthly_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    """A task of the join and the distinct count gets a stated number of rows, however few tasks the session's shuffles have."""
    import datetime

    from millrun import session
    from millrun.plans.catalog import QUERIES

    day = datetime.datetime(1998, 5, 3)
    lines = [(i // 3, i % 7, 1, 1, 2.0, 1.0, "N", day) for i in range(600)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i, "O", 1.0, day, "1") for i in range(1, 200)], "o_orderkey long, o_custkey long, o_orderstatus string, "
                          "o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(session.spread, "__kwdefaults__", {"rows_a_task": 10})
    got = QUERIES["demand_monthly"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    kept = [x for x in lines if x[0] in range(1, 200) and x[0] % 31]
    assert {(r.material_number, r.actual_qty, r.order_count) for r in got.collect()} == {
        (str(m), 2 * sum(x[1] == m for x in kept), len({x[0] for x in kept if x[1] == m})) for m in range(7)}


def test_ordinal_within_joins_only_the_offsets_above_zero(spark):
    """Groups over several slices, a null group among them: numbered as by a window, and no shuffle join of the rows."""
    from pyspark.sql import Window

    from millrun.operators.ordinals import ordinal_within

    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    got = ordinal_within(df, ["g"], ["k"], "ix")
    want = df.withColumn("ix", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert sorted(map(str, got.select("g", "k", "ix").collect())) == sorted(map(str, want.select("g", "k", "ix").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    many = ordinal_within(df, ["g"], ["k"], "ix", rows=250_000 * 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, many.select("g", "k", "ix").collect())) == sorted(map(str, want.select("g", "k", "ix").collect()))

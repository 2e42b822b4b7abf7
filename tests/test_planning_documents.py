"""Transfer options, action life cycle, control tower records, documents, periods and quantiles on small cases and against brute force."""

import datetime as dt
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrun.operators import commercial as C
from millrun.operators import finance as FI
from millrun.operators import lab
from millrun.operators import planning as PL
from millrun.operators import quantiles as Q
from millrun.operators import reliability as R

T = dt.datetime


def as_rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- O2 options ---


def network(spark, rows):
    cols = "sku string, branch_id string, primary_origin string, location_type string, region string, product_category string, available_stock int, safety_stock int, unit_cost double, carrier_flag string"
    return spark.createDataFrame([(s, b, "x", kind, "FL", "cat", stock, safety, 2.0, "1") for s, b, kind, stock, safety in rows], cols)


def brute_plan(rows, protect, surplus):
    """Greedy in branch order: hubs fill needs one after the other, then the first spoke takes what is left."""
    out = {}
    for sku in {r[0] for r in rows}:
        hubs = sorted((b, max(0, stock - (safety if protect else 0))) for s, b, kind, stock, safety in rows if s == sku and kind == "HUB")
        spokes = sorted((b, max(0, safety - stock)) for s, b, kind, stock, safety in rows if s == sku and kind == "SPOKE")
        have = dict(hubs)
        got = dict.fromkeys((b for b, _ in spokes), 0)
        for b, need in spokes + ([(spokes[0][0], None)] if spokes and surplus else []):
            for h, _ in hubs:
                x = have[h] if need is None else min(have[h], need)
                have[h] -= x
                got[b] += x
                need = None if need is None else need - x
        out.update({(sku, h): have[h] - start for h, start in hubs})
        out.update({(sku, b): x for b, x in got.items()})
    return out


def test_transfer_options_against_greedy(spark):
    r = random.Random(3)
    rows = [("all-hubs", "h1", "HUB", 9, 1), ("all-spokes", "s1", "SPOKE", 0, 5)]
    for k in range(25):
        for b in range(r.randrange(1, 6)):
            rows.append((f"k{k}", f"b{b}", r.choice(["HUB", "SPOKE"]), r.randrange(0, 30), r.randrange(0, 30)))
    got = as_rows(PL.transfer_plan_options(network(spark, rows)))
    assert len(got) == 4 * len(rows)
    for protect, surplus in itertools.product((False, True), repeat=2):
        want = brute_plan(rows, protect, surplus)
        mine = {(g["SKU"], g["Branch_ID"]): g["Recommended_Stock_Shift"] for g in got if g["protect_hub_safety"] == protect and g["ship_surplus"] == surplus}
        assert mine == want
        one = PL.transfer_plan(network(spark, rows), protect_hub_safety=protect, ship_surplus=surplus)
        assert {(g["SKU"], g["Branch_ID"]): g["Recommended_Stock_Shift"] for g in as_rows(one)} == want
    assert PL.transfer_plan_options(network(spark, rows).limit(0)).count() == 0


# --- F5 ---


def test_action_life_cycle(spark):
    log = [
        (1, "a", "acknowledged", T(2024, 1, 1)), (2, "a", "done", T(2024, 1, 2)), (3, "a", "in_progress", T(2024, 1, 3)),  # closed holds
        (1, "b", "done", T(2024, 1, 1)), (2, "b", "reopened", T(2024, 1, 2)), (3, "b", "in_progress", T(2024, 1, 3)),
        (1, "c", "rejected", T(2024, 1, 1)), (2, "c", "reopened", T(2024, 1, 2)),
        (5, "d", "acknowledged", T(2024, 1, 1)), (6, "d", "in_progress", T(2024, 1, 1)),  # same time: the greater id
        (1, "e", "nonsense", T(2024, 1, 1)), (2, "e", "done", None),
        (1, "f", "done", T(2024, 1, 1)), (2, "f", "reopened", T(2024, 1, 2)), (3, "f", "rejected", T(2024, 1, 3)), (4, "f", "done", T(2024, 1, 4)),
        (1, None, "done", T(2024, 1, 1)), (1, "gone", "done", T(2024, 1, 1)),
    ]
    df = spark.createDataFrame(log, "entry_id bigint, action_id string, status string, changed_at timestamp").repartition(5)
    actions = spark.createDataFrame([(x,) for x in "abcdefg"], "action_id string")
    got = {g["action_id"]: (g["status"], g["n_changes"]) for g in as_rows(C.with_status(actions, df))}
    want = {"a": ("done", 3), "b": ("in_progress", 3), "c": ("pending", 2), "d": ("in_progress", 2), "e": ("pending", 0), "f": ("rejected", 4), "g": ("pending", 0)}
    assert got == want
    twice = {g["action_id"]: g["status"] for g in as_rows(C.with_status(actions, df.where("action_id = 'a'").unionByName(df.where("action_id = 'a'"))))}
    assert twice["a"] == "done"  # an entry that was written twice changes nothing
    assert {g["status"] for g in as_rows(C.with_status(actions, df.limit(0)))} == {"pending"}


def test_transfer_actions(spark):
    none = spark.createDataFrame([], "material_number string, health string, annual_demand bigint")
    mape = spark.createDataFrame([("c", 9.0)], "category string, mean_bias_pct double")
    score = spark.createDataFrame([], "supplier_number string, on_time_pct double, spend_usd double")
    lanes = spark.createDataFrame([("s", "a", "b", 10, 1500.0), ("s", "a", "c", 1, 2.5)], "sku string, from_branch string, to_branch string, qty bigint, unit_cost double")
    got = {g["action_id"]: g for g in as_rows(C.action_generation(none, mape, score, "2024-02-28", lanes))}
    assert set(got) == {"forecast_override:c", "lateral_transfer:s/a/b", "lateral_transfer:s/a/c"}
    a, b = got["lateral_transfer:s/a/b"], got["lateral_transfer:s/a/c"]
    assert (a["priority"], a["impact"], a["due_date"], a["status"]) == ("High", 15000.0, dt.date(2024, 3, 1), "pending")
    assert (b["priority"], b["impact"]) == ("Medium", 2.5)


# --- control tower ---


def test_control_tower_of_missing_tables_and_columns(spark):
    po = spark.createDataFrame([("1", None, 5, "x"), ("2", "V", None, "y")], "EBELN string, lifnr string, menge int, extra string")
    stock = spark.createDataFrame([("m", 7)], "material string, unrestricted int")
    got = as_rows(C.control_tower_payload({"procurement": po, "inventory": stock, "demand": None}))
    docs = {(g["record_set"], i): json.loads(g["payload"]) for i, g in enumerate(got)}
    assert {k[0] for k in docs} == {"procurement", "inventory"} and len(docs) == 3
    first = next(d for (s, _), d in docs.items() if s == "procurement" and d["po"] == "1")
    assert first == {"po": "1", "vendor": "", "vendorName": "", "material": "", "qty": 5, "value": 0.0, "status": "Open", "delivery": ""}
    second = next(d for (s, _), d in docs.items() if s == "procurement" and d["po"] == "2")
    assert second["qty"] == 0 and second["vendorName"] == "V"
    assert next(d for (s, _), d in docs.items() if s == "inventory") == {
        "material": "m", "plant": "", "storageLoc": "", "unrestricted": 7, "blocked": 0, "inTransit": 0, "reorderPoint": 0}
    assert list(json.loads(got[0]["payload"])) == [f[0] for f in C.CONTROL_TOWER[got[0]["record_set"]]]


# --- J16 ---


def test_documents_with_empty_levels(spark):
    procedures = spark.createDataFrame([(1, "P1", "pump"), (2, "P2", None)], "id int, name string, product_type string")
    sections = spark.createDataFrame([(12, 1, 2, "B", "auto"), (11, 1, 1, "A", None)], "id int, procedure_id int, order_index int, title string, section_type string")
    steps = spark.createDataFrame([(102, 12, 2, "text", "s2", False), (101, 12, 1, "number", "s1", True)],
                                  "id int, section_id int, order_index int, step_type string, label string, is_mandatory boolean")
    got = {g["procedure_id"]: g for g in as_rows(lab.procedure_documents(procedures, sections, steps))}
    doc = json.loads(got[1]["document"])
    assert [s["title"] for s in doc["sections"]] == ["A", "B"] and doc["sections"][0]["steps"] == []
    assert [s["label"] for s in doc["sections"][1]["steps"]] == ["s1", "s2"] and (got[1]["n_sections"], got[1]["n_steps"]) == (2, 2)
    assert json.loads(got[2]["document"]) == {"id": 2, "name": "P2", "product_type": None, "sections": []} and got[2]["n_steps"] == 0
    runs = spark.createDataFrame([(7, 1, "completed"), (8, 2, "failed"), (9, 99, "failed")], "id bigint, procedure_id int, status string")
    responses = spark.createDataFrame([("r1", 7, 102, "old", T(2024, 1, 1)), ("r2", 7, 102, "new", T(2024, 1, 2)), ("r3", 7, 101, "1", T(2024, 1, 1))] * 2,
                                      "id string, run_id bigint, step_id int, value string, created_at timestamp")
    got = {g["run_id"]: g for g in as_rows(lab.run_documents(runs, procedures, sections, steps, responses))}
    assert set(got) == {7, 8} and got[7]["n_responses"] == 6 and got[8]["n_responses"] == 0
    doc = json.loads(got[7]["document"])
    assert doc["responses"] == [{"step_id": 101, "value": "1"}, {"step_id": 102, "value": "new"}] and len(doc["sections"]) == 2
    assert json.loads(got[8]["document"])["responses"] == [] and json.loads(got[8]["document"])["sections"] == []


def test_run_totals_without_runs(spark):
    runs = spark.createDataFrame([(1, "completed", T(2020, 1, 1))], "id int, status string, created_at timestamp")
    assert as_rows(lab.test_run_totals(runs, "2024-01-01")) == [{"total": 0, "passed": 0, "failed": 0, "pass_rate": None}]


# --- P43 + P44 ---


def test_fiscal_calendar_of_other_years(spark):
    cal = FI.fiscal_calendar(spark, "2023-09-15", "2024-12-31", start_month=10)
    keys = {g["month"]: g["period_key"] for g in as_rows(cal)}
    assert keys[dt.date(2023, 9, 1)] == "FY2023-Q4" and keys[dt.date(2023, 10, 1)] == "FY2024-Q1" and keys[dt.date(2024, 9, 1)] == "FY2024-Q4"
    got = {}
    for g in as_rows(FI.period_selections(cal, "2024-02-10")):
        got.setdefault(g["selection"], set()).add(g["period_key"])
    assert got["this_quarter"] == {"FY2024-Q2"} and got["last_quarter"] == {"FY2024-Q1"} == got["q1"] and got["q2"] == {"FY2024-Q2"}
    assert got["ytd"] == {"FY2024-Q1", "FY2024-Q2"} and got["last_year"] == {"FY2023-Q4"} and len(got["all"]) == 6
    before = FI.period_selections(cal, "2020-01-01").where("selection <> 'all'")
    assert before.count() == 0


def test_costs_add_up_over_units_and_types(spark):
    costs = spark.createDataFrame([("AMERICA", "Operations", "FY2024-Q1", 5.0), ("AMERICA", "Research", "FY2024-Q1", 7.0), (None, "Corporate", "FY2024-Q1", 1.0)],
                                  "region string, department string, period_key string, cost double")
    sel = spark.createDataFrame([("s", "FY2024-Q1"), ("other", "FY2023-Q1")], "selection string, period_key string")
    got = {(g["unit"], g["cost_type"]): g["cost"] for g in as_rows(FI.cost_by_organisation(costs, sel))}
    assert got == {("amer", "opex"): 5.0, ("amer", None): 7.0, (None, "ga"): 1.0}


# --- A46 ---


def test_utilisation_and_bands(spark):
    positions = spark.createDataFrame([("p", "m1", 30), ("p", "m1", 30), ("p", "m2", 0), ("q", "m3", 10)], "plant string, material_number string, total_stock int")
    dos = spark.createDataFrame([("m1", 60, 365, "optimal"), ("m2", 0, 10, "stockout")], "material_number string, stock bigint, annual_demand bigint, health string")
    cap = spark.createDataFrame([("p", 120), ("r", 5)], "plant string, capacity_units bigint")
    got = {g["plant"]: g for g in as_rows(PL.dc_utilization(positions, cap, dos))}
    assert set(got) == {"p", "q"} and got["p"]["utilization_pct"] == 50.0 and got["q"]["utilization_pct"] is None
    assert (got["p"]["skus"], got["p"]["optimal_skus"], got["p"]["stockout_skus"], got["q"]["optimal_skus"]) == (1, 1, 1, 0)
    cats = spark.createDataFrame([("m1", "a", 2.0), ("m2", "b", 1.0)], "material_number string, category string, unit_value double")
    bands = spark.createDataFrame([("a", 10, 60)], "category string, lo int, hi int")
    got = {g["category"]: g for g in as_rows(PL.category_days_of_supply(dos, cats, bands))}
    assert (got["a"]["days_of_supply"], got["a"]["position"], got["a"]["value"]) == (60.0, "in", 120.0)
    assert got["b"]["days_of_supply"] == 0.0 and got["b"]["position"] is None


# --- quantiles ---


@pytest.mark.parametrize("accuracy", [20, 100])
@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantile_is_exact(spark, q, accuracy):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(0, 1, 4000).round(2)] + [("ties", 1.0)] * 700 + [("ties", 2.0)] * 700
    rows += [("few", float(v)) for v in range(5)] + [(None, float(v)) for v in rng.integers(0, 50, 900)] + [("nothing", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r["x"] for r in as_rows(Q.quantile(df, ["g"], "v", q, "x", accuracy))}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, q), abs=1e-12)
    every = as_rows(Q.quantile(df, [], "v", q, "x", accuracy))
    assert every == [{"x": pytest.approx(np.quantile([v for _, v in rows if v is not None], q), abs=1e-12)}]


def test_sketch_keeps_its_rank_error(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.exponential(5, 30_000), rng.normal(100, 1, 10_000)])
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(v)], "v double").repartition(12)
    shares = [0.01, 0.25, 0.5, 0.9, 0.99]
    row = Q.sketch_quantiles(df, [], "v", shares, accuracy=200).first()
    for s, x in zip(shares, row.sketch, strict=True):
        assert abs((v <= x).mean() - s) <= 1 / 200 + 1 / len(v)


def test_quantile_of_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert Q.quantile(df, ["g"], "v", 0.5, "x").count() == 0


# --- W12 ---


def test_driving_sensor_above_and_below(spark):
    hours = [T(2024, 1, 1, h) for h in range(24)]
    rows = []
    for i, t in enumerate(hours):
        rows.append(("up", t, 50.0 + i / 2, 5.0 - i / 10, 0))       # temp at 61.5 of 62 in 1 h; pressure 2.7 -> 1.8 in 9 h
        rows.append(("down", t, 20.0, 3.0 - i / 20, 0))             # pressure 1.85 -> 1.8 in 1 h
        rows.append(("beyond", t, 70.0, 9.0, 5 if i == 23 else 0))  # temp beyond already, and the last fault count too
        rows.append(("still", t, 20.0, 9.0, None))
    rows.append(("single", hours[3], 61.0, 9.0, 0))
    rows.append(("old", T(2023, 1, 1), 99.0, 0.0, 9))
    f = spark.createDataFrame(rows, "machine_id string, ts timestamp, temp_c double, oil_pressure_bar double, fault_count_7d int")
    limits = (("temp_c", 62.0, "above"), ("oil_pressure_bar", 1.8, "below"), ("fault_count_7d", 4.0, "above"))
    trends = R.sensor_trends(f, "2024-01-02", limits)
    got = {g["machine_id"]: g for g in as_rows(R.driving_sensor(trends))}
    assert set(got) == {"up", "down", "beyond", "still", "single"}
    assert (got["up"]["sensor"], got["up"]["direction"], got["up"]["hours_to_threshold"], got["up"]["slope_per_hour"]) == ("temp_c", "above", 1.0, 0.5)
    assert (got["down"]["sensor"], got["down"]["direction"], got["down"]["hours_to_threshold"]) == ("oil_pressure_bar", "below", 1.0)
    assert (got["beyond"]["sensor"], got["beyond"]["hours_to_threshold"], got["beyond"]["sensors_in_breach"]) == ("fault_count_7d", 0.0, 2)
    assert got["still"]["hours_to_threshold"] is None and got["still"]["sensors_in_breach"] == 0
    assert got["single"]["hours_to_threshold"] is None
    by = {(g["machine_id"], g["sensor"]): g for g in as_rows(trends)}
    assert ("still", "fault_count_7d") not in by and by[("up", "oil_pressure_bar")]["hours_to_threshold"] == 9.0
    assert by[("beyond", "temp_c")]["breaches"] == 24

"""Bindings: the given test tables -> the domain inputs the operators read (FIXTURES.md §2).

This module is the only place that knows TPC-H-style column names. Every binding is a
projection (plus, for a few dimensions, an aggregation) of the given tables, so the work of
every downstream operator grows with the data. The DuckDB oracle re-states the same bindings
in SQL (``millrun.plans.oracle``); the two must stay in step.

Fixed values that define the bindings (clock, modulus choices, code lists) are stated once,
here, together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrun.sources.tables import Tables

# ---- fixed values of the bindings -------------------------------------------------------
AS_OF_EVENTS = "2024-01-31 00:00:00"  # clock for plant / lab / engagement data
AS_OF_ORDERS = "2001-12-01"  # clock for ERP data
N_MACHINES = 18  # machine ids M-0 .. M-17 (user_id mod 18)
MISSING_MACHINE = "M-17"  # left out of the master so inner and left joins differ
LINES = ("A", "B", "C")  # line = LINES[machine number mod 3]
DEFECT_TYPES = (  # by l_partkey mod 6; the last maps to "Other"
    "Solder Bridge",
    "Bond Wire Short",
    "Misaligned Part",
    "Contamination",
    "Missing Component",
    "Cosmetic Scratch",
)
# ------------------------------------------------------------------------------------------


def dtext(c: Column | str) -> Column:
    """Date as ``yyyy-MM-dd`` text, the ERP storage format."""
    return F.date_format(c, "yyyy-MM-dd")


def s(c: Column | str) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def props_k(col: str = "props") -> Column:
    """The integer ``k`` of the events ``props`` JSON text ``{"k": n}``."""
    return F.regexp_extract(F.col(col), r"([0-9]+)", 1).cast("int")


def machine_of(num: Column) -> Column:
    return F.concat(F.lit("M-"), num.cast("string"))


def line_of(num: Column) -> Column:
    m = num % 3
    return F.when(m == 0, F.lit(LINES[0])).when(m == 1, F.lit(LINES[1])).otherwise(F.lit(LINES[2]))


# ---- ERP (SAP-style) ----------------------------------------------------------------------


def ekko(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        s("o_orderkey").alias("ebeln"),
        s(F.col("o_custkey") % 3).alias("bukrs"),
        F.concat(F.lit("V-"), s(F.col("o_custkey") % 100)).alias("lifnr"),
        F.lit("F").alias("bstyp"),
        F.col("o_orderpriority").alias("bsart"),
        dtext("o_orderdate").alias("aedat"),
    )


def ekpo(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(
        s("l_orderkey").alias("ebeln"),
        s("l_linenumber").alias("ebelp"),
        s("l_partkey").alias("matnr"),
        F.col("l_quantity").cast("int").alias("menge"),
        F.lit("EA").alias("meins"),
        F.col("l_extendedprice").alias("netwr"),
        F.concat(F.lit("P"), s(F.col("l_suppkey") % 5)).alias("werks"),
        F.concat(F.lit("L"), s("l_linenumber")).alias("lgort"),
        dtext("l_shipdate").alias("eindt"),
    )


def vbak(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        s("o_orderkey").alias("vbeln"),
        F.concat(F.lit("S"), s(F.col("o_custkey") % 4)).alias("vkorg"),
        F.lit("10").alias("vtweg"),
        F.lit("00").alias("spart"),
        s("o_custkey").alias("kunnr"),
        F.when(F.col("o_orderkey") % 31 == 0, F.lit("2025-02-30")).otherwise(dtext("o_orderdate")).alias("audat"),
        F.col("o_orderpriority").alias("auart"),
    )


def vbap(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(
        s("l_orderkey").alias("vbeln"),
        s("l_linenumber").alias("posnr"),
        s("l_partkey").alias("matnr"),
        F.col("l_quantity").cast("int").alias("kwmeng"),
        F.lit("EA").alias("vrkme"),
        F.col("l_extendedprice").alias("netwr"),
        dtext("l_shipdate").alias("edatu"),
        F.when(F.col("l_returnflag") == "N", F.lit("")).when(F.col("l_returnflag") == "R", F.lit("R")).alias("absta"),
    )


def likp(t: Tables) -> DataFrame:
    o = t.orders
    d = F.to_date("o_orderdate")
    return o.select(
        s("o_orderkey").alias("vbeln"),
        s("o_custkey").alias("kunnr"),
        F.when(F.col("o_orderkey") % 29 == 0, F.lit(None).cast("string")).otherwise(dtext(F.date_add(d, 30))).alias("lfdat"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("string"))
        .otherwise(dtext(F.date_add(d, (F.col("o_orderkey") % 60).cast("int"))))
        .alias("wadat_ist"),
        F.col("o_orderpriority").alias("tragr"),
    )


def lips(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(
        s("l_orderkey").alias("vbeln"),
        s("l_linenumber").alias("posnr"),
        s("l_partkey").alias("matnr"),
        F.col("l_quantity").cast("int").alias("lfimg"),
        F.lit("EA").alias("vrkme"),
    )


def mard(t: Tables) -> DataFrame:
    """Stock per material x plant x storage location, aggregated from lineitem (map-side partial agg)."""
    li = t.lineitem
    q = F.col("l_quantity").cast("int")
    flag = F.col("l_returnflag")
    agg = li.groupBy(
        F.col("l_partkey"),
        (F.col("l_suppkey") % 3).alias("plant_no"),
        F.col("l_linenumber"),
    ).agg(
        F.sum(F.when(flag == "N", q).otherwise(0)).cast("int").alias("labst"),
        F.sum(F.when(flag == "A", q).otherwise(0)).cast("int").alias("speme"),
        F.sum(F.when(flag == "R", q).otherwise(0)).cast("int").alias("insme"),
    )
    # part is joined after the aggregate: the join key is the group key, so the shuffle is shared.
    return agg.join(t.part.select("p_partkey", "p_size"), agg.l_partkey == F.col("p_partkey"), "left").select(
        s("l_partkey").alias("matnr"),
        F.concat(F.lit("P"), s("plant_no")).alias("werks"),
        F.concat(F.lit("L"), s("l_linenumber")).alias("lgort"),
        "labst",
        "speme",
        "insme",
        F.col("p_size").alias("eisbe"),
    )


# ---- Plant (QAD-style work orders / job tickets / downtime) ---------------------------------


def wo_mst(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        s("o_orderkey").alias("wono"),
        F.concat(F.lit("S"), s(F.col("o_custkey") % 3)).alias("site"),
        F.concat(F.lit("MC"), s(F.col("o_custkey") % 5)).alias("line"),
        F.concat(F.lit("PART-"), s(F.col("o_custkey") % 50)).alias("part"),
        (F.col("o_orderkey") % 100 + 1).cast("int").alias("qty_ord"),
        F.col("o_orderstatus").alias("ord_status"),
        F.col("o_orderdate").alias("start_date"),
        F.timestamp_seconds(F.unix_timestamp("o_orderdate") + 30 * 86400).alias("due_date"),
        F.col("o_orderdate").alias("cr_date"),
    )


def jt_mst(t: Tables) -> DataFrame:
    li = t.lineitem
    start = F.unix_timestamp("l_shipdate") + (F.col("l_partkey") % 24) * 3600
    return li.select(
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("ticket_id"),
        s("l_orderkey").alias("wono"),
        F.concat(F.lit("S"), s(F.col("l_suppkey") % 3)).alias("site"),
        F.concat(F.lit("MC"), s(F.col("l_suppkey") % 5)).alias("line"),
        F.col("l_quantity").cast("int").alias("good_qty"),
        (F.col("l_linenumber") % 3).cast("int").alias("scrap_qty"),
        F.timestamp_seconds(start).alias("start_ts"),
        F.timestamp_seconds(start + F.col("l_quantity").cast("bigint") * 600).alias("end_ts"),
    )


def dt_mst(t: Tables) -> DataFrame:
    e = t.events.filter(F.col("event_type") == "error")
    k = props_k()
    return e.select(
        s("event_id").alias("event_id"),
        F.concat(F.lit("S"), s(F.col("user_id") % 3)).alias("site"),
        F.concat(F.lit("MC"), s(F.col("user_id") % 5)).alias("line"),
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_interval(mins=F.floor("value").cast("int"))).alias("end_ts"),
        F.concat(F.lit("R"), s(k % 7)).alias("reason_code"),
        F.when(k % 7 == 0, F.lit("Planned Maintenance")).otherwise(F.lit("Unplanned Stop")).alias("reason_desc"),
    )


# ---- Manufacturing medallion (raw landing tables) ------------------------------------------


def machine_telemetry_raw(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        machine_of(F.col("user_id") % N_MACHINES).alias("machine_id"),
        F.date_trunc("hour", "ts").alias("ts"),
        F.col("value").alias("oee_pct"),
        (F.col("value") - 20).alias("temp_c"),
        (props_k() / 10.0).alias("cycle_time_sec"),
        (F.col("value") * 0.08).alias("power_kw"),
        (F.col("event_id") % 1000).cast("int").alias("units_count"),
        F.col("ts").alias("ingest_ts"),
    )


def production_events_raw(t: Tables) -> DataFrame:
    e = t.events
    k = props_k()
    et = F.col("event_type")
    state = (
        F.when(et == "error", F.lit("fault"))
        .when(et == "signup", F.lit("idle"))
        .when(et == "purchase", F.lit("maintenance"))
        .otherwise(F.lit("running"))
    )
    return e.select(
        s("event_id").alias("event_id"),
        machine_of(F.col("user_id") % N_MACHINES).alias("machine_id"),
        F.col("ts").alias("event_ts"),
        state.alias("state"),
        F.when(et == "error", F.concat(F.lit("E-"), s(k))).alias("fault_code"),
        F.when(et == "error", F.lit("fault reported")).alias("fault_msg"),
        F.when(et == "signup", F.when(k % 2 == 0, F.lit("firmware hold")).otherwise(F.lit("wait"))).alias("idle_reason"),
        F.when(et == "purchase", F.lit("preventive")).alias("maintenance_type"),
        F.concat(F.lit("OP-"), s(F.col("user_id") % 7)).alias("operator_id"),
        F.col("ts").alias("ingest_ts"),
    )


def alarm_events_raw(t: Tables) -> DataFrame:
    e = t.events.filter(F.col("event_type") == "error")
    k = props_k()
    v = F.col("value")
    sev = (
        F.when(v > 150, F.lit("critical")).when(v > 80, F.lit("High")).when(v > 30, F.lit("MEDIUM")).otherwise(F.lit("x"))
    )
    ack = F.when(k % 17 == 0, F.lit(None).cast("boolean")).otherwise(k % 3 == 0)
    return e.select(
        F.concat(F.lit("AL-"), s("event_id")).alias("alarm_id"),
        machine_of(F.col("user_id") % N_MACHINES).alias("machine_id"),
        sev.alias("severity"),
        F.concat(F.lit("E-"), s(k)).alias("code"),
        F.lit("threshold exceeded").alias("message"),
        F.lit("process").alias("category"),
        F.col("ts").alias("triggered_ts"),
        ack.alias("acknowledged"),
        F.when(ack, F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("ack_ts"),
        F.when(ack, F.concat(F.lit("OP-"), s(F.col("user_id") % 7))).alias("ack_by"),
        F.lit("medium").alias("impact"),
        F.col("ts").alias("ingest_ts"),
    )


def quality_inspections_raw(t: Tables) -> DataFrame:
    li = t.lineitem
    flag = F.col("l_returnflag")
    machine_no = F.col("l_suppkey") % N_MACHINES
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int"))
    is_day = F.col("l_orderkey") % 2 == 0
    result = (
        F.when(flag == "N", F.lit("pass"))
        .when(flag == "A", F.when(F.col("l_linenumber") % 5 == 0, F.lit("FAIL")).otherwise(F.lit("fail")))
        .otherwise(F.lit("rework"))
    )
    pm = F.col("l_partkey") % 6
    defect = F.lit(None).cast("string")
    for i, name in enumerate(DEFECT_TYPES):
        defect = F.when(pm == i, F.lit(name)).otherwise(defect) if i else F.when(pm == i, F.lit(name))
    defect = F.when(flag == "N", F.lit(None).cast("string")).otherwise(defect)
    insp_ts = F.timestamp_seconds(
        F.unix_timestamp(day.cast("timestamp")) + F.when(is_day, F.lit(8 * 3600)).otherwise(F.lit(20 * 3600))
    )
    return li.select(
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("inspection_id"),
        F.concat(F.lit("SN-"), s("l_orderkey"), F.lit("-"), s("l_linenumber")).alias("unit_serial"),
        machine_of(machine_no).alias("machine_id"),
        line_of(machine_no).alias("line"),
        F.concat(F.lit("PRD-"), s(F.col("l_partkey") % 4)).alias("product"),
        insp_ts.alias("inspection_ts"),
        result.alias("result"),
        defect.alias("defect_type"),
        F.concat(dtext(day), F.lit("-"), F.when(is_day, F.lit("D")).otherwise(F.lit("N"))).alias("shift_id"),
        insp_ts.alias("ingest_ts"),
    )


def shift_records_raw(t: Tables) -> DataFrame:
    """Distinct event days x {D,N} x {ALL,A,B,C}; the last night is open; one bad row (end < start)."""
    # one row per calendar day: the frame is bounded by the calendar, so the global
    # min/max window below runs over a few hundred rows at most, whatever the data volume
    days = t.events.select(F.to_date("ts").alias("day")).distinct()
    whole = Window.partitionBy()
    periods = (
        days.withColumn("last_day", F.max("day").over(whole))
        .withColumn("first_day", F.min("day").over(whole))
        .withColumn("p", F.explode(F.array(
            F.struct(F.lit("D").alias("period"), F.lit(6).alias("start_hour")),
            F.struct(F.lit("N").alias("period"), F.lit(18).alias("start_hour")))))
        .withColumn("line", F.explode(F.array(*[F.lit(x) for x in ("ALL",) + LINES])))
        .select("day", "last_day", "first_day", "p.period", "p.start_hour", "line")
    )
    start = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("start_hour") * 3600)
    is_open = (F.col("day") == F.col("last_day")) & (F.col("period") == "N")
    is_bad = (F.col("day") == F.col("first_day")) & (F.col("period") == "D") & (F.col("line") == "ALL")
    end = (
        F.when(is_open, F.lit(None).cast("timestamp"))
        .when(is_bad, start - F.expr("INTERVAL 1 HOURS"))
        .otherwise(start + F.expr("INTERVAL 12 HOURS"))
    )
    return periods.select(
        F.concat(dtext("day"), F.lit("-"), F.col("period")).alias("shift_id"),
        F.col("line"),
        F.lit("PRD-0").alias("product"),
        start.alias("start_ts"),
        end.alias("end_ts"),
        F.concat(F.lit("SUP-"), F.col("period"), F.lit("-"), F.col("line")).alias("supervisor_id"),
        F.lit(500).alias("target_units"),
        start.alias("ingest_ts"),
    )


def machine_master(t: Tables) -> DataFrame:
    """The machines seen in the data (bounded by the fleet size), minus one so joins differ."""
    nums = t.events.select((F.col("user_id") % N_MACHINES).alias("n")).distinct()
    mid = machine_of(F.col("n"))
    return nums.filter(mid != MISSING_MACHINE).select(
        mid.alias("machine_id"),
        line_of(F.col("n")).alias("line"),
        F.concat(F.lit("Line "), line_of(F.col("n"))).alias("line_name"),
        F.concat(F.lit("PRD-"), s(F.col("n") % 4)).alias("product"),
        F.concat(F.lit("Machine "), s("n")).alias("name"),
        F.concat(F.lit("Station "), s("n")).alias("description"),
        F.array(F.lit("temp_c"), F.lit("oee_pct")).alias("sensor_tags"),
        (F.col("n") + 60).cast("int").alias("target_units_hr"),
        (F.col("n") + 30.0).alias("std_cycle_sec"),
    )


# ---- planning inputs ---------------------------------------------------------------------------

TARIFF_COUNTRY = "NATION_3"  # origin that the tariff scenario hits in the test data


def stock_network(t: Tables) -> DataFrame:
    """SKU x branch stock network: branch = supplier mod 6, HUB for branches 0-1, location type
    blank for one category (O1 inference), region FL / GA / blank, brand flag in four forms."""
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    sup = t.supplier.select("s_suppkey", "s_nationkey").join(
        F.broadcast(t.nation.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey")
    )  # nation is a fixed 25-row table
    q = F.col("l_quantity").cast("int")
    # line items are summed per (part, supplier) first (partial aggregate per map task), so the
    # supplier join carries one row per pair instead of one per line item
    pre = li.groupBy("l_partkey", "l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "N", q).otherwise(0)).alias("avail"),
        F.sum(q).alias("qty"),
    )
    g = pre.join(sup, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy(
        "l_partkey", (F.col("l_suppkey") % 6).alias("branch")
    ).agg(
        F.sum("avail").cast("int").alias("available_stock"),
        F.floor(F.sum("qty") / 2).cast("int").alias("safety_stock"),
        F.max("n_name").alias("primary_origin"),
    )
    g = g.join(t.part.select("p_partkey", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"), "left")
    pm5, pm4 = F.col("l_partkey") % 5, F.col("l_partkey") % 4
    return g.select(
        F.concat(F.lit("SKU-"), s("l_partkey")).alias("sku"),
        F.concat(F.lit("BR-"), s("branch")).alias("branch_id"),
        "primary_origin",
        F.when(F.col("p_type") == "PROMO", F.lit("")).when(F.col("branch") < 2, F.lit("HUB")).otherwise(F.lit("SPOKE")).alias("location_type"),
        F.when(pm5 == 0, F.lit("")).when(pm5 == 1, F.lit("GA")).otherwise(F.lit("FL")).alias("region"),
        F.col("p_type").alias("product_category"),
        "available_stock",
        "safety_stock",
        F.col("p_retailprice").alias("unit_cost"),
        F.when(pm4 == 0, F.lit("Carrier")).when(pm4 == 1, F.lit("1")).when(pm4 == 2, F.lit("")).alias("carrier_flag"),
    )


def demand_history(t: Tables) -> DataFrame:
    """Monthly actual demand per part (ship month) and a biased forecast of it:
    forecast = round(actual x (0.8 + (part mod 5) x 0.1)), half-up on integers."""
    li = t.lineitem
    g = li.groupBy("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("period")).agg(
        F.sum(F.col("l_quantity").cast("int")).cast("bigint").alias("actual_qty")
    )
    fc = F.floor((F.col("actual_qty") * (F.col("l_partkey") % 5 + 8) * 2 + 10) / 20).cast("bigint")
    g = g.join(t.part.select("p_partkey", "p_type", "p_name", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return g.select(
        F.concat(F.lit("SKU-"), s("l_partkey")).alias("sku_id"),
        F.col("p_name").alias("sku_description"),
        F.col("p_type").alias("category"),
        "period",
        fc.alias("forecast_qty"),
        "actual_qty",
        F.col("p_retailprice").alias("avg_selling_price"),
    )


def finance_lines(t: Tables) -> DataFrame:
    """Order lines with their order date, line status and the customer's nation and region."""
    geo = t.nation.select("n_nationkey", F.col("n_name").alias("nation"), "n_regionkey").join(
        t.region.select("r_regionkey", F.col("r_name").alias("region")), F.col("n_regionkey") == F.col("r_regionkey")
    )  # fixed 25-row geography
    cust = t.customer.select("c_custkey", "c_nationkey").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    o = t.orders.select("o_orderkey", "o_orderdate", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    li = t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_linestatus")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "region", "nation", "o_orderdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_linestatus"
    )


# ---- lab (inspection records, test runs, schedule, readings) --------------------------------------

LAB_AS_OF = "2001-12-01 00:00:00"  # clock for lab data (inspection dates = order date + 120 days)
PIECES = ("piece_1st", "piece_5th", "piece_10th", "piece_15th", "piece_20th", "piece_25th", "piece_30th", "piece_35th", "piece_iqa")


def inspection_records(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 37 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("PRD-"), s(F.col("o_custkey") % 12))).alias("product"),
        F.when(F.col("o_orderkey") % 41 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("MCH-"), s(F.col("o_custkey") % 9))).alias("machinist"),
        F.concat(F.lit("OP"), s((F.col("o_orderkey") % 6) * 10)).alias("operation"),
        F.date_add(F.to_date("o_orderdate"), 120).alias("inspection_date"),
        F.col("o_orderstatus").alias("status"),
    )


def inspection_rows(t: Tables) -> DataFrame:
    li = t.lineitem
    flag, ln = F.col("l_returnflag"), F.col("l_linenumber")
    mid = F.when(flag == "N", F.lit("Pass")).when(flag == "A", F.lit(""))
    return li.select(
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("id"),
        F.col("l_orderkey").alias("record_id"),
        F.when((flag == "A") & (ln % 3 == 0), F.lit("FAIL")).otherwise(F.lit("Pass")).alias("piece_1st"),
        *[mid.alias(c) for c in PIECES[1:-1]],
        F.when((flag == "R") & (ln % 4 == 0), F.lit("f")).otherwise(F.lit("pass")).alias("piece_iqa"),
    )


def test_runs(t: Tables) -> DataFrame:
    o = t.orders
    st = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 8).cast("int").alias("procedure_id"),
        F.when(st == "F", F.lit("completed")).when(st == "P", F.lit("failed")).otherwise(F.lit("in_progress")).alias("status"),
        F.timestamp_seconds(F.unix_timestamp("o_orderdate") + 120 * 86400 + (F.col("o_orderkey") % 24) * 3600).alias("created_at"),
    )


def test_procedures(t: Tables) -> DataFrame:
    ids = t.orders.select((F.col("o_custkey") % 8).cast("int").alias("id")).distinct()
    m = F.col("id") % 3
    return ids.select(
        "id", F.concat(F.lit("Procedure "), s("id")).alias("name"),
        F.when(m == 0, F.lit("pump")).when(m == 1, F.lit("valve")).otherwise(F.lit("compressor")).alias("product_type"),
    )


def test_schedule(t: Tables) -> DataFrame:
    o = t.orders
    m4 = F.col("o_orderkey") % 4
    status = (F.when(m4 == 0, F.lit("scheduled")).when(m4 == 1, F.lit("in_progress"))
              .when(m4 == 2, F.lit("completed")).otherwise(F.lit("cancelled")))
    pr = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 11).cast("int").alias("technician_id"),
        status.alias("status"),
        F.when(pr == "1-URGENT", F.lit("critical")).when(pr == "2-HIGH", F.lit("high")).otherwise(F.lit("normal")).alias("priority"),
        F.when(m4 == 2, F.timestamp_seconds(F.unix_timestamp(F.lit(LAB_AS_OF).cast("timestamp")) - (F.col("o_orderkey") % 72) * 3600))
        .alias("completed_at"),
        (F.col("o_orderkey") % 90 + 30).cast("int").alias("est_minutes"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(None).cast("string")).otherwise(machine_of(F.col("o_custkey") % N_MACHINES)).alias("machine_id"),
    )


def technicians(t: Tables) -> DataFrame:
    ids = t.orders.select((F.col("o_custkey") % 11).cast("int").alias("id")).distinct()
    return ids.select("id", F.concat(F.lit("Tech "), s("id")).alias("name"),
                      F.when(F.col("id") % 2 == 0, F.lit("pressure")).otherwise(F.lit("flow")).alias("specialty"),
                      (F.col("id") != 10).alias("is_active"))


def pressure_readings(t: Tables) -> DataFrame:
    e = t.events
    psi = F.col("value") + 50
    leak = props_k() / 1000.0
    return e.select(
        F.col("event_id").alias("reading_id"),
        machine_of(F.col("user_id") % N_MACHINES).alias("machine_id"),
        F.col("event_type").alias("test_type"),
        psi.alias("pressure_psi"),
        leak.alias("leak_rate_psi_min"),
        F.when((psi >= 130) & (leak < 0.1), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("result_raw"),
        F.col("ts").alias("recorded_at"),
    )


# ---- lab test procedures: sections, steps and run responses ------------------------------------

# The step template every procedure carries (order index, section number, step type,
# mandatory). Tolerances and conditions depend on the procedure id (see test_proc_steps).
STEP_TEMPLATE = (
    (1, 1, "instruction", True),
    (2, 1, "ok_check", True),
    (3, 1, "pass_fail", False),
    (4, 1, "text", False),
    (5, 2, "number", True),
    (6, 2, "number", True),
    (7, 2, "instruction", True),
)


def test_proc_sections(t: Tables) -> DataFrame:
    """Two sections per procedure: a manual check list and an auto-captured measurement block."""
    p = test_procedures(t).select(F.col("id").alias("procedure_id"))
    sec = F.explode(F.array(F.lit(1), F.lit(2))).alias("section_no")
    x = p.select("procedure_id", sec)
    return x.select(
        (F.col("procedure_id") * 10 + F.col("section_no")).cast("int").alias("id"),
        "procedure_id",
        F.col("section_no").cast("int").alias("order_index"),
        F.when(F.col("section_no") == 1, F.lit("Checks")).otherwise(F.lit("Measurements")).alias("title"),
        F.when(F.col("section_no") == 1, F.lit("manual")).otherwise(F.lit("auto")).alias("section_type"),
    )


def test_proc_steps(t: Tables) -> DataFrame:
    """Procedures x the step template. Step 5 has bounds lower = 10 + id (and upper = 40 for even
    ids); step 6 has upper = 5 and shows only when step 3 was answered "Pass"."""
    tmpl = F.array(*[
        F.struct(F.lit(o).alias("o"), F.lit(sn).alias("sn"), F.lit(ty).alias("ty"), F.lit(m).alias("m"))
        for o, sn, ty, m in STEP_TEMPLATE
    ])
    p = test_procedures(t).select(F.col("id").alias("pid"))
    x = p.select("pid", F.explode(tmpl).alias("s"))
    o, pid = F.col("s.o"), F.col("pid")
    tol = (
        F.when((o == 5) & (pid % 2 == 0), F.format_string('{"lower": %d, "upper": 40}', pid + 10))
        .when(o == 5, F.format_string('{"lower": %d}', pid + 10))
        .when(o == 6, F.lit('{"upper": 5}'))
        .otherwise(F.lit("{}"))
    )
    cond = F.when(o == 6, F.format_string('{"step_id": %d, "value": "Pass"}', pid * 100 + 3))
    return x.select(
        (pid * 100 + o).cast("int").alias("id"),
        (pid * 10 + F.col("s.sn")).cast("int").alias("section_id"),
        o.cast("int").alias("order_index"),
        F.col("s.ty").alias("step_type"),
        F.concat(F.lit("Step "), s(o)).alias("label"),
        tol.alias("tolerances_json"),
        F.col("s.m").alias("is_mandatory"),
        cond.alias("condition_json"),
    )


def test_run_responses(t: Tables) -> DataFrame:
    """One response per line item: run = order, step = the order's procedure step at the line
    number. Values exercise blanks, bound-equal numbers, text in a number step and a numeric
    prefix ("12mm"). (run, step) repeats in the data; the newest response counts (created_at,
    then id, then value as a total order)."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax",
                           "l_returnflag", "l_extendedprice", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    ln, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    flag, pk = F.col("l_returnflag"), F.col("l_partkey")
    value = (
        F.when(ln == 2, F.when(flag == "A", F.lit("NOT OK")).otherwise(F.lit("OK")))
        .when(ln == 3, F.when(flag == "R", F.lit("Fail")).when(q % 10 == 0, F.lit("")).otherwise(F.lit("Pass")))
        .when(ln == 4, F.when(q % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("note "), s(q))))
        .when(ln == 5, F.when(pk % 17 == 0, F.lit("n/a")).when(pk % 19 == 0, F.concat(s(q), F.lit("mm"))).otherwise(s(q)))
        .when(ln == 6, s(F.round(F.col("l_tax") * 100).cast("int")))
        .otherwise(F.lit(""))
    )
    return j.select(
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("id"),
        F.col("l_orderkey").alias("run_id"),
        ((F.col("o_custkey") % 8) * 100 + ln).cast("int").alias("step_id"),
        value.alias("value"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


# ---- oil-field operations: work orders, calibrations, daily reports, equipment health -------------

FIELD_RIGS, FIELD_EQUIPMENT = 6, 30  # rig ids RIG-0..5 and equipment ids EQ-0..29 of the binding
# Calibration types as the reference lists them (picked by order key mod 5).
CAL_TYPES = ("Initial", "Periodic", "Post_Repair", "Pre_Deployment", "Annual")


def field_work_orders(t: Tables) -> DataFrame:
    o = t.orders
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    return o.select(
        F.concat(F.lit("WO-"), s("o_orderkey")).alias("work_order_id"),
        F.concat(F.lit("RIG-"), s(F.col("o_custkey") % FIELD_RIGS)).alias("rig_id"),
        F.concat(F.lit("EQ-"), s(F.col("o_custkey") % FIELD_EQUIPMENT)).alias("equipment_id"),
        F.when(pr == "1-URGENT", F.lit("P1")).when(pr == "2-HIGH", F.lit("P2")).otherwise(F.lit("P3")).alias("priority"),
        F.when(st == "F", F.lit("closed")).when(st == "O", F.lit("open")).otherwise(F.lit("in_progress")).alias("status"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30 + 14).cast("int")).alias("due_date"),
        (F.col("o_orderkey") % 40 + 1).cast("int").alias("estimated_hours"),
        F.to_date("o_orderdate").alias("created_date"),
    )


def calibration_records(t: Tables) -> DataFrame:
    o = t.orders
    st = F.col("o_orderstatus")
    return o.select(
        F.concat(F.lit("CAL-"), s("o_orderkey")).alias("cal_id"),
        F.concat(F.lit("EQ-"), s(F.col("o_custkey") % FIELD_EQUIPMENT)).alias("equipment_id"),
        F.to_date("o_orderdate").alias("cal_date"),
        F.element_at(F.array(*[F.lit(c) for c in CAL_TYPES]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("cal_type"),
        F.when(st == "F", F.lit("Pass")).when(st == "O", F.lit("Pass_With_Adjustment")).otherwise(F.lit("Fail")).alias("cal_result"),
    )


def daily_reports(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        F.concat(F.lit("RPT-"), s("o_orderkey")).alias("report_id"),
        F.concat(F.lit("RIG-"), s(F.col("o_custkey") % FIELD_RIGS)).alias("rig_id"),
        F.to_date("o_orderdate").alias("report_date"),
        F.when(F.col("o_orderstatus") == "P", (F.col("o_orderkey") % 7) * 0.5).otherwise(F.lit(0.0)).alias("npdt_hours"),
        (F.col("o_orderkey") % 3).cast("int").alias("wells_tested"),
        (F.floor("o_totalprice") / 100.0).alias("oil_produced_bbl"),
        (F.floor(F.col("o_totalprice") / 1000) / 100.0).alias("gas_produced_mmscf"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(1)).otherwise(F.lit(0)).alias("hse_events"),
    )


def equipment_health(t: Tables) -> DataFrame:
    """Health snapshots from events; the raw fault code is set for two thirds of the snapshots
    whatever the score, so the < 70 validation has work to do."""
    e = t.events
    k = props_k()
    return e.select(
        F.concat(F.lit("EH-"), s("event_id")).alias("health_id"),
        F.concat(F.lit("EQ-"), s(F.col("user_id") % FIELD_EQUIPMENT)).alias("equipment_id"),
        F.col("ts").alias("snapshot_ts"),
        (F.floor((F.col("value") % 60 + 40) * 10 + 0.5) / 10).alias("overall_health_score"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("FC-00"), s(k % 5 + 1))).alias("fault_code"),
    )


def reading_enhancements(t: Tables) -> DataFrame:
    """Manual overlays on readings: every fourth reading (by k) gets 1-3 enhancements 30 minutes
    apart; the override is PASS, FAIL or none in turn, so the newest one decides."""
    e = t.events
    k = props_k()
    x = e.filter(k % 4 == 0).select(
        "event_id", "user_id", "ts", k.alias("k"), F.explode(F.sequence(F.lit(0), k % 3)).alias("j"))
    m = (F.col("k") + F.col("j")) % 3
    return x.select(
        (F.col("event_id") * 10 + F.col("j")).alias("id"),
        F.col("event_id").alias("bronze_reading_id"),
        machine_of(F.col("user_id") % N_MACHINES).alias("machine_id"),
        ((F.col("k") + F.col("j")) % 11).cast("int").alias("technician_id"),
        F.when(m == 0, F.lit('{"result": "PASS"}')).when(m == 1, F.lit('{"result": "FAIL"}')).otherwise(F.lit("{}"))
        .alias("override_values"),
        ((F.col("k") + F.col("j")) % 5 + 1).cast("int").alias("confidence_in_data"),
        (F.col("ts") + F.make_interval(mins=((F.col("j") + 1) * 30).cast("int"))).alias("created_at"),
    )


def inspection_decisions(t: Tables) -> DataFrame:
    """Vision inspection outcome per image: odd labels are defective; label mod 4 = 3 is HIGH
    severity (scrap), the other defects MEDIUM (rework)."""
    e = t.embeddings
    lab = F.col("label")
    sev = F.when(lab % 2 == 0, F.lit(None).cast("string")).when(lab % 4 == 3, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
    return e.select(
        F.col("vec_id").alias("image_id"),
        (lab % 2 == 1).alias("defective"),
        sev.alias("severity"),
        F.when(sev == "HIGH", F.lit("SCRAP")).when(sev == "MEDIUM", F.lit("REWORK")).alias("decision"),
    )

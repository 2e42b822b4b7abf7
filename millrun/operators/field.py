"""Oil-field operations.

All operators are row-level projections or hash aggregates over the rig, equipment and report
keys. A rig or a piece of equipment may hold a third of all rows: every aggregate here is
decomposable (counts, sums, min, max_by), so Spark combines each key map-side before the
shuffle and no key is ever collected in one task. Money and volume sums go through DECIMAL so
the totals do not depend on the summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.functions import scalar as P

# Calibration intervals (days) of the reference; any other type is due after 180 days.
CAL_INTERVAL_DAYS = {"Annual": 365, "Periodic": 90}
CAL_DEFAULT_DAYS = 180
# A fault code is only valid on a snapshot whose health score is below this.
FAULT_SCORE_LIMIT = 70.0
# Fault code descriptions, as the reference states them.
FAULT_DESCRIPTIONS = (
    ("FC-001", "High bearing temperature"),
    ("FC-002", "Abnormal vibration signature"),
    ("FC-003", "Seal leak detected"),
    ("FC-004", "Pressure drop across filter"),
    ("FC-005", "Communication timeout"),
)
# Work-order priority order (P1 first, then P2, then the rest).
PRIORITY_ORDER = ("P1", "P2")


def _date(x: str) -> Column:
    return F.lit(x).cast("date")


def calibration_due(cals: DataFrame, as_of: str) -> DataFrame:
    """Next due date = calibration date + interval by type; overdue and days to due vs ``as_of``."""
    interval = F.lit(CAL_DEFAULT_DAYS)
    for kind, days in reversed(CAL_INTERVAL_DAYS.items()):
        interval = F.when(F.col("cal_type") == kind, F.lit(days)).otherwise(interval)
    nxt = F.date_add("cal_date", interval)
    return cals.select(
        "cal_id", "equipment_id", "cal_date", "cal_type", "cal_result",
        nxt.alias("next_due_date"),
        (nxt < _date(as_of)).alias("overdue"),
        F.datediff(nxt, _date(as_of)).alias("days_to_due"),
    )


def _fault_dim(spark) -> DataFrame:
    return spark.createDataFrame(list(FAULT_DESCRIPTIONS), "fault_code string, fault_description string")


def health_faults(health: DataFrame) -> DataFrame:
    """A fault code stands only on a snapshot scoring below 70; its description comes from the
    fixed fault-code dimension (5 rows, broadcast). ``code_valid`` flags raw codes that break the rule."""
    valid = F.col("overall_health_score") < FAULT_SCORE_LIMIT
    h = health.select(
        "health_id", "equipment_id", "snapshot_ts", "overall_health_score",
        F.col("fault_code").alias("raw_fault_code"),
        F.when(valid, F.col("fault_code")).alias("fault_code"),
        (F.col("fault_code").isNull() | valid).alias("code_valid"),
    )
    return h.join(F.broadcast(_fault_dim(health.sparkSession)), "fault_code", "left").select(
        "health_id", "equipment_id", "snapshot_ts", "overall_health_score", "raw_fault_code", "fault_code",
        "fault_description", "code_valid")


def equipment_health_summary(faults: DataFrame) -> DataFrame:
    """Per equipment: snapshots, valid faults, invalid raw codes, lowest score, latest score, and the
    mean score (tenths summed as integers, so the mean is exact)."""
    latest = F.max_by("overall_health_score", F.struct("snapshot_ts", "health_id"))
    g = faults.groupBy("equipment_id").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.count("fault_code").alias("faults"),
        F.count_if(~F.col("code_valid")).alias("invalid_codes"),
        F.min("overall_health_score").alias("min_score"),
        latest.alias("latest_score"),
        F.sum(F.round(F.col("overall_health_score") * 10).cast("bigint")).alias("_tenths"),
    )
    return g.select("equipment_id", "snapshots", "faults", "invalid_codes", "min_score", "latest_score",
                    P.round_half_up(F.col("_tenths") / F.col("snapshots") / 10.0, 2).alias("avg_score"))


def rig_hse_rollup(reports: DataFrame) -> DataFrame:
    """Per rig x month: reports, non-productive hours, wells tested, oil and gas produced, HSE events."""
    dec = lambda c: F.col(c).cast("decimal(18,2)")
    return reports.groupBy("rig_id", F.date_format("report_date", "yyyy-MM").alias("period")).agg(
        F.count(F.lit(1)).alias("reports"),
        F.sum(dec("npdt_hours")).alias("npdt_hours"),
        F.sum("wells_tested").alias("wells_tested"),
        F.sum(dec("oil_produced_bbl")).alias("oil_produced_bbl"),
        F.sum(dec("gas_produced_mmscf")).alias("gas_produced_mmscf"),
        F.sum("hse_events").alias("hse_events"),
        F.count_if(F.col("hse_events") > 0).alias("days_with_hse_events"),
    )


def priority_rank(priority: Column) -> Column:
    """S6 sort key: P1, P2, then every other priority."""
    rank = F.lit(len(PRIORITY_ORDER) + 1)
    for i, p in reversed(list(enumerate(PRIORITY_ORDER, start=1))):
        rank = F.when(priority == p, F.lit(i)).otherwise(rank)
    return rank


def work_order_queue(orders: DataFrame, n: int = 10, statuses=("open", "in_progress")) -> DataFrame:
    """The next ``n`` outstanding work orders by priority, then due date (id breaks ties).
    Sort + limit plans as a TakeOrderedAndProject: a top-n per task, then one small merge."""
    o = orders.filter(F.col("status").isin(*statuses)).withColumn("priority_rank", priority_rank(F.col("priority")))
    return o.orderBy("priority_rank", "due_date", "work_order_id").limit(n)


def work_orders_by_status(orders: DataFrame, as_of: str) -> DataFrame:
    """Outstanding, overdue and total hours per rig and status, in the form the pages show ("IN_PROGRESS" -> "in-progress").
    A NULL status is a group of its own."""
    late = (F.col("due_date") < F.lit(as_of).cast("date")) & (P.status_slug("status") != "closed")
    return orders.groupBy("rig_id", P.status_slug("status").alias("status")).agg(
        F.count(F.lit(1)).alias("work_orders"), F.sum("estimated_hours").alias("hours"), F.count_if(late).alias("overdue"))

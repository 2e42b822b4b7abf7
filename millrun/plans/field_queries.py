"""Oil-field queries (P40, P42, A54, S6) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrun.operators import field as FD
from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.registry import query
from millrun.sources import bindings as B

AS_OF = B.AS_OF_ORDERS


def RH(expr: str, d: int) -> str:
    return f"(floor(({expr}) * {10**d} + 0.5) / {10**d})"


@query(
    "calibration_due",
    W(["calibration_records"], [],
      f"""SELECT cal_id, equipment_id, cal_date, cal_type, cal_result,
              cal_date + CAST(CASE cal_type WHEN 'Annual' THEN 365 WHEN 'Periodic' THEN 90 ELSE 180 END AS INTEGER) AS next_due_date,
              cal_date + CAST(CASE cal_type WHEN 'Annual' THEN 365 WHEN 'Periodic' THEN 90 ELSE 180 END AS INTEGER) < DATE '{AS_OF}' AS overdue,
              CAST(datediff('day', DATE '{AS_OF}',
                   cal_date + CAST(CASE cal_type WHEN 'Annual' THEN 365 WHEN 'Periodic' THEN 90 ELSE 180 END AS INTEGER)) AS INTEGER)
                  AS days_to_due
          FROM calibration_records"""),
)
def q_calibration_due(t):
    """Calibration next-due dates and overdue flags at the ERP clock."""
    return FD.calibration_due(B.calibration_records(t), AS_OF)


_FAULTS_VALUES = ", ".join(f"('{c}', '{d}')" for c, d in FD.FAULT_DESCRIPTIONS)
SQL_HEALTH_FAULTS = f"""SELECT h.health_id, h.equipment_id, h.snapshot_ts, h.overall_health_score, h.fault_code AS raw_fault_code,
        CASE WHEN h.overall_health_score < 70 THEN h.fault_code END AS fault_code,
        CASE WHEN h.overall_health_score < 70 THEN d.fault_description END AS fault_description,
        h.fault_code IS NULL OR h.overall_health_score < 70 AS code_valid
    FROM equipment_health h LEFT JOIN (VALUES {_FAULTS_VALUES}) d(fault_code, fault_description) ON d.fault_code = h.fault_code"""


@query("health_faults", W(["equipment_health"], [], SQL_HEALTH_FAULTS))
def q_health_faults(t):
    """Fault codes kept only below health score 70, with their descriptions."""
    return FD.health_faults(B.equipment_health(t))


@query(
    "equipment_health_summary",
    W(["equipment_health"], [("hf", SQL_HEALTH_FAULTS)],
      f"""WITH l AS (SELECT equipment_id, overall_health_score AS latest_score FROM (
                     SELECT equipment_id, overall_health_score, row_number() OVER (
                         PARTITION BY equipment_id ORDER BY snapshot_ts DESC, health_id DESC) AS rn FROM hf) x WHERE rn = 1)
          SELECT hf.equipment_id, count(*) AS snapshots, count(fault_code) AS faults, count_if(NOT code_valid) AS invalid_codes,
              min(overall_health_score) AS min_score, any_value(l.latest_score) AS latest_score,
              {RH("sum(CAST(round(overall_health_score * 10) AS BIGINT)) / count(*) / 10.0", 2)} AS avg_score
          FROM hf JOIN l ON l.equipment_id = hf.equipment_id GROUP BY hf.equipment_id"""),
)
def q_equipment_health_summary(t):
    """P42 roll-up per equipment: snapshots, valid faults, invalid raw codes, min / latest / mean score."""
    return FD.equipment_health_summary(FD.health_faults(B.equipment_health(t)))


@query(
    "rig_hse_rollup",
    W(["daily_reports"], [],
      """SELECT rig_id, strftime(report_date, '%Y-%m') AS period, count(*) AS reports,
              sum(CAST(npdt_hours AS DECIMAL(18, 2))) AS npdt_hours, sum(wells_tested) AS wells_tested,
              sum(CAST(oil_produced_bbl AS DECIMAL(18, 2))) AS oil_produced_bbl,
              sum(CAST(gas_produced_mmscf AS DECIMAL(18, 2))) AS gas_produced_mmscf,
              sum(hse_events) AS hse_events, count_if(hse_events > 0) AS days_with_hse_events
          FROM daily_reports GROUP BY 1, 2"""),
)
def q_rig_hse_rollup(t):
    """Non-productive hours, production and HSE events per rig x month."""
    return FD.rig_hse_rollup(B.daily_reports(t))


@query(
    "work_order_queue",
    W(["field_work_orders"], [],
      """SELECT *, CASE priority WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 ELSE 3 END AS priority_rank FROM field_work_orders
         WHERE status IN ('open', 'in_progress') ORDER BY priority_rank, due_date, work_order_id LIMIT 10"""),
)
def q_work_order_queue(t):
    """The next 10 outstanding work orders (P1, P2, others; then due date) - a top-k report."""
    return FD.work_order_queue(B.field_work_orders(t))


@query(
    "work_orders_by_status",
    W(["field_work_orders"], [],
      f"""SELECT rig_id, replace(lower(status), '_', '-') AS status, count(*) AS work_orders, CAST(sum(estimated_hours) AS BIGINT) AS hours,
             count(*) FILTER (WHERE status <> 'closed' AND due_date < CAST(TIMESTAMP '{B.LAB_AS_OF}' AS DATE)) AS overdue
         FROM field_work_orders GROUP BY ALL"""),
)
def q_work_orders_by_status(t):
    """Work orders of each rig by status slug; the binding's statuses are stored in upper case, as the source system does."""
    orders = B.field_work_orders(t)
    return FD.work_orders_by_status(orders.withColumn("status", F.upper("status")), B.LAB_AS_OF)

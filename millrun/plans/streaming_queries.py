"""Streaming jobs registered as queries: each runs available-now over the events file stream
and returns the reconciled result, checked against the batch formulation in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.plant_queries import MACHINE_STATE_ORACLE, OEE_SHIFT_ORACLE, SLIDING_PARETO_ORACLE, SQL_ALARMS, SQL_STATE_EVENTS, SQL_TELEMETRY
from millrun.plans.registry import query
from millrun.sources import bindings as B
from millrun.streaming import jobs as J
from millrun.streaming import late as L


def _st(t):
    return J.StreamTables(t.spark, t.sf_dir)


@query("telemetry_clean_stream", W(["machine_telemetry_raw"], [], SQL_TELEMETRY))
def q_telemetry_clean_stream(t):
    """ST1: streaming twin of telemetry_silver."""
    return J.telemetry_clean_stream(_st(t))


@query(
    "telemetry_first_stream",
    W(["machine_telemetry_raw"], [("tel", SQL_TELEMETRY)], "SELECT DISTINCT machine_id, ts, shift_id, shift_period FROM tel"),
)
def q_telemetry_first_stream(t):
    """ST1, cheap mode: each (machine, hour) once, by deduplication within the watermark."""
    return J.telemetry_first_stream(_st(t)).select("machine_id", "ts", "shift_id", "shift_period")


@query("oee_by_shift_stream", OEE_SHIFT_ORACLE)
def q_oee_by_shift_stream(t):
    """ST2: streaming twin of oee_by_shift, two chained stateful operators in append mode."""
    return J.oee_by_shift_stream(_st(t))


@query(
    "shift_oee_stream",
    W(["machine_telemetry_raw", "machine_master"], [],
      """WITH v AS (SELECT r.*, m.line FROM machine_telemetry_raw r LEFT JOIN machine_master m ON r.machine_id = m.machine_id
                    WHERE r.oee_pct BETWEEN 0 AND 100 AND r.temp_c BETWEEN -50 AND 500 AND r.cycle_time_sec > 0
                      AND r.oee_pct > 0),
          b AS (SELECT *, to_timestamp(floor((epoch(ts) - 21600) / 43200) * 43200 + 21600) AS shift_start FROM v),
          g AS (SELECT shift_start, line, sum(round(oee_pct * 100)) AS sum_h, count(*) AS n FROM b
                WHERE line IS NOT NULL GROUP BY 1, 2
                UNION ALL
                SELECT shift_start, 'ALL' AS line, sum(round(oee_pct * 100)) AS sum_h, count(*) AS n FROM b GROUP BY 1)
        SELECT CAST(shift_start AS TIMESTAMP) AS shift_start, line, floor(sum_h / n / 100.0 * 10 + 0.5) / 10 AS avg_oee,
               CAST(n AS BIGINT) AS readings FROM g"""),
)
def q_shift_oee_stream(t):
    """ST2: 12-hour tumbling shift windows (06:00 / 18:00) per line and plant."""
    return J.shift_oee_stream(_st(t))


@query(
    "state_duration_stream",
    W(["production_events_raw", "machine_master"], [("se", SQL_STATE_EVENTS)],
      "SELECT event_id, machine_id, event_ts, state, next_event_ts, duration_minutes, downtime_category FROM se"),
)
def q_state_duration_stream(t):
    """ST3: applyInPandasWithState threads each machine's events, late ones too."""
    return J.state_duration_stream(_st(t))


@query(
    "alarm_snapshot_stream",
    W(["alarm_events_raw", "machine_master"], [("al", SQL_ALARMS)],
      """SELECT alarm_id, machine_id, machine_name, line, line_name, product, severity, code, message, category,
         triggered_ts, triggered_min_ago, acknowledged, ack_ts, ack_by, impact, is_active,
         CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS severity_rank
         FROM al WHERE is_active"""),
)
def q_alarm_snapshot_stream(t):
    """ST4: keyed latest alarm state -> active alarms."""
    return J.alarm_snapshot_stream(_st(t), B.AS_OF_EVENTS)


@query("machine_state_stream", MACHINE_STATE_ORACLE)
def q_machine_state_stream(t):
    """ST5: streaming twin of machine_state: latest event, cleaned telemetry, units of the open shift."""
    return J.machine_state_stream(_st(t))


@query(
    "downtime_sliding_stream",
    W(["dt_mst"], [],
      """WITH d AS (SELECT reason_desc, start_ts, date_diff('second', start_ts, end_ts) / 60.0 AS duration_minutes FROM dt_mst),
          w AS (SELECT d.*, CAST(date_trunc('day', start_ts) AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS window_start
                FROM d, range(0, 7) r(k))
        SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, reason_desc, sum(duration_minutes) AS downtime_minutes,
               count(*) AS events FROM w GROUP BY window_start, reason_desc"""),
)
def q_downtime_sliding_stream(t):
    """ST6: 7-day windows sliding by one day."""
    return J.downtime_sliding_stream(_st(t))


@query("downtime_pareto_stream", SLIDING_PARETO_ORACLE)
def q_downtime_pareto_stream(t):
    """ST6 on A12's table: streaming twin of downtime_pareto_sliding."""
    return J.downtime_pareto_stream(_st(t))


@query(
    "late_data_audit_stream",
    W(["machine_telemetry_raw"], [],
      """SELECT CASE WHEN date_diff('second', ts, ingest_ts) / 60.0 < 15 THEN 'on_time'
                     WHEN date_diff('second', ts, ingest_ts) / 60.0 < 45 THEN 'late' ELSE 'too_late' END AS arrival,
                count(*) AS readings FROM machine_telemetry_raw GROUP BY 1"""),
)
def q_late_data_audit_stream(t):
    """ST7: readings by arrival delay."""
    return J.late_data_audit_stream(_st(t))


def arrivals(t):
    """Binding of an order of arrival: events land by the week, and every tenth (ids ending in 3) a week late."""
    raw = B.production_events_raw(t).select("event_id", "machine_id", F.col("event_ts").cast("timestamp").alias("event_ts"), "state")
    week = F.floor(F.unix_timestamp("event_ts") / 604800)
    return raw.withColumn("week", week + F.when(F.col("event_id").cast("bigint") % 10 == 3, 1).otherwise(0))


#: The same order of arrival, and the watermark that a row meets: the newest event of all earlier weeks of arrival, less two days.
SQL_ARRIVALS = """SELECT event_id, machine_id, event_ts, state,
        CAST(floor(epoch(event_ts) / 604800) AS BIGINT) + if(CAST(event_id AS BIGINT) % 10 = 3, 1, 0) AS week FROM production_events_raw"""
SQL_JUDGED = """SELECT r.*, w.watermark FROM arrivals r LEFT JOIN (
        SELECT week, max(max(event_ts)) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS watermark
        FROM arrivals GROUP BY week) w USING (week)"""
JUDGED = [("arrivals", SQL_ARRIVALS), ("judged", SQL_JUDGED)]


def _split(t):
    rows = arrivals(t)
    return rows.drop("week"), *L.split_late(L.Landing(rows, "week", "events"), "event_ts", "2 days", "events")


@query(
    "late_rows_stream",
    W(["production_events_raw"], JUDGED,
      "SELECT event_id, machine_id, event_ts, state, watermark FROM judged WHERE event_ts < watermark"),
)
def q_late_rows_stream(t):
    """ST7: the side table, events that arrive behind the watermark with the watermark they missed."""
    return _split(t)[2].drop("_batch")


@query(
    "late_reconciled_stream",
    W(["production_events_raw"], JUDGED,
      """SELECT CAST(event_ts AS DATE) AS day, count(*) FILTER (WHERE watermark IS NULL OR event_ts >= watermark) AS on_time_rows,
                count(*) FILTER (WHERE event_ts < watermark) AS late_rows, count(*) AS batch_rows, CAST(0 AS BIGINT) AS missing
         FROM judged GROUP BY 1"""),
)
def q_late_reconciled_stream(t):
    """ST7: main and side table against the batch, by day."""
    batch, main, late = _split(t)
    return L.reconciled(main, late, batch, [F.to_date("event_ts").alias("day")])


@query(
    "page_sessions_stream",
    """WITH l AS (SELECT 'U-' || CAST(user_id AS VARCHAR) AS username, CAST(floor(value) AS INTEGER) AS seconds_spent,
                         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS click_count, ts AS recorded_at FROM events),
          g AS (SELECT *, CASE WHEN lag(recorded_at) OVER (PARTITION BY username ORDER BY recorded_at) IS NULL
                                 OR recorded_at - lag(recorded_at) OVER (PARTITION BY username ORDER BY recorded_at)
                                    >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s FROM l),
          s AS (SELECT *, sum(new_s) OVER (PARTITION BY username ORDER BY recorded_at ROWS UNBOUNDED PRECEDING) AS sid FROM g)
       SELECT username, min(recorded_at) AS session_start, max(recorded_at) + INTERVAL 30 MINUTE AS session_end,
              count(*) AS events, CAST(sum(seconds_spent) AS BIGINT) AS seconds, CAST(sum(click_count) AS BIGINT) AS clicks
       FROM s GROUP BY username, sid""",
)
def q_page_sessions_stream(t):
    """ST8: session_window per user (A50 engagement as sessions)."""
    return J.page_sessions_stream(_st(t))

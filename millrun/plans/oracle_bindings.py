"""The FIXTURES §2 bindings re-stated in DuckDB SQL, for the independent oracle.

Each entry is the body of a CTE named after the domain table; ``with_bindings`` prefixes a
query with the CTEs it needs (and their dependencies). Kept in step with
``millrun.sources.bindings`` by the oracle tests.
"""

from __future__ import annotations

D = "strftime({}, '%Y-%m-%d')"


def dtext(x: str) -> str:
    return D.format(x)


K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"

BINDINGS: dict[str, str] = {
    "ekko": f"""SELECT CAST(o_orderkey AS VARCHAR) AS ebeln, CAST(o_custkey % 3 AS VARCHAR) AS bukrs,
        'V-' || CAST(o_custkey % 100 AS VARCHAR) AS lifnr, 'F' AS bstyp, o_orderpriority AS bsart,
        {dtext('o_orderdate')} AS aedat FROM orders""",
    "ekpo": f"""SELECT CAST(l_orderkey AS VARCHAR) AS ebeln, CAST(l_linenumber AS VARCHAR) AS ebelp,
        CAST(l_partkey AS VARCHAR) AS matnr, CAST(l_quantity AS INTEGER) AS menge, 'EA' AS meins,
        l_extendedprice AS netwr, 'P' || CAST(l_suppkey % 5 AS VARCHAR) AS werks,
        'L' || CAST(l_linenumber AS VARCHAR) AS lgort, {dtext('l_shipdate')} AS eindt FROM lineitem""",
    "vbak": f"""SELECT CAST(o_orderkey AS VARCHAR) AS vbeln, 'S' || CAST(o_custkey % 4 AS VARCHAR) AS vkorg,
        '10' AS vtweg, '00' AS spart, CAST(o_custkey AS VARCHAR) AS kunnr,
        CASE WHEN o_orderkey % 31 = 0 THEN '2025-02-30' ELSE {dtext('o_orderdate')} END AS audat,
        o_orderpriority AS auart FROM orders""",
    "vbap": f"""SELECT CAST(l_orderkey AS VARCHAR) AS vbeln, CAST(l_linenumber AS VARCHAR) AS posnr,
        CAST(l_partkey AS VARCHAR) AS matnr, CAST(l_quantity AS INTEGER) AS kwmeng, 'EA' AS vrkme,
        l_extendedprice AS netwr, {dtext('l_shipdate')} AS edatu,
        CASE l_returnflag WHEN 'N' THEN '' WHEN 'R' THEN 'R' END AS absta FROM lineitem""",
    "likp": f"""SELECT CAST(o_orderkey AS VARCHAR) AS vbeln, CAST(o_custkey AS VARCHAR) AS kunnr,
        CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE {dtext('CAST(o_orderdate AS DATE) + 30')} END AS lfdat,
        CASE WHEN o_orderstatus = 'O' THEN NULL
             ELSE {dtext('CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER)')} END AS wadat_ist,
        o_orderpriority AS tragr FROM orders""",
    "lips": """SELECT CAST(l_orderkey AS VARCHAR) AS vbeln, CAST(l_linenumber AS VARCHAR) AS posnr,
        CAST(l_partkey AS VARCHAR) AS matnr, CAST(l_quantity AS INTEGER) AS lfimg, 'EA' AS vrkme FROM lineitem""",
    "mard": """SELECT CAST(l_partkey AS VARCHAR) AS matnr, 'P' || CAST(l_suppkey % 3 AS VARCHAR) AS werks,
        'L' || CAST(l_linenumber AS VARCHAR) AS lgort,
        CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INTEGER) ELSE 0 END) AS INTEGER) AS labst,
        CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INTEGER) ELSE 0 END) AS INTEGER) AS speme,
        CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) ELSE 0 END) AS INTEGER) AS insme,
        max(p_size) AS eisbe
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
        GROUP BY l_partkey, l_suppkey % 3, l_linenumber""",
    "wo_mst": """SELECT CAST(o_orderkey AS VARCHAR) AS wono, 'S' || CAST(o_custkey % 3 AS VARCHAR) AS site,
        'MC' || CAST(o_custkey % 5 AS VARCHAR) AS line, 'PART-' || CAST(o_custkey % 50 AS VARCHAR) AS part,
        CAST(o_orderkey % 100 + 1 AS INTEGER) AS qty_ord, o_orderstatus AS ord_status,
        o_orderdate AS start_date, o_orderdate + INTERVAL 30 DAY AS due_date, o_orderdate AS cr_date FROM orders""",
    "jt_mst": """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
            CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS ticket_id,
        CAST(l_orderkey AS VARCHAR) AS wono, 'S' || CAST(l_suppkey % 3 AS VARCHAR) AS site,
        'MC' || CAST(l_suppkey % 5 AS VARCHAR) AS line, CAST(l_quantity AS INTEGER) AS good_qty,
        CAST(l_linenumber % 3 AS INTEGER) AS scrap_qty,
        l_shipdate + to_seconds(CAST((l_partkey % 24) * 3600 AS BIGINT)) AS start_ts,
        l_shipdate + to_seconds(CAST((l_partkey % 24) * 3600 + CAST(l_quantity AS BIGINT) * 600 AS BIGINT)) AS end_ts
        FROM lineitem""",
    "dt_mst": f"""SELECT CAST(event_id AS VARCHAR) AS event_id, 'S' || CAST(user_id % 3 AS VARCHAR) AS site,
        'MC' || CAST(user_id % 5 AS VARCHAR) AS line, ts AS start_ts,
        ts + to_minutes(CAST(floor(value) AS BIGINT)) AS end_ts,
        'R' || CAST({K} % 7 AS VARCHAR) AS reason_code,
        CASE WHEN {K} % 7 = 0 THEN 'Planned Maintenance' ELSE 'Unplanned Stop' END AS reason_desc
        FROM events WHERE event_type = 'error'""",
    "machine_telemetry_raw": f"""SELECT 'M-' || CAST(user_id % 18 AS VARCHAR) AS machine_id,
        date_trunc('hour', ts) AS ts, value AS oee_pct, value - 20 AS temp_c, {K} / 10.0 AS cycle_time_sec,
        value * 0.08 AS power_kw, CAST(event_id % 1000 AS INTEGER) AS units_count, ts AS ingest_ts FROM events""",
    "production_events_raw": f"""SELECT CAST(event_id AS VARCHAR) AS event_id,
        'M-' || CAST(user_id % 18 AS VARCHAR) AS machine_id, ts AS event_ts,
        CASE event_type WHEN 'error' THEN 'fault' WHEN 'signup' THEN 'idle' WHEN 'purchase' THEN 'maintenance'
             ELSE 'running' END AS state,
        CASE WHEN event_type = 'error' THEN 'E-' || CAST({K} AS VARCHAR) END AS fault_code,
        CASE WHEN event_type = 'error' THEN 'fault reported' END AS fault_msg,
        CASE WHEN event_type = 'signup' THEN CASE WHEN {K} % 2 = 0 THEN 'firmware hold' ELSE 'wait' END END AS idle_reason,
        CASE WHEN event_type = 'purchase' THEN 'preventive' END AS maintenance_type,
        'OP-' || CAST(user_id % 7 AS VARCHAR) AS operator_id, ts AS ingest_ts FROM events""",
    "alarm_events_raw": f"""SELECT 'AL-' || CAST(event_id AS VARCHAR) AS alarm_id,
        'M-' || CAST(user_id % 18 AS VARCHAR) AS machine_id,
        CASE WHEN value > 150 THEN 'critical' WHEN value > 80 THEN 'High' WHEN value > 30 THEN 'MEDIUM' ELSE 'x' END AS severity,
        'E-' || CAST({K} AS VARCHAR) AS code, 'threshold exceeded' AS message, 'process' AS category,
        ts AS triggered_ts,
        CASE WHEN {K} % 17 = 0 THEN NULL ELSE {K} % 3 = 0 END AS acknowledged,
        CASE WHEN {K} % 17 <> 0 AND {K} % 3 = 0 THEN ts + INTERVAL 15 MINUTE END AS ack_ts,
        CASE WHEN {K} % 17 <> 0 AND {K} % 3 = 0 THEN 'OP-' || CAST(user_id % 7 AS VARCHAR) END AS ack_by,
        'medium' AS impact, ts AS ingest_ts FROM events WHERE event_type = 'error'""",
    "quality_inspections_raw": """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
            CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS inspection_id,
        'SN-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS unit_serial,
        'M-' || CAST(l_suppkey % 18 AS VARCHAR) AS machine_id,
        CASE (l_suppkey % 18) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS line,
        'PRD-' || CAST(l_partkey % 4 AS VARCHAR) AS product,
        CAST(DATE '2024-01-01' + CAST(l_orderkey % 30 AS INTEGER) AS TIMESTAMP)
            + CASE WHEN l_orderkey % 2 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL 20 HOUR END AS inspection_ts,
        CASE l_returnflag WHEN 'N' THEN 'pass'
             WHEN 'A' THEN CASE WHEN l_linenumber % 5 = 0 THEN 'FAIL' ELSE 'fail' END
             ELSE 'rework' END AS result,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE
             CASE l_partkey % 6 WHEN 0 THEN 'Solder Bridge' WHEN 1 THEN 'Bond Wire Short' WHEN 2 THEN 'Misaligned Part'
                  WHEN 3 THEN 'Contamination' WHEN 4 THEN 'Missing Component' ELSE 'Cosmetic Scratch' END END AS defect_type,
        strftime(DATE '2024-01-01' + CAST(l_orderkey % 30 AS INTEGER), '%Y-%m-%d') || '-'
            || CASE WHEN l_orderkey % 2 = 0 THEN 'D' ELSE 'N' END AS shift_id,
        CAST(DATE '2024-01-01' + CAST(l_orderkey % 30 AS INTEGER) AS TIMESTAMP)
            + CASE WHEN l_orderkey % 2 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL 20 HOUR END AS ingest_ts
        FROM lineitem""",
    "shift_records_raw": """SELECT strftime(day, '%Y-%m-%d') || '-' || period AS shift_id, line, 'PRD-0' AS product,
        CAST(day AS TIMESTAMP) + to_hours(start_hour) AS start_ts,
        CASE WHEN day = last_day AND period = 'N' THEN NULL
             WHEN day = first_day AND period = 'D' AND line = 'ALL'
                  THEN CAST(day AS TIMESTAMP) + to_hours(start_hour) - INTERVAL 1 HOUR
             ELSE CAST(day AS TIMESTAMP) + to_hours(start_hour) + INTERVAL 12 HOUR END AS end_ts,
        'SUP-' || period || '-' || line AS supervisor_id, 500 AS target_units,
        CAST(day AS TIMESTAMP) + to_hours(start_hour) AS ingest_ts
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d,
             (SELECT max(CAST(ts AS DATE)) AS last_day, min(CAST(ts AS DATE)) AS first_day FROM events) b,
             (VALUES ('D', 6), ('N', 18)) p(period, start_hour),
             (VALUES ('ALL'), ('A'), ('B'), ('C')) l(line)""",
    "machine_master": """SELECT 'M-' || CAST(n AS VARCHAR) AS machine_id,
        CASE n % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS line,
        'Line ' || CASE n % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS line_name,
        'PRD-' || CAST(n % 4 AS VARCHAR) AS product, 'Machine ' || CAST(n AS VARCHAR) AS name,
        'Station ' || CAST(n AS VARCHAR) AS description, ['temp_c', 'oee_pct'] AS sensor_tags,
        CAST(n + 60 AS INTEGER) AS target_units_hr, n + 30.0 AS std_cycle_sec
        FROM (SELECT DISTINCT user_id % 18 AS n FROM events) WHERE n <> 17""",
    "stock_network": """SELECT 'SKU-' || CAST(g.l_partkey AS VARCHAR) AS sku, 'BR-' || CAST(g.branch AS VARCHAR) AS branch_id,
        g.primary_origin,
        CASE WHEN p.p_type = 'PROMO' THEN '' WHEN g.branch < 2 THEN 'HUB' ELSE 'SPOKE' END AS location_type,
        CASE g.l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'GA' ELSE 'FL' END AS region,
        p.p_type AS product_category, g.available_stock, g.safety_stock, p.p_retailprice AS unit_cost,
        CASE g.l_partkey % 4 WHEN 0 THEN 'Carrier' WHEN 1 THEN '1' WHEN 2 THEN '' END AS carrier_flag
        FROM (SELECT l_partkey, l_suppkey % 6 AS branch,
                CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INTEGER) ELSE 0 END) AS INTEGER) AS available_stock,
                CAST(floor(sum(CAST(l_quantity AS INTEGER)) / 2) AS INTEGER) AS safety_stock,
                max(n_name) AS primary_origin
              FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
              GROUP BY l_partkey, l_suppkey % 6) g
        LEFT JOIN part p ON g.l_partkey = p.p_partkey""",
    "demand_history": """SELECT 'SKU-' || CAST(g.l_partkey AS VARCHAR) AS sku_id, p.p_name AS sku_description,
        p.p_type AS category, g.period,
        CAST(floor((g.actual_qty * (g.l_partkey % 5 + 8) * 2 + 10) / 20) AS BIGINT) AS forecast_qty,
        g.actual_qty, p.p_retailprice AS avg_selling_price
        FROM (SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS period,
                     CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS actual_qty
              FROM lineitem GROUP BY 1, 2) g LEFT JOIN part p ON g.l_partkey = p.p_partkey""",
    "finance_lines": """SELECT r_name AS region, n_name AS nation, o_orderdate, l_extendedprice, l_discount, l_tax,
        l_quantity, l_linestatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "inspection_records": """SELECT o_orderkey AS id,
        CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'PRD-' || CAST(o_custkey % 12 AS VARCHAR) END AS product,
        CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'MCH-' || CAST(o_custkey % 9 AS VARCHAR) END AS machinist,
        'OP' || CAST((o_orderkey % 6) * 10 AS VARCHAR) AS operation,
        CAST(o_orderdate AS DATE) + 120 AS inspection_date, o_orderstatus AS status FROM orders""",
    "inspection_rows": """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
            CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS id, l_orderkey AS record_id,
        CASE WHEN l_returnflag = 'A' AND l_linenumber % 3 = 0 THEN 'FAIL' ELSE 'Pass' END AS piece_1st,
        CASE l_returnflag WHEN 'N' THEN 'Pass' WHEN 'A' THEN '' END AS piece_5th, CASE l_returnflag WHEN 'N' THEN 'Pass' WHEN 'A' THEN '' END AS piece_10th, CASE l_returnflag WHEN 'N' THEN 'Pass' WHEN 'A' THEN '' END AS piece_15th, CASE l_returnflag WHEN 'N' THEN 'Pass' WHEN 'A' THEN '' END AS piece_20th, CASE l_returnflag WHEN 'N' THEN 'Pass' WHEN 'A' THEN '' END AS piece_25th, CASE l_returnflag WHEN 'N' THEN 'Pass' WHEN 'A' THEN '' END AS piece_30th, CASE l_returnflag WHEN 'N' THEN 'Pass' WHEN 'A' THEN '' END AS piece_35th,
        CASE WHEN l_returnflag = 'R' AND l_linenumber % 4 = 0 THEN 'f' ELSE 'pass' END AS piece_iqa FROM lineitem""",
    "test_runs": """SELECT o_orderkey AS id, CAST(o_custkey % 8 AS INTEGER) AS procedure_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'in_progress' END AS status,
        o_orderdate + to_seconds(CAST(120 * 86400 + (o_orderkey % 24) * 3600 AS BIGINT)) AS created_at FROM orders""",
    "test_procedures": """SELECT id, 'Procedure ' || CAST(id AS VARCHAR) AS name,
        CASE id % 3 WHEN 0 THEN 'pump' WHEN 1 THEN 'valve' ELSE 'compressor' END AS product_type
        FROM (SELECT DISTINCT CAST(o_custkey % 8 AS INTEGER) AS id FROM orders)""",
    "test_schedule": """SELECT o_orderkey AS id, CAST(o_custkey % 11 AS INTEGER) AS technician_id,
        CASE o_orderkey % 4 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'cancelled' END AS status,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' ELSE 'normal' END AS priority,
        CASE WHEN o_orderkey % 4 = 2 THEN TIMESTAMP '2001-12-01 00:00:00' - to_seconds(CAST((o_orderkey % 72) * 3600 AS BIGINT)) END
            AS completed_at,
        CAST(o_orderkey % 90 + 30 AS INTEGER) AS est_minutes,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'M-' || CAST(o_custkey % 18 AS VARCHAR) END AS machine_id FROM orders""",
    "technicians": """SELECT id, 'Tech ' || CAST(id AS VARCHAR) AS name,
        CASE WHEN id % 2 = 0 THEN 'pressure' ELSE 'flow' END AS specialty, id <> 10 AS is_active
        FROM (SELECT DISTINCT CAST(o_custkey % 11 AS INTEGER) AS id FROM orders)""",
    "pressure_readings": f"""SELECT event_id AS reading_id, 'M-' || CAST(user_id % 18 AS VARCHAR) AS machine_id,
        event_type AS test_type, value + 50 AS pressure_psi, {K} / 1000.0 AS leak_rate_psi_min,
        CASE WHEN value + 50 >= 130 AND {K} / 1000.0 < 0.1 THEN 'PASS' ELSE 'FAIL' END AS result_raw,
        ts AS recorded_at FROM events""",
    "test_proc_sections": """SELECT CAST(id * 10 + sn AS INTEGER) AS id, id AS procedure_id, CAST(sn AS INTEGER) AS order_index,
        CASE WHEN sn = 1 THEN 'Checks' ELSE 'Measurements' END AS title,
        CASE WHEN sn = 1 THEN 'manual' ELSE 'auto' END AS section_type
        FROM test_procedures, (VALUES (1), (2)) v(sn)""",
    "test_proc_steps": """SELECT CAST(p.id * 100 + o AS INTEGER) AS id, CAST(p.id * 10 + sn AS INTEGER) AS section_id,
        CAST(o AS INTEGER) AS order_index, ty AS step_type, 'Step ' || CAST(o AS VARCHAR) AS label,
        CASE WHEN o = 5 AND p.id % 2 = 0 THEN printf('{"lower": %d, "upper": 40}', p.id + 10)
             WHEN o = 5 THEN printf('{"lower": %d}', p.id + 10)
             WHEN o = 6 THEN '{"upper": 5}' ELSE '{}' END AS tolerances_json,
        m AS is_mandatory,
        CASE WHEN o = 6 THEN printf('{"step_id": %d, "value": "Pass"}', p.id * 100 + 3) END AS condition_json
        FROM test_procedures p, (VALUES (1, 1, 'instruction', TRUE), (2, 1, 'ok_check', TRUE), (3, 1, 'pass_fail', FALSE),
            (4, 1, 'text', FALSE), (5, 2, 'number', TRUE), (6, 2, 'number', TRUE), (7, 2, 'instruction', TRUE)) t(o, sn, ty, m)""",
    "test_run_responses": """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
            CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS id,
        l_orderkey AS run_id, CAST((o_custkey % 8) * 100 + l_linenumber AS INTEGER) AS step_id,
        CASE l_linenumber
            WHEN 2 THEN CASE WHEN l_returnflag = 'A' THEN 'NOT OK' ELSE 'OK' END
            WHEN 3 THEN CASE WHEN l_returnflag = 'R' THEN 'Fail' WHEN CAST(l_quantity AS INTEGER) % 10 = 0 THEN '' ELSE 'Pass' END
            WHEN 4 THEN CASE WHEN CAST(l_quantity AS INTEGER) % 3 = 0 THEN '' ELSE 'note ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END
            WHEN 5 THEN CASE WHEN l_partkey % 17 = 0 THEN 'n/a'
                             WHEN l_partkey % 19 = 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'mm'
                             ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END
            WHEN 6 THEN CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR)
            ELSE '' END AS value,
        CAST(l_shipdate AS TIMESTAMP) AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "field_work_orders": """SELECT 'WO-' || CAST(o_orderkey AS VARCHAR) AS work_order_id, 'RIG-' || CAST(o_custkey % 6 AS VARCHAR) AS rig_id,
        'EQ-' || CAST(o_custkey % 30 AS VARCHAR) AS equipment_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'P1' WHEN '2-HIGH' THEN 'P2' ELSE 'P3' END AS priority,
        CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status,
        CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 + 14 AS INTEGER) AS due_date,
        CAST(o_orderkey % 40 + 1 AS INTEGER) AS estimated_hours, CAST(o_orderdate AS DATE) AS created_date FROM orders""",
    "calibration_records": """SELECT 'CAL-' || CAST(o_orderkey AS VARCHAR) AS cal_id, 'EQ-' || CAST(o_custkey % 30 AS VARCHAR) AS equipment_id,
        CAST(o_orderdate AS DATE) AS cal_date,
        (['Initial', 'Periodic', 'Post_Repair', 'Pre_Deployment', 'Annual'])[CAST(o_orderkey % 5 + 1 AS INTEGER)] AS cal_type,
        CASE o_orderstatus WHEN 'F' THEN 'Pass' WHEN 'O' THEN 'Pass_With_Adjustment' ELSE 'Fail' END AS cal_result FROM orders""",
    "daily_reports": """SELECT 'RPT-' || CAST(o_orderkey AS VARCHAR) AS report_id, 'RIG-' || CAST(o_custkey % 6 AS VARCHAR) AS rig_id,
        CAST(o_orderdate AS DATE) AS report_date,
        CASE WHEN o_orderstatus = 'P' THEN CAST((o_orderkey % 7) * 0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS npdt_hours,
        CAST(o_orderkey % 3 AS INTEGER) AS wells_tested, floor(o_totalprice) / 100.0 AS oil_produced_bbl,
        floor(o_totalprice / 1000) / 100.0 AS gas_produced_mmscf,
        CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS hse_events FROM orders""",
    "equipment_health": f"""SELECT 'EH-' || CAST(event_id AS VARCHAR) AS health_id, 'EQ-' || CAST(user_id % 30 AS VARCHAR) AS equipment_id,
        ts AS snapshot_ts, floor((value % 60 + 40) * 10 + 0.5) / 10 AS overall_health_score,
        CASE WHEN {K} % 3 = 0 THEN NULL ELSE 'FC-00' || CAST({K} % 5 + 1 AS VARCHAR) END AS fault_code FROM events""",
    "reading_enhancements": f"""SELECT event_id * 10 + j AS id, event_id AS bronze_reading_id, 'M-' || CAST(user_id % 18 AS VARCHAR) AS machine_id,
        CAST((k + j) % 11 AS INTEGER) AS technician_id,
        CASE (k + j) % 3 WHEN 0 THEN '{{"result": "PASS"}}' WHEN 1 THEN '{{"result": "FAIL"}}' ELSE '{{}}' END AS override_values,
        CAST((k + j) % 5 + 1 AS INTEGER) AS confidence_in_data, ts + to_seconds(CAST((j + 1) * 1800 AS BIGINT)) AS created_at
        FROM (SELECT event_id, user_id, ts, {K} AS k FROM events WHERE {K} % 4 = 0) e,
             LATERAL (SELECT unnest(range(0, k % 3 + 1)) AS j) r""",
    "inspection_decisions": """SELECT vec_id AS image_id, label % 2 = 1 AS defective,
        CASE WHEN label % 2 = 0 THEN NULL WHEN label % 4 = 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
        CASE WHEN label % 2 = 0 THEN NULL WHEN label % 4 = 3 THEN 'SCRAP' ELSE 'REWORK' END AS decision FROM embeddings""",
}

# which bindings read other bindings (derived inputs)
DEPENDS: dict[str, list[str]] = {
    "test_proc_sections": ["test_procedures"],
    "test_proc_steps": ["test_procedures"],
}


def with_bindings(names: list[str], ctes: list[tuple[str, str]], final: str) -> str:
    """``WITH <bindings>, <ctes> <final>`` with dependencies first, each binding once."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({BINDINGS[n]})" for n in order] + [f"{n} AS ({body})" for n, body in ctes]
    head = final.lstrip()
    if parts and head[:5].upper() == "WITH ":
        # the final query has CTEs of its own: splice them after ours
        return "WITH " + ",\n".join(parts) + ",\n" + head[5:]
    return ("WITH " + ",\n".join(parts) + "\n" + final) if parts else final

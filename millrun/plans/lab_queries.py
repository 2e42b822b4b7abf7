"""Lab queries with DuckDB oracles (the oracle keeps the reference's LEFT JOIN + BOOL_OR and
UNION ALL forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrun.operators import lab as L
from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.registry import query
from millrun.sources import bindings as B

AS_OF = B.LAB_AS_OF
TS = f"TIMESTAMP '{AS_OF}'"


def HD(num: str, den: str, d: int) -> str:
    return f"(floor((({num}) * {2 * 10**d} + ({den})) / (({den}) * 2)) / {10**d})"


FAIL_EXPR = " OR ".join(f"lower(coalesce(ir.{c}, '')) IN ('fail', 'f')" for c in L.PIECES)
SQL_PF = f"""SELECT r.id, r.product, r.machinist, r.operation, r.inspection_date, r.status, count(ir.id) AS row_count,
        coalesce(bool_or({FAIL_EXPR}), FALSE) AS has_fail
    FROM inspection_records r LEFT JOIN inspection_rows ir ON ir.record_id = r.id
    GROUP BY r.id, r.product, r.machinist, r.operation, r.inspection_date, r.status"""
INSP = ["inspection_records", "inspection_rows"]


def _pf(t):
    return L.record_pass_fail(B.inspection_records(t), B.inspection_rows(t))


@query("inspection_pass_fail", W(INSP, [], SQL_PF))
def q_inspection_pass_fail(t):
    """A33 + J13."""
    return _pf(t)


@query(
    "inspection_totals",
    W(INSP, [("pf", SQL_PF)],
      f"""SELECT count(*) AS total, count_if(NOT has_fail) AS passed, count_if(has_fail) AS failed,
          CASE WHEN count(*) > 0 THEN {HD("count_if(NOT has_fail) * 100", "count(*)", 1)} END AS pass_rate,
          CASE WHEN count(*) > 0 THEN {HD("sum(row_count)", "count(*)", 1)} END AS avg_rows,
          count(DISTINCT product) AS distinct_products FROM pf"""),
)
def q_inspection_totals(t):
    """A34."""
    return L.inspection_totals(_pf(t))


_DIM = " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, {d} AS value, count(*) AS total, count_if(NOT has_fail) AS passed,
        count_if(has_fail) AS failed FROM pf WHERE {d} IS NOT NULL GROUP BY {d}"""
    for d in ("product", "machinist", "operation")
)


@query(
    "inspection_by_dimension",
    W(INSP, [("pf", SQL_PF), ("u", _DIM)],
      f"""SELECT dimension, value, total, passed, failed, {HD("passed * 100", "total", 1)} AS pass_rate
          FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, value) AS r FROM u) x
          WHERE dimension <> 'product' OR r <= 10"""),
)
def q_inspection_by_dimension(t):
    """A35 as one GROUPING SETS pass (product top 10)."""
    return L.inspection_by_dimension(_pf(t))


@query(
    "quality_trend_30d",
    W(INSP + ["test_runs"], [],
      f"""WITH ipf AS (SELECT r.inspection_date AS day, coalesce(bool_or({FAIL_EXPR}), FALSE) AS has_fail
            FROM inspection_records r LEFT JOIN inspection_rows ir ON ir.record_id = r.id
            WHERE r.inspection_date >= CAST({TS} AS DATE) - 30 GROUP BY r.id, r.inspection_date),
          i AS (SELECT day, count_if(NOT has_fail) AS i_passed, count_if(has_fail) AS i_failed FROM ipf GROUP BY day),
          rd AS (SELECT CAST(created_at AS DATE) AS day, count_if(status = 'completed') AS r_passed,
                        count_if(status = 'failed') AS r_failed FROM test_runs
                 WHERE created_at >= CAST(CAST({TS} AS DATE) - 30 AS TIMESTAMP) AND status IN ('completed', 'failed')
                 GROUP BY 1)
        SELECT CAST(coalesce(i.day, rd.day) AS VARCHAR) AS day,
            coalesce(i.i_passed, 0) + coalesce(rd.r_passed, 0) AS passed,
            coalesce(i.i_failed, 0) + coalesce(rd.r_failed, 0) AS failed,
            coalesce(i.i_passed, 0) + coalesce(rd.r_passed, 0) + coalesce(i.i_failed, 0) + coalesce(rd.r_failed, 0) AS total
        FROM i FULL OUTER JOIN rd ON i.day = rd.day"""),
)
def q_quality_trend_30d(t):
    """A36 + J12."""
    return L.quality_trend(B.inspection_records(t), B.inspection_rows(t), B.test_runs(t), AS_OF)


_RECENT = f"created_at >= CAST(CAST({TS} AS DATE) - 7 AS TIMESTAMP) AND status IN ('completed', 'failed')"


@query(
    "test_run_by_procedure",
    W(["test_runs", "test_procedures"], [],
      f"""SELECT p.id AS procedure_id, p.name AS procedure_name, p.product_type, count(*) AS total,
          count_if(r.status = 'completed') AS passed, count_if(r.status = 'failed') AS failed,
          {HD("count_if(r.status = 'completed') * 100", "count(*)", 1)} AS pass_rate
          FROM test_runs r JOIN test_procedures p ON p.id = r.procedure_id WHERE r.{_RECENT.replace(' AND status', ' AND r.status')}
          GROUP BY p.id, p.name, p.product_type"""),
)
def q_test_run_by_procedure(t):
    """A37 + J15 (last 7 days)."""
    return L.test_run_by_procedure(B.test_runs(t), B.test_procedures(t), AS_OF)


@query(
    "test_run_totals_7d",
    W(["test_runs"], [],
      f"""SELECT count(*) AS total, count_if(status = 'completed') AS passed, count_if(status = 'failed') AS failed,
          CASE WHEN count(*) > 0 THEN {HD("count_if(status = 'completed') * 100", "count(*)", 1)} END AS pass_rate FROM test_runs WHERE {_RECENT}"""),
)
def q_test_run_totals_7d(t):
    """A37 (totals)."""
    return L.test_run_totals(B.test_runs(t), AS_OF)


@query(
    "test_run_trend_7d",
    W(["test_runs"], [],
      f"""SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS total, count_if(status = 'completed') AS passed,
          count_if(status = 'failed') AS failed, {HD("count_if(status = 'completed') * 100", "count(*)", 1)} AS pass_rate
          FROM test_runs WHERE {_RECENT} GROUP BY 1"""),
)
def q_test_run_trend_7d(t):
    """A37 (by day)."""
    return L.test_run_trend(B.test_runs(t), AS_OF)


@query(
    "schedule_summary",
    W(["test_schedule"], [],
      f"""SELECT count(*) FILTER (WHERE status = 'scheduled') AS scheduled_count,
          count(*) FILTER (WHERE status = 'in_progress') AS in_progress_count,
          count(*) FILTER (WHERE status = 'completed' AND completed_at >= {TS} - INTERVAL 24 HOUR) AS completed_today,
          count(*) FILTER (WHERE priority = 'critical' AND status IN ('scheduled', 'in_progress')) AS critical_pending
          FROM test_schedule"""),
)
def q_schedule_summary(t):
    """A38."""
    return L.schedule_summary(B.test_schedule(t), AS_OF)


@query(
    "technician_load",
    W(["technicians", "test_schedule"], [],
      f"""SELECT t.id, t.name, t.specialty,
          count(s.id) FILTER (WHERE s.status IN ('scheduled', 'in_progress')) AS active_tests,
          count(s.id) FILTER (WHERE s.status = 'completed' AND s.completed_at >= {TS} - INTERVAL 24 HOUR) AS completed_today
          FROM technicians t LEFT JOIN test_schedule s ON s.technician_id = t.id WHERE t.is_active
          GROUP BY t.id, t.name, t.specialty"""),
)
def q_technician_load(t):
    """A39."""
    return L.technician_load(B.technicians(t), B.test_schedule(t), AS_OF)


@query(
    "workload_hours",
    W(["test_schedule"], [],
      """SELECT priority, coalesce(machine_id, 'unassigned') AS machine_id, count(*) AS outstanding,
         CAST(sum(est_minutes) AS DOUBLE) / 60.0 AS hours FROM test_schedule
         WHERE status IN ('scheduled', 'in_progress') GROUP BY 1, 2"""),
)
def q_workload_hours(t):
    """A40."""
    return L.workload_hours(B.test_schedule(t))


@query(
    "reading_stats",
    W(["pressure_readings"], [],
      f"""SELECT test_type, count(*) AS total_readings, count_if(result_raw = 'PASS') AS pass_count,
          count_if(result_raw = 'FAIL') AS fail_count, {HD("count_if(result_raw = 'PASS') * 100", "count(*)", 1)} AS pass_rate_pct,
          quantile_cont(pressure_psi, 0.95) AS p95_pressure_psi FROM pressure_readings GROUP BY test_type"""),
)
def q_reading_stats(t):
    """A41 + P29 per test type."""
    return L.reading_stats(B.pressure_readings(t))


@query(
    "records_without_rows",
    W(INSP, [], """SELECT * FROM inspection_records r
        WHERE NOT EXISTS (SELECT 1 FROM inspection_rows ir WHERE ir.record_id = r.id)"""),
)
def q_records_without_rows(t):
    """NOT EXISTS as a left anti join."""
    return L.records_without_rows(B.inspection_records(t), B.inspection_rows(t))


_TXT = ", ".join(f"coalesce(CAST(ir.{c} AS VARCHAR), '') AS {c}" for c in L.PIECES)


@query(
    "inspection_export",
    W(INSP, [],
      f"""SELECT dense_rank() OVER (ORDER BY r.id) AS record_group, r.id AS record_id,
          coalesce(r.product, '') AS product, coalesce(r.machinist, '') AS machinist, coalesce(r.operation, '') AS operation,
          coalesce(CAST(r.inspection_date AS VARCHAR), '') AS inspection_date, coalesce(ir.id, '') AS row_id, {_TXT}
          FROM inspection_records r LEFT JOIN inspection_rows ir ON ir.record_id = r.id"""),
)
def q_inspection_export(t):
    """IO14 + W9: export rows with a distributed dense record-group number."""
    return L.export_rows(B.inspection_records(t), B.inspection_rows(t))


# ---- test procedures: P30 / P31 / W10 / A42 ------------------------------------------------------
STEP_BINDS = ["test_runs", "test_procedures", "test_proc_sections", "test_proc_steps", "test_run_responses"]
SQL_STEP_RESULTS = f"""WITH latest AS (
        SELECT run_id, step_id, value FROM (
            SELECT run_id, step_id, value, row_number() OVER (
                PARTITION BY run_id, step_id ORDER BY created_at DESC, id DESC, value DESC) AS rn
            FROM test_run_responses) x WHERE rn = 1),
    st AS (SELECT s.id AS step_id, s.section_id, sec.procedure_id, s.order_index, s.step_type, s.is_mandatory,
                  TRY_CAST(json_extract_string(s.tolerances_json, '$.lower') AS DOUBLE) AS lo,
                  TRY_CAST(json_extract_string(s.tolerances_json, '$.upper') AS DOUBLE) AS hi,
                  CAST(json_extract_string(s.condition_json, '$.step_id') AS INTEGER) AS c_step,
                  json_extract_string(s.condition_json, '$.value') AS c_value
           FROM test_proc_steps s JOIN test_proc_sections sec ON s.section_id = sec.id),
    j AS (SELECT r.id AS run_id, r.procedure_id, r.status, st.step_id, st.section_id, st.order_index, st.step_type,
                 st.is_mandatory, st.lo, st.hi, st.c_step, st.c_value, l.value
          FROM test_runs r JOIN st ON st.procedure_id = r.procedure_id
          LEFT JOIN latest l ON l.run_id = r.id AND l.step_id = st.step_id),
    v AS (SELECT j.*, CASE WHEN j.c_step IS NULL THEN TRUE ELSE coalesce(c.value = j.c_value, FALSE) END AS visible,
                 TRY_CAST(regexp_extract(j.value, '{L.LEADING_NUMBER}', 1) AS DOUBLE) AS x
          FROM j LEFT JOIN latest c ON c.run_id = j.run_id AND c.step_id = j.c_step)
    SELECT run_id, procedure_id, status, section_id, step_id, order_index, step_type, is_mandatory,
        coalesce(value, '') AS value, visible,
        CASE WHEN step_type = 'instruction' OR value IS NULL OR value = '' THEN NULL
             WHEN step_type = 'ok_check' THEN value = 'OK'
             WHEN step_type = 'pass_fail' THEN value = 'Pass'
             WHEN step_type IN ('radio', 'text') THEN length(value) > 0
             WHEN step_type IN ('number', 'auto_number') THEN
                 CASE WHEN x IS NULL THEN NULL ELSE NOT (lo IS NOT NULL AND x < lo) AND NOT (hi IS NOT NULL AND x > hi) END
        END AS passed,
        CASE WHEN NOT visible THEN NULL
             WHEN step_type = 'instruction' THEN CAST(sum(CASE WHEN step_type = 'instruction' AND visible THEN 1 ELSE 0 END)
                 OVER (PARTITION BY run_id, section_id ORDER BY order_index ROWS UNBOUNDED PRECEDING) AS INTEGER)
             ELSE CAST(row_number() OVER (PARTITION BY run_id, section_id ORDER BY order_index) AS INTEGER)
        END AS step_number
    FROM v"""
SQL_SECTION_PROGRESS = """SELECT run_id, section_id,
        count_if(step_type <> 'instruction' AND is_mandatory AND visible) AS mandatory_steps,
        count_if(step_type <> 'instruction' AND is_mandatory AND visible AND length(trim(value)) > 0) AS completed_mandatory,
        count_if(step_type <> 'instruction' AND is_mandatory AND visible) > 0
            AND count_if(step_type <> 'instruction' AND is_mandatory AND visible AND NOT coalesce(passed, FALSE)) = 0
            AS section_passed
    FROM sr GROUP BY run_id, section_id"""


def _steps(t):
    return L.step_results(B.test_runs(t), B.test_proc_sections(t), B.test_proc_steps(t), B.test_run_responses(t))


@query("test_step_results", W(STEP_BINDS, [], SQL_STEP_RESULTS))
def q_test_step_results(t):
    """P30 + P31 + W10: every step of every run with its newest response, visibility, pass flag and number."""
    return _steps(t)


@query("test_section_progress", W(STEP_BINDS, [("sr", SQL_STEP_RESULTS)], SQL_SECTION_PROGRESS))
def q_test_section_progress(t):
    """A42 per run x section: visible mandatory steps, answered, section pass."""
    return L.section_progress(_steps(t))


@query(
    "test_run_completion",
    W(STEP_BINDS, [("sr", SQL_STEP_RESULTS), ("sp", SQL_SECTION_PROGRESS)],
      """WITH g AS (SELECT run_id, procedure_id, status, count_if(step_type <> 'instruction') AS data_steps,
                        count_if(step_type <> 'instruction' AND coalesce(passed, FALSE)) AS passed_steps,
                        count_if(step_type <> 'instruction' AND is_mandatory AND visible AND NOT coalesce(passed, FALSE)) = 0
                            AS run_passed,
                        count_if(step_type <> 'instruction' AND is_mandatory AND NOT coalesce(passed, FALSE)) = 0
                            AS run_passed_all_mandatory
                 FROM sr GROUP BY run_id, procedure_id, status),
            s AS (SELECT run_id, count(*) AS sections, count_if(section_passed) AS sections_passed FROM sp GROUP BY run_id)
         SELECT g.run_id, procedure_id, status, data_steps, passed_steps, sections, sections_passed, run_passed,
                run_passed_all_mandatory FROM g JOIN s ON g.run_id = s.run_id"""),
)
def q_test_run_completion(t):
    """A42 per run: data / passed steps, sections passed, run pass (visible mandatory; Q16 fixed) and the
    faithful all-mandatory form beside the stored status (Q15)."""
    return L.run_completion(_steps(t))


# ---- J17 overlay, A58 failed records, S4 page, S5 recent across machines ---------------------------
@query(
    "reading_overlay",
    W(["pressure_readings", "reading_enhancements"], [],
      """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bronze_reading_id ORDER BY created_at DESC, id DESC) AS rn,
                                         count(*) OVER (PARTITION BY bronze_reading_id) AS n FROM reading_enhancements) x WHERE rn = 1),
            j AS (SELECT r.*, l.id AS enhancement_id, l.technician_id, l.confidence_in_data, l.n,
                         json_extract_string(l.override_values, '$.result') AS ov
                  FROM pressure_readings r LEFT JOIN l ON l.bronze_reading_id = r.reading_id)
         SELECT reading_id, machine_id, recorded_at, result_raw, enhancement_id, technician_id, confidence_in_data,
                coalesce(n, 0) AS enhancements, CASE WHEN ov IN ('PASS', 'FAIL') THEN ov END AS override_result,
                coalesce(CASE WHEN ov IN ('PASS', 'FAIL') THEN ov END, result_raw) AS effective_result FROM j"""),
)
def q_reading_overlay(t):
    """Readings with their newest enhancement and the overridden (effective) result."""
    return L.latest_overlay(B.pressure_readings(t), B.reading_enhancements(t))


@query(
    "failed_inspection_records",
    W(INSP, [("pf", SQL_PF)], "SELECT * FROM pf WHERE has_fail ORDER BY inspection_date DESC, id DESC LIMIT 500"),
)
def q_failed_inspection_records(t):
    """Failing records only (HAVING after the grouped pass/fail), newest first, page of 500."""
    return L.failed_records(_pf(t), 500)


@query(
    "readings_page",
    W(["pressure_readings"], [], "SELECT * FROM pressure_readings ORDER BY recorded_at DESC, reading_id DESC LIMIT 50 OFFSET 50"),
)
def q_readings_page(t):
    """The second page (50 rows) of readings, newest first."""
    return L.readings_page(B.pressure_readings(t), 50, 50)


@query(
    "recent_readings",
    W(["pressure_readings"], [], "SELECT * FROM pressure_readings ORDER BY recorded_at DESC, reading_id DESC LIMIT 60"),
)
def q_recent_readings(t):
    """The newest 60 readings over all machines (per-machine top-n + merge = one TakeOrdered)."""
    return L.recent_across(B.pressure_readings(t), 60)


# ---- J16 documents -------------------------------------------------------------------------------------
def _sections(t):
    """The bound sections and, for even procedures, a last one without steps."""
    sec = B.test_proc_sections(t)
    last = B.test_procedures(t).filter("id % 2 = 0").select(
        (F.col("id") * 10 + 3).cast("int").alias("id"), F.col("id").alias("procedure_id"), F.lit(3).alias("order_index"),
        F.lit("Sign-off").alias("title"), F.lit(None).cast("string").alias("section_type"))
    return sec.unionByName(last)


_SECTIONS = """SELECT * FROM test_proc_sections UNION ALL
    SELECT CAST(id * 10 + 3 AS INTEGER), id, 3, 'Sign-off', NULL FROM test_procedures WHERE id % 2 = 0"""
_NESTED = """SELECT s.procedure_id, count(DISTINCT s.id) AS n_sections, sum(n)::BIGINT AS n_steps,
        list({'order_index': s.order_index, 'id': s.id, 'title': title, 'section_type': section_type, 'steps': coalesce(steps, [])} ORDER BY s.order_index) AS sections
    FROM secs s LEFT JOIN (SELECT section_id, list({'order_index': order_index, 'id': id, 'step_type': step_type, 'label': label,
                                  'is_mandatory': is_mandatory} ORDER BY order_index) AS steps FROM test_proc_steps GROUP BY 1) x ON s.id = x.section_id
    LEFT JOIN (SELECT section_id, count(*) AS n FROM test_proc_steps GROUP BY 1) c ON s.id = c.section_id GROUP BY 1"""
_DOC_BINDS = ["test_procedures", "test_proc_sections", "test_proc_steps"]


@query(
    "procedure_documents",
    W(_DOC_BINDS, [("secs", _SECTIONS), ("nested", _NESTED)],
      """SELECT id AS procedure_id, CAST(coalesce(n_sections, 0) AS INTEGER) AS n_sections, coalesce(n_steps, 0) AS n_steps,
                CAST(to_json({'id': id, 'name': name, 'product_type': product_type, 'sections': sections}) AS VARCHAR) AS document
         FROM test_procedures p LEFT JOIN nested n ON p.id = n.procedure_id"""),
)
def q_procedure_documents(t):
    """Procedure -> sections -> steps, with sections that have none."""
    return L.procedure_documents(B.test_procedures(t), _sections(t), B.test_proc_steps(t))


@query(
    "run_documents",
    W([*_DOC_BINDS, "test_runs", "test_run_responses"], [("secs", _SECTIONS), ("nested", _NESTED)],
      """WITH newest AS (SELECT run_id, step_id, value, count(*) OVER (PARTITION BY run_id) AS n_responses,
                                row_number() OVER (PARTITION BY run_id, step_id ORDER BY created_at DESC, id DESC, value DESC) AS r FROM test_run_responses),
            answers AS (SELECT run_id, any_value(n_responses) AS n_responses, list({'step_id': step_id, 'value': value} ORDER BY step_id) AS responses
                        FROM newest WHERE r = 1 GROUP BY 1)
         SELECT r.id AS run_id, coalesce(n_responses, 0) AS n_responses,
                CAST(to_json({'id': r.id, 'procedure_id': r.procedure_id, 'procedure_name': p.name, 'status': r.status,
                              'responses': coalesce(responses, []), 'sections': sections}) AS VARCHAR) AS document
         FROM test_runs r JOIN test_procedures p ON p.id = r.procedure_id LEFT JOIN nested n ON n.procedure_id = p.id
         LEFT JOIN answers a ON a.run_id = r.id"""),
)
def q_run_documents(t):
    """Run -> responses and its procedure's sections -> steps."""
    return L.run_documents(B.test_runs(t), B.test_procedures(t), _sections(t), B.test_proc_steps(t), B.test_run_responses(t))

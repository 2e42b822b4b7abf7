"""Test-lab analytics.

Record-level pass/fail pre-aggregates the child rows per record (map-side partial aggregate)
before joining the headers, so the join carries one row per record. The per-dimension
breakdown is one GROUPING SETS pass instead of three scans. The export's dense group number is
counted by range slices of the distinct ids, never with one un-partitioned window over all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.operators.ordinals import ordinal_within
from millrun.operators.quantiles import quantile

# Piece columns of an inspection row, and the texts that mean failure.
PIECES = ("piece_1st", "piece_5th", "piece_10th", "piece_15th", "piece_20th", "piece_25th", "piece_30th", "piece_35th", "piece_iqa")
FAIL_TEXTS = ("fail", "f")


def _half_up_div(num: Column, den: Column, digits: int) -> Column:
    scale = 10**digits
    return F.floor((num * (2 * scale) + den) / (den * 2)) / scale


def _ts(x: str) -> Column:
    return F.lit(x).cast("timestamp")


def row_fails(pieces=PIECES) -> Column:
    """A row fails when any piece text, lower-cased, is a failure text (NULL counts as blank)."""
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*FAIL_TEXTS) for c in pieces])


def record_pass_fail(records: DataFrame, rows: DataFrame) -> DataFrame:
    """A33 + J13: per record its row count and whether any row fails (no rows -> 0 / false)."""
    per = rows.groupBy("record_id").agg(F.count("id").alias("row_count"), F.max(row_fails().cast("int")).alias("f"))
    j = records.join(per, records.id == per.record_id, "left")
    return j.select(
        "id", "product", "machinist", "operation", "inspection_date", "status",
        F.coalesce(F.col("row_count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.col("f") == 1, F.lit(False)).alias("has_fail"),
    )


def inspection_totals(pf: DataFrame) -> DataFrame:
    """A34."""
    failed = F.count_if(F.col("has_fail"))
    return pf.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("has_fail")).alias("passed"), failed.alias("failed"),
        F.sum("row_count").alias("_rows"), F.countDistinct("product").alias("distinct_products"),
    ).select(
        "total", "passed", "failed",
        F.when(F.col("total") > 0, _half_up_div(F.col("passed") * 100, F.col("total"), 1)).alias("pass_rate"),
        F.when(F.col("total") > 0, _half_up_div(F.col("_rows"), F.col("total"), 1)).alias("avg_rows"),
        "distinct_products",
    )


def inspection_by_dimension(pf: DataFrame, top_products: int = 10) -> DataFrame:
    """Totals by product (top n by total), machinist and operation in one GROUPING SETS pass.
    Each dimension drops its own NULLs (Q17)."""
    dims = ["product", "machinist", "operation"]
    g = pf.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("has_fail")).alias("passed"),
        F.count_if(F.col("has_fail")).alias("failed"),
    )
    # grouping_id bits: product 4, machinist 2, operation 1 (a bit is set when the column is rolled up)
    dim = F.when(F.col("gid") == 3, F.lit("product")).when(F.col("gid") == 5, F.lit("machinist")).otherwise(F.lit("operation"))
    val = F.when(F.col("gid") == 3, F.col("product")).when(F.col("gid") == 5, F.col("machinist")).otherwise(F.col("operation"))
    g = g.select(dim.alias("dimension"), val.alias("value"), "total", "passed", "failed").filter(F.col("value").isNotNull())
    # Products share one group and are cut to n in each task before the shuffle; any other value is its own group.
    group = F.when(F.col("dimension") != "product", F.col("value"))
    rank = F.row_number().over(Window.partitionBy("dimension", group).orderBy(F.desc("total"), F.asc("value")))
    g = g.withColumn("_r", rank).filter(F.col("_r") <= top_products).drop("_r")
    return g.withColumn("pass_rate", _half_up_div(F.col("passed") * 100, F.col("total"), 1))


def quality_trend(records: DataFrame, rows: DataFrame, runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """A36 + J12: daily passed / failed over the last ``days`` days, inspections and completed or
    failed test runs merged by a full outer join on the day."""
    start = F.date_sub(_ts(as_of).cast("date"), days)
    rec = records.filter(F.col("inspection_date") >= start)
    pf = record_pass_fail(rec, rows)
    i = pf.groupBy(F.col("inspection_date").alias("day")).agg(
        F.count_if(~F.col("has_fail")).alias("i_passed"), F.count_if(F.col("has_fail")).alias("i_failed"))
    r = runs.filter((F.col("created_at") >= start.cast("timestamp")) & F.col("status").isin("completed", "failed")).groupBy(
        F.to_date("created_at").alias("day")).agg(
        F.count_if(F.col("status") == "completed").alias("r_passed"), F.count_if(F.col("status") == "failed").alias("r_failed"))
    j = i.join(r, "day", "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        F.col("day").cast("string").alias("day"),
        (z("i_passed") + z("r_passed")).alias("passed"),
        (z("i_failed") + z("r_failed")).alias("failed"),
        (z("i_passed") + z("r_passed") + z("i_failed") + z("r_failed")).alias("total"),
    )


def _recent_runs(runs: DataFrame, as_of: str, days: int) -> DataFrame:
    start = F.date_sub(_ts(as_of).cast("date"), days).cast("timestamp")
    return runs.filter((F.col("created_at") >= start) & F.col("status").isin("completed", "failed"))


def _run_counts(df: DataFrame, *keys) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), done.alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"),
    ).withColumn("pass_rate", _half_up_div(F.col("passed") * 100, F.col("total"), 1))


def test_run_by_procedure(runs: DataFrame, procedures: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """A37 + J15: last-week runs per procedure (inner join to the procedure dimension)."""
    r = _recent_runs(runs, as_of, days).join(procedures.withColumnRenamed("id", "procedure_id"), "procedure_id")
    return _run_counts(r, "procedure_id", F.col("name").alias("procedure_name"), "product_type")


def test_run_totals(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Last-week totals, one row also without any run (the rate is NULL then)."""
    done = F.count_if(F.col("status") == "completed")
    g = _recent_runs(runs, as_of, days).agg(F.count(F.lit(1)).alias("total"), done.alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return g.withColumn("pass_rate", F.when(F.col("total") > 0, _half_up_div(F.col("passed") * 100, F.col("total"), 1)))


def test_run_trend(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Last-week runs per day."""
    return _run_counts(_recent_runs(runs, as_of, days), F.to_date("created_at").cast("string").alias("day"))


def schedule_summary(schedule: DataFrame, as_of: str) -> DataFrame:
    """COUNT(*) FILTER by status, last 24 h completions and critical pending."""
    recent = F.col("completed_at") >= _ts(as_of) - F.expr("INTERVAL 24 HOURS")
    pending = F.col("status").isin("scheduled", "in_progress")
    return schedule.agg(
        F.count_if(F.col("status") == "scheduled").alias("scheduled_count"),
        F.count_if(F.col("status") == "in_progress").alias("in_progress_count"),
        F.count_if((F.col("status") == "completed") & recent).alias("completed_today"),
        F.count_if((F.col("priority") == "critical") & pending).alias("critical_pending"),
    )


def technician_load(techs: DataFrame, schedule: DataFrame, as_of: str) -> DataFrame:
    """Active and last-24h completed tests per active technician; zero kept (left join)."""
    recent = F.col("completed_at") >= _ts(as_of) - F.expr("INTERVAL 24 HOURS")
    per = schedule.groupBy("technician_id").agg(
        F.count_if(F.col("status").isin("scheduled", "in_progress")).alias("active_tests"),
        F.count_if((F.col("status") == "completed") & recent).alias("completed_today"),
    )
    t = techs.filter(F.col("is_active"))
    j = t.join(per, t.id == per.technician_id, "left")
    return j.select("id", "name", "specialty", F.coalesce("active_tests", F.lit(0)).alias("active_tests"),
                    F.coalesce("completed_today", F.lit(0)).alias("completed_today"))


def workload_hours(schedule: DataFrame) -> DataFrame:
    """Outstanding tests and hours (minutes / 60) by priority and machine (NULL -> unassigned)."""
    o = schedule.filter(F.col("status").isin("scheduled", "in_progress"))
    return o.groupBy("priority", F.coalesce("machine_id", F.lit("unassigned")).alias("machine_id")).agg(
        F.count(F.lit(1)).alias("outstanding"), (F.sum("est_minutes") / 60.0).alias("hours"))


def reading_stats(readings: DataFrame, by_type: bool = True, p95_of: str = "pressure_psi") -> DataFrame:
    """A41 + P29: total, PASS, FAIL, pass % and the 95th percentile of ``p95_of`` (optionally per test type)."""
    keys = ["test_type"] if by_type else []
    g = readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_readings"),
        F.count_if(F.col("result_raw") == "PASS").alias("pass_count"),
        F.count_if(F.col("result_raw") == "FAIL").alias("fail_count"),
    )
    g = g.withColumn("pass_rate_pct", _half_up_div(F.col("pass_count") * 100, F.col("total_readings"), 1))
    p95 = quantile(readings, keys, p95_of, 0.95, f"p95_{p95_of}")
    if not by_type:
        return g.join(p95, F.lit(True), "left")  # one row each
    return g.join(p95.withColumnRenamed("test_type", "_type"), F.col("test_type").eqNullSafe(F.col("_type")), "left").drop("_type")


def records_without_rows(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Records that have no inspection rows (NOT EXISTS as a left anti join)."""
    return records.join(rows, records.id == rows.record_id, "left_anti")


def dense_index(ids: DataFrame, id_col: str, out: str = "group_no") -> DataFrame:
    """W9 at scale: dense rank (1-based) of the distinct values of an id column of any type.

    The distinct ids are numbered by range slices (see ``ordinal_within``), so dense, sparse, hashed and
    text ids spread alike and no task sees them all.
    """
    return ordinal_within(ids.select(id_col).distinct(), [], [id_col], out, base=1, kind="bigint")


def export_rows(records: DataFrame, rows: DataFrame) -> DataFrame:
    """IO14: joined record + row fields as text (NULL -> blank) with a stable record group number."""
    idx = dense_index(records, "id")
    r = rows.withColumnRenamed("id", "row_id")
    j = records.join(idx, "id").join(r, F.col("id") == F.col("record_id"), "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return j.select(
        F.col("group_no").alias("record_group"), F.col("id").alias("record_id"),
        text("product").alias("product"), text("machinist").alias("machinist"), text("operation").alias("operation"),
        text("inspection_date").alias("inspection_date"), text("row_id").alias("row_id"),
        *[text(c).alias(c) for c in PIECES],
    )


def write_csv(df: DataFrame, path: str) -> None:
    """IO14 sink: header CSV, blanks for NULL."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)



# ---- test procedures: step evaluation (P30), visibility (P31), numbering (W10), completion (A42) ----

# The leading-number rule of a browser parseFloat (optional blanks, sign, digits with
# an optional fraction and exponent, or Infinity); anything else is not a number.
LEADING_NUMBER = r"^\s*([+-]?Infinity|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
TOLERANCE_SCHEMA = "lower double, upper double, nominal double"
CONDITION_SCHEMA = "step_id int, value string"


def leading_number(text: Column) -> Column:
    """The number a text starts with ("12mm" -> 12.0), NULL when it starts with none."""
    return F.regexp_extract(text, LEADING_NUMBER, 1).try_cast("double")


def step_passed(step_type: Column, value: Column, lower: Column, upper: Column) -> Column:
    """Instruction or blank -> NULL; ok_check "OK"; pass_fail "Pass"; radio / text non-empty;
    number / auto_number within the optional bounds (NULL when the text is not a number)."""
    n = leading_number(value)
    in_bounds = F.when(n.isNull(), F.lit(None).cast("boolean")).otherwise(
        ~(lower.isNotNull() & (n < lower)) & ~(upper.isNotNull() & (n > upper)))
    return (
        F.when((step_type == "instruction") | value.isNull() | (value == ""), F.lit(None).cast("boolean"))
        .when(step_type == "ok_check", value == "OK")
        .when(step_type == "pass_fail", value == "Pass")
        .when(step_type.isin("radio", "text"), F.length(value) > 0)
        .when(step_type.isin("number", "auto_number"), in_bounds)
    )


def step_results(runs: DataFrame, sections: DataFrame, steps: DataFrame, responses: DataFrame,
                 order_cols=("created_at", "id", "value")) -> DataFrame:
    """P30 + P31 + W10: every step of every run with its latest response, visibility, pass flag
    and displayed number.

    Responses are first reduced to the newest per (run, step) with a hash aggregate (partial per
    map task, so a run answered millions of times never lands in one task). Each run then holds
    at most one row per step of its procedure, which bounds the per-run windows below: the
    response map used by the visibility conditions and the running instruction count.
    The step dimension is a plain join side: AQE broadcasts it from its measured bytes."""
    latest = responses.groupBy("run_id", "step_id").agg(
        F.max_by("value", F.struct(*[F.col(c) for c in order_cols])).alias("value"))
    sec_dim = sections.select(F.col("id").alias("section_id"), "procedure_id")
    st = steps.join(sec_dim, "section_id").select(
        F.col("id").alias("step_id"), "section_id", "procedure_id", "order_index", "step_type", "is_mandatory",
        F.from_json("tolerances_json", TOLERANCE_SCHEMA).alias("tol"),
        F.from_json("condition_json", CONDITION_SCHEMA).alias("cond"),
    )  # procedure x step dimension: parsed once, before the broadcast
    rs = runs.select(F.col("id").alias("run_id"), "procedure_id", "status").join(
        st, "procedure_id")
    j = rs.join(latest, ["run_id", "step_id"], "left")
    answers = F.map_from_entries(F.collect_list(F.struct("step_id", "value")).over(Window.partitionBy("run_id")))
    j = j.withColumn("_answers", answers)
    visible = F.when(F.col("cond").isNull(), F.lit(True)).otherwise(
        F.coalesce(F.element_at("_answers", F.col("cond.step_id")) == F.col("cond.value"), F.lit(False)))
    j = j.withColumn("visible", visible)
    sec = Window.partitionBy("run_id", "section_id").orderBy("order_index")
    instr = (F.col("step_type") == "instruction") & F.col("visible")
    running_instr = F.sum(instr.cast("int")).over(sec.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    position = F.row_number().over(sec)
    number = F.when(~F.col("visible"), F.lit(None).cast("int")).when(
        F.col("step_type") == "instruction", running_instr.cast("int")).otherwise(position)
    return j.select(
        "run_id", "procedure_id", "status", "section_id", "step_id", "order_index", "step_type", "is_mandatory",
        F.coalesce(F.col("value"), F.lit("")).alias("value"),
        "visible",
        step_passed(F.col("step_type"), F.col("value"), F.col("tol.lower"), F.col("tol.upper")).alias("passed"),
        number.alias("step_number"),
    )


def _section_counts(results: DataFrame) -> DataFrame:
    """Per run x section: every count A42 needs, in one aggregate over the run-partitioned steps."""
    data = F.col("step_type") != "instruction"
    ok = F.coalesce(F.col("passed"), F.lit(False))
    mand = data & F.col("is_mandatory")
    mv = mand & F.col("visible")
    return results.groupBy("run_id", "procedure_id", "status", "section_id").agg(
        F.count_if(mv).alias("mandatory_steps"),
        F.count_if(mv & (F.length(F.trim("value")) > 0)).alias("completed_mandatory"),
        F.count_if(mv & ~ok).alias("_bad_visible"),
        F.count_if(mand & ~ok).alias("_bad_all"),
        F.count_if(data).alias("_data"),
        F.count_if(data & ok).alias("_passed"),
    ).withColumn("section_passed", (F.col("mandatory_steps") > 0) & (F.col("_bad_visible") == 0))


def section_progress(results: DataFrame) -> DataFrame:
    """A42 per run x section: visible mandatory data steps, how many are answered (non-blank after
    trim) and whether the section passes (at least one, and every one passes)."""
    return _section_counts(results).select("run_id", "section_id", "mandatory_steps", "completed_mandatory", "section_passed")


def run_completion(results: DataFrame) -> DataFrame:
    """A42 per run: data steps, passed steps, sections passed, and the run verdict. ``run_passed``
    checks the visible mandatory data steps (Q16 fixed); ``run_passed_all_mandatory`` is the
    faithful form that also requires hidden mandatory steps to pass. The stored run status is
    reported beside them, not replaced (Q15). The run rollup is taken over the section rows, so
    both aggregates reuse the run partitioning of the step rows (one pass, no new exchange)."""
    g = _section_counts(results).groupBy("run_id", "procedure_id", "status").agg(
        F.sum("_data").alias("data_steps"),
        F.sum("_passed").alias("passed_steps"),
        F.count(F.lit(1)).alias("sections"),
        F.count_if("section_passed").alias("sections_passed"),
        F.sum("_bad_visible").alias("_bv"),
        F.sum("_bad_all").alias("_ba"),
    )
    return g.select(
        "run_id", "procedure_id", "status", "data_steps", "passed_steps", "sections", "sections_passed",
        (F.col("_bv") == 0).alias("run_passed"),
        (F.col("_ba") == 0).alias("run_passed_all_mandatory"),
    )


# ---- J17 latest overlay ------------------------------------------------------------------------

OVERRIDE_RESULTS = ("PASS", "FAIL")  # fixed values: the result overrides the enhancement form accepts


def latest_overlay(readings: DataFrame, enhancements: DataFrame) -> DataFrame:
    """Each reading with its newest enhancement (created_at, then id) and the effective result,
    i.e. the enhancement's ``override_values.result`` when it is PASS / FAIL, else the machine's.

    The newest enhancement per reading is a ``max_by(struct)`` hash aggregate: partial per map
    task, so a reading enhanced a million times never sits in one task; the left join then
    carries at most one enhancement row per reading."""
    latest = enhancements.groupBy("bronze_reading_id").agg(
        F.max_by(F.struct("id", "technician_id", "override_values", "confidence_in_data", "created_at"),
                 F.struct("created_at", "id")).alias("e"),
        F.count(F.lit(1)).alias("enhancements"),
    )
    j = readings.join(latest, readings.reading_id == latest.bronze_reading_id, "left")
    ov = F.from_json(F.col("e.override_values"), "map<string,string>")["result"]
    ov = F.when(ov.isin(*OVERRIDE_RESULTS), ov)
    return j.select(
        "reading_id", "machine_id", "recorded_at", "result_raw",
        F.col("e.id").alias("enhancement_id"), F.col("e.technician_id").alias("technician_id"),
        F.col("e.confidence_in_data").alias("confidence_in_data"),
        F.coalesce(F.col("enhancements"), F.lit(0)).alias("enhancements"),
        ov.alias("override_result"),
        F.coalesce(ov, F.col("result_raw")).alias("effective_result"),
    )


def failed_records(pf: DataFrame, limit: int = 500) -> DataFrame:
    """The record list with only failing records (a filter after the aggregate, i.e. HAVING),
    newest inspection first; the page limit (at most 500) is the feature of the listing."""
    return pf.filter(F.col("has_fail")).orderBy(F.desc("inspection_date"), F.desc("id")).limit(min(limit, 500))


def readings_page(readings: DataFrame, n: int = 50, offset: int = 0, before=None) -> DataFrame:
    """One page of readings, newest first (reading id breaks ties). OFFSET pages plan as one
    top-(offset + n) per task; ``before`` = (recorded_at, reading_id) of the last row seen gives the
    keyset variant, whose cost does not grow with the page number."""
    df = readings
    if before is not None:
        ts, rid = before
        t = F.lit(ts).cast("timestamp")
        df = df.filter((F.col("recorded_at") < t) | ((F.col("recorded_at") == t) & (F.col("reading_id") < F.lit(rid))))
    ordered = df.orderBy(F.desc("recorded_at"), F.desc("reading_id"))
    return (ordered.offset(offset) if offset and before is None else ordered).limit(n)


def recent_across(readings: DataFrame, n: int = 60) -> DataFrame:
    """The newest ``n`` readings over all machines. The reference takes the top n per machine,
    concatenates and re-sorts; a global sort + limit is the same result, and Spark already plans
    it as a top-n per task followed by one small merge (TakeOrderedAndProject)."""
    return readings.orderBy(F.desc("recorded_at"), F.desc("reading_id")).limit(n)


# ---- J16: documents two levels deep --------------------------------------------------------------------

STEP_FIELDS = ("order_index", "id", "step_type", "label", "is_mandatory")
SECTION_FIELDS = ("order_index", "id", "title", "section_type")
NULLS = {"ignoreNullFields": "false"}


def nested_sections(sections: DataFrame, steps: DataFrame) -> DataFrame:
    """``procedure_id, sections, n_steps``: a procedure's sections in order, each with its steps in order (empty without any).

    A list holds a procedure's template, never its runs.
    """
    per_section = steps.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct(*STEP_FIELDS))).alias("steps"))
    j = sections.join(per_section, sections.id == per_section.section_id, "left")
    kind = per_section.schema["steps"].dataType.simpleString()
    j = j.withColumn("steps", F.coalesce("steps", F.array().cast(kind)))
    ordered = F.array_sort(F.collect_list(F.struct(*SECTION_FIELDS, "steps")))
    return j.groupBy("procedure_id").agg(ordered.alias("sections"), F.sum(F.size("steps")).alias("n_steps"))


def procedure_documents(procedures: DataFrame, sections: DataFrame, steps: DataFrame) -> DataFrame:
    """A procedure with its sections and their steps as one JSON document, by one grouped pass a level (no N+1 reads)."""
    nested = nested_sections(sections, steps)
    kind = nested.schema["sections"].dataType.simpleString()
    j = procedures.join(nested, procedures.id == nested.procedure_id, "left")
    lists = F.coalesce("sections", F.array().cast(kind)).alias("sections")
    return j.select(
        F.col("id").alias("procedure_id"), F.size(lists).alias("n_sections"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
        F.to_json(F.struct("id", "name", "product_type", lists), NULLS).alias("document"))


def run_documents(runs: DataFrame, procedures: DataFrame, sections: DataFrame, steps: DataFrame, responses: DataFrame,
                  order_cols=("created_at", "id", "value")) -> DataFrame:
    """A run with its procedure's name and sections, and its responses in the order of the steps, as one JSON document.

    Responses are reduced to the newest of each step first (partial aggregates), so a run that was answered millions of
    times has a document of its procedure's size; ``n_responses`` counts them all. Runs of an unknown procedure are left out, as
    in the reference; runs without responses have an empty list.
    """
    newest = responses.groupBy("run_id", "step_id").agg(
        F.max_by("value", F.struct(*order_cols)).alias("value"), F.count(F.lit(1)).alias("n"))
    per_run = newest.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("step_id", "value"))).alias("responses"), F.sum("n").alias("n_responses"))
    nested = nested_sections(sections, steps).drop("n_steps")
    p = procedures.select(F.col("id").alias("procedure_id"), F.col("name").alias("procedure_name"))
    p = p.join(nested, "procedure_id", "left")
    empty = [F.coalesce(c, F.array().cast(d.schema[c].dataType.simpleString())).alias(c) for d, c in ((per_run, "responses"), (nested, "sections"))]
    j = runs.join(p, "procedure_id").join(per_run, runs.id == per_run.run_id, "left")
    return j.select(
        F.col("id").alias("run_id"), F.coalesce("n_responses", F.lit(0)).alias("n_responses"),
        F.to_json(F.struct("id", "procedure_id", "procedure_name", "status", *empty), NULLS).alias("document"))

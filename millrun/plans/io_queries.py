"""Source / sink / merge operators registered over the given tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

import millrun.plans.lab_queries  # noqa: F401  (its oracles)
from millrun.operators import lab as L
from millrun.operators.ordinals import ordinal_within
from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.registry import ORACLE, query
from millrun.session import tasks_for
from millrun.sources import bindings as B
from millrun.sources import io as IO
from millrun.sources.tables import TABLE_NAMES, safe_table
from millrun.streaming.jobs import page_time_log


@query(
    "io_row_count_audit",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLE_NAMES),
)
def q_io_row_count_audit(t):
    """IO20: row count of every given table in one union of global counts."""
    return IO.row_count_audit({n: getattr(t, n) for n in TABLE_NAMES})


def _orders_snapshot(t, start=None, end=None, rename=False):
    o = t.orders
    if start:
        o = o.filter(F.col("o_orderdate") >= F.lit(start).cast("timestamp"))
    if end:
        o = o.filter(F.col("o_orderdate") < F.lit(end).cast("timestamp"))
    cust = F.col("o_custkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        (F.concat(F.lit("C-"), cust) if rename else cust).alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
    )


@query(
    "io_merge_upsert",
    """WITH tgt AS (SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status,
                           o_totalprice AS total FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
          src AS (SELECT o_orderkey AS order_id, 'C-' || CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status,
                         o_totalprice AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01')
     SELECT * FROM src UNION ALL SELECT * FROM tgt WHERE order_id NOT IN (SELECT order_id FROM src)""",
)
def q_io_merge_upsert(t):
    """IO7: orders before 1998 upserted with a renamed-customer feed from mid-1997 on."""
    return IO.merge_upsert(_orders_snapshot(t, end="1998-01-01"), _orders_snapshot(t, start="1997-07-01", rename=True), ["order_id"])


@query(
    "io_merge_insert_only",
    """WITH tgt AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0),
          src AS (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal FROM customer)
     SELECT * FROM tgt UNION ALL SELECT * FROM src WHERE c_custkey NOT IN (SELECT c_custkey FROM tgt)""",
)
def q_io_merge_insert_only(t):
    """IO6: customers with a non-negative balance, then the missing ones inserted (existing kept)."""
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return IO.merge_insert_only(c.filter(F.col("c_acctbal") >= 0), c.withColumn("c_name", F.upper("c_name")), ["c_custkey"])


_SYNC_SQL = """WITH tgt AS (SELECT id, record_id, piece_iqa FROM inspection_rows),
      chg AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'),
      src AS (SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                               CAST(l_suppkey AS VARCHAR)) AS id, l_orderkey AS record_id, 'PASS' AS piece_iqa
              FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey IN (SELECT o_orderkey FROM chg)),
      m AS (SELECT * FROM tgt WHERE record_id NOT IN (SELECT DISTINCT record_id FROM src) UNION ALL SELECT * FROM src)
 SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY id, id) - 1 AS INTEGER) AS order_index FROM m"""


@query("io_full_sync", W(["inspection_rows"], [], _SYNC_SQL))
def q_io_full_sync(t):
    """IO8 (+ IO9): rows of 2001 records replaced by an edited list (lines 1-2, re-graded), renumbered."""
    tgt = B.inspection_rows(t).select("id", "record_id", "piece_iqa")
    recent = t.orders.filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).select(F.col("o_orderkey").alias("record_id"))
    li = t.lineitem.filter(F.col("l_linenumber") <= 2)
    src = li.join(recent, li.l_orderkey == recent.record_id, "left_semi").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        F.col("l_orderkey").alias("record_id"), F.lit("PASS").alias("piece_iqa"),
    )
    return IO.merge_full_sync(tgt, src, "record_id", "id", "id")


@query(
    "io_soft_delete",
    W(["inspection_records", "inspection_rows"], [],
      """SELECT r.*, NOT EXISTS (SELECT 1 FROM inspection_rows ir WHERE ir.record_id = r.id) = FALSE AS is_active
         FROM inspection_records r"""),
)
def q_io_soft_delete(t):
    """IO10: records without rows flagged inactive instead of deleted."""
    recs = B.inspection_records(t)
    return IO.soft_delete(recs, L.records_without_rows(recs, B.inspection_rows(t)), "id")


@query(
    "io_change_feed",
    """WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
          new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
                  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
     SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
            CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change_type,
            CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus,
            CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END AS o_totalprice
     FROM old o FULL OUTER JOIN new n ON o.o_orderkey = n.o_orderkey
     WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL
        OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice""",
)
def q_io_change_feed(t):
    """IO22: change feed between an old snapshot (before 2000) and a new one (from 1996, some statuses closed)."""
    o = t.orders
    old = o.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")).select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("F")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice")
    return IO.change_feed(old, new, ["o_orderkey"])


@query(
    "io_column_resolver",
    W(["stock_network"], [],
      """SELECT sku AS SKU, branch_id AS Branch_ID, location_type, '' AS region, available_stock, safety_stock,
         'Default' AS product_category FROM stock_network"""),
)
def q_io_column_resolver(t):
    """IO13: mixed-case / alternate column names resolved to canonical ones, defaults for missing."""
    n = B.stock_network(t).select(
        F.col("sku").alias("Sku"), F.col("branch_id").alias("BRANCH_ID"), F.col("location_type").alias("LocationType"),
        F.col("available_stock").alias("AVAILABLE_STOCK"), F.col("safety_stock").alias("demand_30d"),
    )
    spec = {
        "SKU": (["sku", "item"], None), "Branch_ID": (["branch_id", "branch"], None),
        "location_type": (["location_type", "locationtype"], "SPOKE"), "region": (["region"], ""),
        "available_stock": (["available_stock", "stock"], 0), "safety_stock": (["safety_stock", "demand_30d"], 0),
        "product_category": (["product_category", "category"], "Default"),
    }
    return IO.resolve_columns(n, spec)


@query(
    "io_seed_if_sparse",
    W(["test_runs"], [],
      """SELECT count(*) AS total, count_if(created_at >= TIMESTAMP '2001-12-01 00:00:00' - INTERVAL 30 DAY) AS recent,
                count(*) = 0 OR count_if(created_at >= TIMESTAMP '2001-12-01 00:00:00' - INTERVAL 30 DAY) < 30 AS needs_seed
         FROM test_runs"""),
)
def q_io_seed_if_sparse(t):
    """IO23: reload decision for the test-run table (fewer than 30 runs in 30 days)."""
    return IO.seed_if_sparse(B.test_runs(t), "created_at", B.LAB_AS_OF)


_ADHOC = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {} GROUP BY l_returnflag, l_linestatus"


@query("io_adhoc_sql", f"SELECT *, FALSE AS truncated FROM ({_ADHOC.format('lineitem')}) q")
def q_io_adhoc_sql(t):
    """IO16: user SQL over a registered view with a 500-row cap and an exact truncated flag."""
    IO.create_view(t.lineitem, "millrun_lineitem")
    df, truncated = IO.adhoc_sql(t.spark, _ADHOC.format("millrun_lineitem"), cap=500)
    return df.withColumn("truncated", F.lit(truncated))


_CAPPED = "SELECT l_orderkey, l_linenumber, l_quantity FROM {} ORDER BY l_quantity DESC, l_orderkey, l_linenumber"


@query("io_adhoc_sql_capped", f"SELECT *, TRUE AS truncated FROM ({_CAPPED.format('lineitem')} LIMIT 500) q")
def q_io_adhoc_sql_capped(t):
    """IO11 + IO16: a statement over a view with more rows than the cap."""
    IO.create_view(t.lineitem, "millrun_capped_lineitem")
    df, truncated = IO.adhoc_sql(t.spark, _CAPPED.format("millrun_capped_lineitem"), cap=500)
    return df.withColumn("truncated", F.lit(truncated))


@query(
    "io_event_log",
    """SELECT CASE user_id % 3 WHEN 0 THEN 'app-0' WHEN 1 THEN 'app-1' ELSE 'app-2' END AS app_name, event_type AS page, count(*) AS log_rows,
              CAST(sum(floor(value)) AS BIGINT) AS seconds,
              CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)) FILTER (WHERE user_id % 3 > 0) AS BIGINT) AS clicks,
              count(*) FILTER (WHERE user_id % 3 = 0) AS rows_without_clicks
       FROM events GROUP BY ALL""",
)
def q_io_event_log(t):
    """IO21: engagement rows appended app by app to a log whose first files have no click column, read back and counted."""
    log = page_time_log(t).withColumn("company_name", F.lit(None).cast("string"))
    path = _io_folder(t.spark, "event_log")
    IO.event_log_rows(log.filter("app_name = 'app-0'")).drop("click_count").write.parquet(path)
    for app in ("app-1", "app-2"):
        texts = log.filter(F.col("app_name") == app).withColumn("seconds_spent", F.col("seconds_spent").cast("string"))
        IO.event_log_append_rows(texts, path)
    return IO.read_event_log(t.spark, path).groupBy("app_name", "page").agg(
        F.count(F.lit(1)).alias("log_rows"), F.sum("seconds_spent").alias("seconds"), F.sum("click_count").alias("clicks"),
        F.count_if(F.col("click_count").isNull()).alias("rows_without_clicks"))


_FLAT_SQL = """WITH g AS (SELECT *, dense_rank() OVER (ORDER BY id) AS record_group FROM inspection_records),
      e AS (SELECT r.record_group, r.id AS record_id, r.product, r.machinist,
                   CAST(r.inspection_date AS VARCHAR) AS inspection_date, ir.id AS row_id, ir.piece_iqa
            FROM g r JOIN inspection_rows ir ON ir.record_id = r.id),
      f AS (SELECT *, row_number() OVER (PARTITION BY record_group ORDER BY row_id) AS row_idx FROM e)
 SELECT record_group, arg_min(record_id, row_idx) AS record_id, arg_min(product, row_idx) AS product,
        arg_min(machinist, row_idx) AS machinist, arg_min(CAST(inspection_date AS DATE), row_idx) AS inspection_date,
        count(*) AS n_rows
 FROM f GROUP BY record_group"""


@query("io_sheet_import", W(["inspection_records", "inspection_rows"], [], _FLAT_SQL))
def q_io_sheet_import(t):
    """IO15: flat sheet rows (header repeated per row, ISO dates) back into record headers."""
    recs, rows = B.inspection_records(t), B.inspection_rows(t)
    idx = L.dense_index(recs, "id")
    n_rows = rows.count()  # of a projection: the footers
    n = tasks_for(t.spark, n_rows)  # the joins follow the partitions of their first table
    recs = recs.repartition(n, "id") if n else recs
    flat = recs.join(idx, "id").join(rows.withColumnRenamed("id", "row_id"), F.col("id") == F.col("record_id")).select(
        F.col("group_no").alias("Record Group"), F.col("id").cast("string").alias("Record Id"), F.col("product").alias("Product"),
        F.col("machinist").alias(" Machinist "), F.col("inspection_date").cast("string").alias("Inspection Date"),
        "row_id", "piece_iqa",
    )
    flat = ordinal_within(flat, ["Record Group"], ["row_id"], "row_idx", base=1, rows=n_rows)
    records, irows = IO.sheet_import(flat, ["Record Id", "Product", "Machinist", "Inspection Date"], ["row_id", "piece_iqa"],
                                     date_cols=("Inspection Date",), n_rows=n_rows)
    n = irows.groupBy("record_group").agg(F.count(F.lit(1)).alias("n_rows"))
    return records.join(n, "record_group").select(
        "record_group", F.col("record_id").cast("bigint").alias("record_id"), "product",
        F.when(F.col("machinist") == "", None).otherwise(F.col("machinist")).alias("machinist"), "inspection_date", "n_rows")


# ---- IO5 partitioned write + partition-pruned read ------------------------------------------------
def _io_folder(spark, name: str) -> str:
    """A new folder for a written table under the cluster's shared checkpoint folder."""
    import os
    import uuid

    from millrun.session import ensure_checkpoint_dir

    return os.path.join(ensure_checkpoint_dir(spark), f"millrun-io-{name}-{uuid.uuid4().hex}")


@query(
    "io_partitioned_roundtrip",
    f"""SELECT 'TAG-' || CAST(user_id % 18 AS VARCHAR) AS tag, CAST(ts AS DATE) AS reading_date, count(*) AS readings,
              count_if(value <= 100) AS good_readings
       FROM events WHERE CAST(ts AS DATE) >= CAST(TIMESTAMP '{B.AS_OF_EVENTS}' AS DATE) - 7 GROUP BY 1, 2""",
)
def q_io_partitioned_roundtrip(t):
    """IO5: SCADA readings written partitioned by day (dynamic partition overwrite) into a folder of this
    run, so that no day of another input or an earlier state of it is read, read back with a last-7-days filter that prunes partitions
    at the scan, then counted per tag x day."""
    readings = t.events.select(
        F.concat(F.lit("TAG-"), (F.col("user_id") % 18).cast("string")).alias("tag"),
        F.to_date("ts").alias("reading_date"), "value")
    path = _io_folder(t.spark, "scada_readings")
    IO.write_table(readings, path, mode="overwrite", by=("reading_date",))
    start = F.date_sub(F.lit(B.AS_OF_EVENTS).cast("timestamp").cast("date"), 7)
    back = t.spark.read.parquet(path).filter(F.col("reading_date") >= start)
    return back.groupBy("tag", "reading_date").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.col("value") <= 100).alias("good_readings"))


_SPLIT_DAY = "1996-01-01"


@query(
    "io_overwrite_append",
    """SELECT o_orderstatus AS status, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
              count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""",
)
def q_io_overwrite_append(t):
    """IO3 + IO4: a table is written, overwritten with other columns and rows, appended to, and read back whole."""
    path = _io_folder(t.spark, "orders")
    IO.write_table(_orders_snapshot(t, start=_SPLIT_DAY).withColumnRenamed("total", "amount"), path)
    IO.write_table(_orders_snapshot(t, end=_SPLIT_DAY), path)
    IO.write_table(_orders_snapshot(t, start=_SPLIT_DAY), path, mode="append")
    back = t.spark.read.parquet(path)
    return back.groupBy("status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("total").cast("decimal(18,2)")).cast("double").alias("total"),
        F.countDistinct("customer").alias("customers"))


@query("io_csv_roundtrip", ORACLE["inspection_export"])
def q_io_csv_roundtrip(t):
    """IO14 sink + IO2: the inspection export written as CSV with a header and blanks for NULL, read back with its declared schema."""
    rows = L.export_rows(B.inspection_records(t), B.inspection_rows(t))
    path = _io_folder(t.spark, "inspection_csv")
    L.write_csv(rows, path)
    back = IO.read_with_schema(t.spark, path, rows.schema, header=True)
    return back.fillna("")  # a blank text reads as NULL


@query(
    "io_truncate_reset",
    "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after, 6 AS n_columns FROM events",
)
def q_io_truncate_reset(t):
    """IO19: a written table is replaced by an empty one of the same schema."""
    path = _io_folder(t.spark, "events")
    IO.write_table(t.events, path)
    before = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_before")).first()[0]
    IO.truncate_reset(t.events, path)
    after = t.spark.read.parquet(path)
    return after.agg(F.lit(before).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"), F.lit(len(after.columns)).alias("n_columns"))


@query(
    "io_safe_scan",
    "SELECT event_type, count(*) AS rows, CAST(0 AS BIGINT) AS missing_rows FROM events GROUP BY 1",
)
def q_io_safe_scan(t):
    """IO12: a table that is there and one that is not, read alike and joined."""
    there = safe_table(t.spark, "events", t.events.schema, t.sf_dir)
    missing = safe_table(t.spark, "events_archive", t.events.schema, t.sf_dir)
    both = there.withColumn("_m", F.lit(0)).unionByName(missing.withColumn("_m", F.lit(1)))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("_m").alias("missing_rows"))

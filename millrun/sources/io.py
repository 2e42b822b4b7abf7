"""Sources, sinks and table maintenance.

Merges are expressed as set operations on keys - anti joins and unions - so they run as
shuffle joins on the key and never collect a table. Duplicate keys inside a source are resolved
deterministically (smallest row wins for insert-only, source-over-target then largest row for
upserts). Writes go through the DataFrame writer (dynamic partition overwrite for partitioned
tables); nothing is written inside the query operators themselves.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrun.session import cut_lineage

# ---- IO2-IO5, IO11, IO19: ingest and write ----------------------------------------------------------


def ingest(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """IO2: bronze rows with an explicit schema (small literal batches)."""
    return spark.createDataFrame(rows, schema)


def read_with_schema(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv", **options) -> DataFrame:
    """IO2: file read with a declared schema (no inference)."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """IO3 / IO4 / IO5: overwrite (schema may change), append, or per-partition overwrite."""
    w = df.write.mode(mode).format(fmt)
    if by:
        w = w.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """IO11: named logical view."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def truncate_reset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO19: replace a raw table by an empty one of the same schema."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").format(fmt).save(path)


# ---- IO6-IO10: merges ----------------------------------------------------------------------------------


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def dedupe_keys(df: DataFrame, keys: list[str], largest: bool = False) -> DataFrame:
    """One row per key: the smallest (or largest) row by its non-key columns - deterministic."""
    rest = _rest(df, keys)
    if not rest:
        return df.select(*keys).distinct()
    pick = F.max_by if largest else F.min_by
    g = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*rest)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def merge_insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """IO6: insert source rows whose key is absent from the target (source deduped first)."""
    new = dedupe_keys(source.select(*target.columns), keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new)


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """IO7: replace on key conflict; source rows win, duplicate source keys keep the largest row."""
    rest = _rest(target, keys)
    u = target.withColumn("_p", F.lit(0)).unionByName(source.select(*target.columns).withColumn("_p", F.lit(1)))
    g = u.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_p", *rest)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*target.columns)


def replace_children(target: DataFrame, source: DataFrame, parent: str) -> DataFrame:
    """IO9: every parent present in the source gets exactly the source's children."""
    parents = source.select(parent).distinct()
    return target.join(parents, parent, "left_anti").unionByName(source.select(*target.columns))


def merge_full_sync(target: DataFrame, source: DataFrame, parent: str, key: str, order_col: str) -> DataFrame:
    """IO8: per parent in the source - update matched, insert new, delete missing children -
    and renumber the children 0..n-1 by ``order_col`` (skew-proof ordinals: a parent with millions
    of children is numbered in slices, not in one task)."""
    from millrun.operators.ordinals import ordinal_within

    merged = replace_children(target, source, parent)
    return ordinal_within(merged, [parent], [order_col, key], "order_index").select(*merged.columns, "order_index")


def soft_delete(target: DataFrame, ids: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    """IO10: flag rows whose key is listed instead of deleting them."""
    hit = ids.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    j = target.join(hit, key, "left")
    base = F.col(flag) if flag in target.columns else F.lit(True)
    return j.withColumn(flag, F.when(F.col("_hit"), F.lit(False)).otherwise(base)).drop("_hit").select(*target.columns, *(
        [] if flag in target.columns else [flag]))


# ---- IO12-IO13: tolerant reads ------------------------------------------------------------------------


def resolve_columns(df: DataFrame, spec: dict[str, tuple[list[str], object]]) -> DataFrame:
    """IO13: case-insensitive candidate names -> canonical columns, defaults when none exists."""
    lower = {c.lower(): c for c in df.columns}
    out: list[Column] = []
    for target, (candidates, default) in spec.items():
        found = next((lower[c.lower()] for c in candidates if c.lower() in lower), None)
        out.append((F.col(found) if found else F.lit(default)).alias(target))
    return df.select(*out)


# ---- IO15: sheet import -------------------------------------------------------------------------------

# Header aliases of the import sheet (alias -> canonical name).
HEADER_ALIASES = {"wo#": "wo_number", "wo number": "wo_number", "record group": "record_group"}
EXCEL_EPOCH = "1899-12-30"  # Excel serial day 0 (serial 25569 = 1970-01-01)


def _canonical(name: str) -> str:
    n = name.strip().lower()
    return HEADER_ALIASES.get(n, re.sub(r"[^0-9a-z]+", "_", n).strip("_"))


def parse_sheet_date(c: Column) -> Column:
    """ISO text date, or an Excel serial day number counted from 1899-12-30."""
    t = F.trim(c)
    serial = t.try_cast("int")
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.date_add(F.lit(EXCEL_EPOCH).cast("date"), serial))


def sheet_import(flat: DataFrame, header_cols: list[str], row_cols: list[str], date_cols: tuple[str, ...] = (),
                 n_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """IO15: flat sheet rows -> (records, rows). Headers are normalised (aliases, trim); rows are
    grouped by the record group; a record's header comes from its first row (by row index);
    children keep their order. Returns two DataFrames; nothing is gathered on the driver. ``n_rows``: see ``ordinal_within``."""
    df = flat.select(*[F.col(c).alias(_canonical(c)) for c in flat.columns])
    header_cols = [_canonical(c) for c in header_cols]
    row_cols = [_canonical(c) for c in row_cols]
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    trimmed = df.select(*[F.trim(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])
    for c in date_cols:
        trimmed = trimmed.withColumn(_canonical(c), parse_sheet_date(F.col(_canonical(c))))
    records = trimmed.groupBy("record_group").agg(F.min_by(F.struct(*header_cols), F.col("row_idx")).alias("h")).select(
        "record_group", *[F.col(f"h.{c}").alias(c) for c in header_cols])
    from millrun.operators.ordinals import ordinal_within

    rows = ordinal_within(trimmed.select("record_group", "row_idx", *row_cols), ["record_group"], ["row_idx"], "order_index", rows=n_rows)
    return records, rows.select("record_group", "row_idx", *row_cols, "order_index")


# ---- IO16-IO18, IO20-IO23: operations -------------------------------------------------------------------


def adhoc_sql(spark: SparkSession, sql: str, cap: int = 500) -> tuple[DataFrame, bool]:
    """IO16: run user SQL with a row cap; ``truncated`` is true only when more than ``cap`` rows
    exist (fixing the "exactly cap rows" false positive). The statement runs once: its first cap + 1 rows are
    checkpointed, and both the flag and the rows come from them, so they agree even where the statement has no order."""
    rows = cut_lineage(spark.sql(sql).limit(cap + 1))
    return rows.limit(cap), rows.count() > cap


def catalog_listing(spark: SparkSession) -> DataFrame:
    """IO17: schemas and tables with their kind."""
    rows = [(t.database or "", t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "schema string, name string, kind string, is_temporary boolean")


def drop_all(spark: SparkSession, database: str) -> list[str]:
    """IO18: drop every table and view of one (own) schema; returns the names dropped."""
    names = [t.name for t in spark.catalog.listTables(database)]
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{n}`")
        spark.sql(f"DROP VIEW IF EXISTS `{database}`.`{n}`")
    return names


def row_count_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """IO20: row count per table as one union of global counts (one job)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def event_log_append(spark: SparkSession, table: str, **values) -> None:
    """IO21: append one engagement-log row through bound parameters (values never interpolated)."""
    cols = ", ".join(values)
    marks = ", ".join(f":{k}" for k in values)
    spark.sql(f"INSERT INTO {table} ({cols}) VALUES ({marks})", args=values)


# The engagement log's columns and types.
EVENT_LOG_SCHEMA = (
    "username string, company_name string, page string, seconds_spent int, click_count int, app_name string, recorded_at timestamp"
)


def event_log_rows(rows: DataFrame) -> DataFrame:
    """IO21, a batch of log calls as typed log rows: columns by name, unreadable or absent seconds and clicks count 0,
    other absent columns are NULL, columns the log lacks are dropped."""
    wanted = StructType.fromDDL(EVENT_LOG_SCHEMA)
    typed = [
        (F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted
    ]
    return rows.select(*typed).fillna(0, ["seconds_spent", "click_count"])


def event_log_append_rows(rows: DataFrame, path: str) -> None:
    """IO21 for many calls at once: the typed rows go to the log's folder from the executors."""
    event_log_rows(rows).write.mode("append").parquet(path)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """The log in its present layout; files from before a column was added give NULL there."""
    return spark.read.schema(EVENT_LOG_SCHEMA).parquet(path)


def change_feed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """IO22: snapshot diff as a change feed (insert / update / delete) by key and row hash."""
    rest = _rest(new, keys)
    h = lambda df: df.select(*keys, F.xxhash64(*[F.col(c) for c in rest]).alias("_h"), F.struct(*rest).alias("_row"))
    o, n = h(old).alias("o"), h(new).alias("n")
    cond = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    j = o.join(n, cond, "full_outer")
    kind = (
        F.when(F.col("o._h").isNull(), F.lit("insert"))
        .when(F.col("n._h").isNull(), F.lit("delete"))
        .when(~F.col("o._h").eqNullSafe(F.col("n._h")) | ~F.col("o._row").eqNullSafe(F.col("n._row")), F.lit("update"))
    )
    out = j.select(*[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys], kind.alias("change_type"),
                   F.coalesce(F.col("n._row"), F.col("o._row")).alias("_row"))
    return out.filter(F.col("change_type").isNotNull()).select(*keys, "change_type", *[F.col(f"_row.{c}").alias(c) for c in rest])


def seed_if_sparse(df: DataFrame, ts_col: str, as_of: str, days: int = 30, min_rows: int = 30) -> DataFrame:
    """IO23: one-row boolean - reload when the table is empty or has < min_rows in the window."""
    start = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    agg = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(ts_col) >= start).alias("recent"))
    return agg.select("total", "recent", ((F.col("total") == 0) | (F.col("recent") < min_rows)).alias("needs_seed"))

"""Row ordinals within a group that a hot group cannot pin to one task.

``row_number() over (partition by g order by o)`` sends every row of a group to one task. Here
the rows are range-partitioned on (g, o) instead: a group holding a third of the data spans
several range partitions, each numbers its own slice (a window over (g, partition id), which
re-hashes the slices evenly), and a running count over the small (g, partition id) count table
gives each slice its offset; only a slice's first group can have one above zero, so the offsets are broadcast. The rows are checkpointed with their partition id, so the numbering and
the counts see one and the same slicing: range bounds are sampled, and a second evaluation
could draw others. The result equals the plain window's row_number for a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrun.session import cut_lineage, tasks_for


def ordinal_within(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "order_index",
                   base: int = 0, kind: str = "int", rows: int = 0) -> DataFrame:
    """Add ``out`` = position of each row within its group by ``order_cols`` (``base``, base + 1, ...),
    as a ``kind``. No group columns: one group of all rows. ``order_cols`` must be a total order within a group (end with a key).
    Where the caller knows about how many ``rows`` there are, a slice has no more of them in a large table than in a small one."""
    n = tasks_for(df.sparkSession, rows)
    wide = [n] if n else []
    ranged = cut_lineage(df.repartitionByRange(*wide, *group_cols, *order_cols).withColumn("_slice", F.spark_partition_id()))
    dealt = ranged.repartition(n, *group_cols, "_slice") if n else ranged
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(*group_cols, "_slice").orderBy(*order_cols)))
    counts = local.groupBy(*group_cols, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # ranges are contiguous, so only a slice's first group has rows in earlier slices: a row a slice at most, and the rows stay put
    offsets = counts.select(*group_cols, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")).where("_off > 0")
    # a null group is a group, as in a window, so its keys must meet too
    keys = {c: f"_group{i}" for i, c in enumerate(group_cols)}
    offsets = offsets.select(*(F.col(c).alias(k) for c, k in keys.items()), F.col("_slice").alias("_of"), "_off")
    same = F.col("_slice") == F.col("_of")
    for c, k in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    joined = local.join(F.broadcast(offsets), same, "left").withColumn(
        out, (F.coalesce("_off", F.lit(0)) + F.col("_local") - 1 + base).cast(kind))
    return joined.select(*group_cols, *(c for c in df.columns if c not in (*group_cols, out)), out)

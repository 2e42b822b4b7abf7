"""Exact quantiles of groups of any size from a mergeable sketch and counts, never a group's values in one buffer.

A Greenwald-Khanna sketch (``percentile_approx``: partial in each task, merged after, its rank error at most 1 / accuracy
of the group) gives two values that bracket the quantile. Rows outside the bracket are only counted; those inside, at most
8 / accuracy of the group, are counted by distinct value and walked in order. Groups of at most ``accuracy`` rows
are sorted as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a sketch; its values are at most 1 / ACCURACY of a group's rows away from the rank asked for.
ACCURACY = 10_000


def sketch_quantiles(df: DataFrame, group: list[str], value: str, shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """Approximate quantiles per group in one pass: ``n`` and ``sketch``, the values at ``shares`` with a rank error of n / accuracy."""
    v = df.where(F.col(value).isNotNull())
    return v.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, shares, accuracy).alias("sketch"))


def quantile(df: DataFrame, group: list[str], value: str, q: float, out: str, accuracy: int = ACCURACY) -> DataFrame:
    """``group..., out``: the q-quantile of ``value`` with linear interpolation between neighbours, per group (null groups included).

    NULL values don't count; a group of nothing else has no row.
    """
    slack = 3.0 / accuracy
    bounds = sketch_quantiles(df, group, value, [max(q - slack, 0.0), min(q + slack, 1.0)], accuracy)
    renamed = bounds.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "n", F.col("sketch")[0].alias("_lo"), F.col("sketch")[1].alias("_hi"))
    same = [df[g].eqNullSafe(renamed[f"_g{i}"]) for i, g in enumerate(group)]
    v = df.where(F.col(value).isNotNull())
    v = (v.join(renamed, same) if group else v.crossJoin(renamed)).select(*group, F.col(value).cast("double").alias("_v"), "n", "_lo", "_hi")
    small = v.where(F.col("n") <= accuracy).groupBy(*group).agg(F.percentile("_v", q).alias(out))
    # Rows below the bracket count as one row before it.
    place = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    counts = v.where((F.col("n") > accuracy) & (F.col("_v") <= F.col("_hi"))).groupBy(*group, place.alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"))
    running = Window.partitionBy(*group).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_end", F.sum("_c").over(running))
    rank = (F.col("n") - 1) * F.lit(q)
    held = lambda k: (F.col("_end") > k) & (F.col("_end") - F.col("_c") <= k)
    lower, upper = F.max(F.when(held(F.floor(rank)), F.col("_v"))), F.max(F.when(held(F.ceil(rank)), F.col("_v")))
    share = F.max(rank - F.floor(rank))
    large = counts.groupBy(*group).agg((lower + (upper - lower) * share).alias(out))
    return small.unionByName(large).where(F.col(out).isNotNull())  # without group columns the part that is empty has a row, too

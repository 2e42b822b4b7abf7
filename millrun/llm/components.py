"""Connected components of an undirected graph by randomised contraction, entirely in DataFrames.

Each round every node points to the neighbour of least random priority (or to itself), edges are
renamed to these representatives and deduplicated. The expected number of nodes falls by a constant
factor a round, also on long chains. Neither edges nor components reach the driver, and a hub is
handled by partial aggregation and skew joins, never by collecting its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: every node that has an edge, and one node of its component.

    Loops, repeated and reversed edges are allowed; rows with a null end are ignored (a null
    links nothing). An empty input gives an empty result.
    """
    edges = written(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    maps = []
    while edges.head(1):
        seed = F.lit(len(maps))
        both = edges.select(F.inline(F.expr("array(struct(a as u, b as v), struct(b as u, a as v))")))
        best = F.min(F.struct(F.xxhash64(seed, "v").alias("p"), F.col("v").alias("v"))).alias("best")
        own = F.struct(F.xxhash64(seed, "u").alias("p"), F.col("u").alias("v"))
        rep = written(both.groupBy("u").agg(best).select("u", F.least("best", own)["v"].alias("rep")), "rep")
        maps.append(rep)
        ra, rb = (rep.select(F.col("u").alias(k), F.col("rep").alias(f"r{k}")) for k in "ab")
        moved = edges.join(ra, "a").join(rb, "b").where("ra <> rb")
        edges = written(
            moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges"
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps.pop().select(F.col("u").alias("node"), F.col("rep").alias("root"))
    while maps:
        step = roots.select(F.col("node").alias("rep"), "root")
        roots = maps.pop().join(step, "rep", "left").select(
            F.col("u").alias("node"), F.coalesce("root", "rep").alias("root")
        )
    return roots

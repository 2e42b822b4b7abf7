"""Mixing sources to target weights by Poisson replication.

A source with n documents that should be a share w of a mix of T documents is repeated T w / n times on
average. Each document's count is its draw from the Poisson distribution with that mean: the
distribution is inverted at a number in (0, 1) hashed from the seed and the doc_id, so counts are the
same on every run and independent of partitioning. Documents are exploded by their counts and dealt out
by a hash of the copy, ordered by it within each task: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import fits_broadcast, shuffle_partitions, written

SEED = 20
#: Flattening: a source's weight is the number of its documents to this power.
EXPONENT = 0.5
#: Parts that the documents of one source are dealt to where the source table is too large to broadcast.
SALTS = 64


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts (52 bits); a null part counts as an empty string."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array that ends beyond any probability a double can tell from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("lp"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("a"))

    def step(acc: Column, j: Column) -> Column:
        lp = acc["lp"] + F.ln(rate) - F.ln(j.cast("double"))
        c = acc["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.concat(acc["a"], F.array(c)).alias("a"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["a"])).otherwise(
        F.array(F.lit(1.0))
    )


def mixing_rates(docs: DataFrame, targets: DataFrame | None = None, size: float = 1.0, exponent: float = EXPONENT):
    """``source, rate``: mean repetitions of each source's documents.

    ``targets(source, weight)``: weights >= 0, scaled to sum 1 over the sources present; a source without one has
    weight 0. None: each source weighs its number of documents to ``exponent``. ``size``: documents of
    the mix over documents of the input. A null source is a source of its own.
    """
    n = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if targets is None:
        n = n.withColumn("w", F.pow("n", F.lit(float(exponent))))
    else:
        t = targets.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").cast("double").alias("w"))
        n = n.join(t, n.source.eqNullSafe(t._s), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    n = written(n, "sources")
    all_n, all_w = n.agg(F.sum("n"), F.sum("w")).first()
    rate = F.lit(float(size)) * all_n * F.col("w") / all_w / F.col("n") if all_w else F.lit(0.0)
    return n.select("source", rate.alias("rate"))


def poisson_mix(
    docs: DataFrame, targets: DataFrame | None = None, size: float = 1.0, exponent: float = EXPONENT, seed: int = SEED
) -> DataFrame:
    """The columns of ``docs(doc_id, source, ...)`` and ``_copy`` (1, 2, ...), one row per repetition, in global random order.

    Rows with the same doc_id have the same draw; a null doc_id counts as an empty one. An empty
    table, or weights that are all zero, give an empty result. Further columns pass through; only
    names that begin with an underscore are reserved.
    """
    rates = mixing_rates(docs, targets, size, exponent)
    table = written(rates.select(F.col("source").alias("_s"), poisson_cdf(F.col("rate")).alias("_cdf")), "rates")
    if fits_broadcast(table):
        drawn = docs.join(F.broadcast(table), docs.source.eqNullSafe(table._s), "left")
    else:
        salted = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        spread = table.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = salted.source.eqNullSafe(spread._s) & (salted._salt == spread._t)
        drawn = salted.join(spread, on, "left")
    u = unit(F.lit(seed), F.col("doc_id"))
    count = F.size(F.filter("_cdf", lambda c: c < F.col("_u")))
    copies = (
        drawn.withColumn("_u", u)
        .withColumn("_n", count)
        .where("_n > 0")
        .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    )
    place = F.xxhash64(F.lit(seed), "doc_id", "_copy", *(["text"] if "text" in docs.columns else []))
    keyed = copies.withColumn("_place", place)
    dealt = keyed.repartition(shuffle_partitions(docs.sparkSession), "_place").sortWithinPartitions("_place")
    return dealt.drop("_place")

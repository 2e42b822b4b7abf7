"""V1 without a Cartesian product: buckets of signed random projections, several probes a query, exact re-rank.

``bits`` random planes through the corpus mean cut the space into 2^bits buckets, once for each of ``tables`` independent sets of planes. A
row lies in one bucket of each table. A query probes in each table the ``probes`` buckets that are nearest by the sum of the
margins of the planes between. Rows and probes are dealt by (table, bucket) and sorted with a bucket's probes first; its rows then
stream past them in blocks. A block is scored by a matrix product in single precision, and what may be among the best k of
a probe, by the margin of that precision, by the exact cosine. A pair that meets in several tables counts in the first only, which
both sides can tell without a shuffle. Nothing is capped: a bucket of any size is scored whole, a task holds its probes and one block.
``recall`` measures the index against the exact form (``text.vector_topk``), which stays the choice for small query sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrun.functions import scalar as P

BITS = 8
TABLES = 12
PROBES = 16
SEED = 29
PROBES_A_BLOCK = 256  # probes of one matrix product


def usable(df: DataFrame, vec_col: str, dimension: int | None = None) -> DataFrame:
    """Rows whose vector has no NULL or NaN entry, and the given length."""
    ok = F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x))
    return df.where(ok & (F.size(vec_col) == dimension if dimension is not None else F.size(vec_col) > 0))


@dataclass(frozen=True)
class Planes:
    """The mean of the corpus and the planes, ``tables * bits`` rows."""

    mean: np.ndarray
    normals: np.ndarray
    bits: int
    tables: int

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.mean) @ self.normals.T).reshape(len(vectors), self.tables, self.bits)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        return (self.margins(vectors) > 0) @ (1 << np.arange(self.bits))

    def nearest(self, vector: np.ndarray, probes: int) -> np.ndarray:
        """For each table the buckets whose planes lie nearest to the vector (its own bucket first)."""
        margins = self.margins(vector[None])[0]
        sides = (np.arange(1 << self.bits)[:, None] >> np.arange(self.bits)) & 1
        out = []
        for m in margins:
            cost = (np.abs(m) * (sides != (m > 0))).sum(axis=1)
            out.append(np.argsort(cost, kind="stable")[:probes])
        return np.array(out)


def fit_planes(corpus: DataFrame, vec_col: str, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> Planes | None:
    """Planes through the mean of all vectors of the most frequent length (None without any)."""
    rows = usable(corpus, vec_col)
    lengths = rows.groupBy(F.size(vec_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    same = usable(corpus, vec_col, lengths.d).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    mean = np.array(same.agg(vector_to_array(Summarizer.mean(F.col("v")))).first()[0])
    normals = np.random.default_rng(seed).normal(size=(tables * bits, lengths.d))
    return Planes(mean, normals, bits, tables)


def with_buckets(df: DataFrame, id_col: str, vec_col: str, planes: Planes, probes: int | None = None) -> DataFrame:
    """``id, vec, buckets`` (a bucket for each table), or with ``probes`` ``id, vec, probed`` (an array for each table)."""
    dimension = len(planes.mean)
    rows = usable(df, vec_col, dimension).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, dimension)
            if probes is None:
                found = pa.array(list(planes.buckets(x).astype(np.int32)), pa.list_(pa.int32()))
            else:
                found = pa.array([planes.nearest(v, probes).astype(np.int32).tolist() for v in x], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], ["id", "vec", "found"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, vec array<double>, found {'array<int>' if probes is None else 'array<array<int>>'}")


def _lists(column: pa.Array, rows: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy().reshape(rows, -1)


def _sums(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of the columns ``i`` of ``a`` and ``j`` of ``b``, added in the order of the entries as ``similarity.dot`` does."""
    total = np.zeros(len(i))
    for x, y in zip(a, b):
        total += x[i] * y[j]
    return total


class _Side:
    """Vectors of some rows: by entry, their norms, and unit vectors in single precision; ``odd`` have no finite norm."""

    def __init__(self, vectors: np.ndarray):
        self.entries = np.ascontiguousarray(vectors.T)
        each = np.arange(len(vectors))
        with np.errstate(invalid="ignore", over="ignore"):
            self.norms = np.sqrt(_sums(self.entries, self.entries, each, each))
        self.odd = ~np.isfinite(self.norms)
        plain = np.where(self.odd | (self.norms == 0), 1.0, self.norms)
        self.units = np.where(self.odd[:, None], 0.0, vectors / plain[:, None]).astype(np.float32)


class _Bucket:
    """The probes of one (table, bucket) and the best ``k`` rows of each so far."""

    def __init__(self, table: int, k: int, qids: pa.Array, vectors: np.ndarray, probed: np.ndarray, ids: pa.DataType):
        self.table, self.k, self.qids = table, k, qids
        self.side = _Side(vectors)
        self.probed = probed  # (probes, tables, buckets)
        self.margin = 8 * vectors.shape[1] * float(np.finfo(np.float32).eps)
        self.starts = range(0, len(vectors), PROBES_A_BLOCK)
        empty = [pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], ids), pa.array([], pa.int64()), pa.array([], pa.bool_())]
        self.best = [pa.table(empty, ["q", "score", "doc_id", "row", "met"]) for _ in self.starts]
        self.least = np.full(len(vectors), -np.inf)

    def see(self, ids: pa.Array, vectors: np.ndarray, buckets: np.ndarray) -> None:
        rows = _Side(vectors)
        for n, start in enumerate(self.starts):
            q = slice(start, start + PROBES_A_BLOCK)
            near = self.side.units[q] @ rows.units.T
            near[self.side.norms[q] == 0] = -np.inf  # zero vectors have no cosine
            near[:, rows.norms == 0] = -np.inf
            near[self.side.odd[q]] = np.inf
            near[:, rows.odd] = np.inf
            least = self.least[q]
            if near.shape[1] > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((near >= (least - self.margin)[:, None]) & ~np.isneginf(near))
            if len(i):
                self._merge(n, start, i, j, rows, ids, buckets)

    def _merge(self, n: int, start: int, i: np.ndarray, j: np.ndarray, rows: _Side, ids: pa.Array, buckets: np.ndarray) -> None:
        q = i + start
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            score = _sums(self.side.entries, rows.entries, q, j) / (self.side.norms[q] * rows.norms[j])
            some = self.side.norms[q] * rows.norms[j] != 0  # no cosine with a zero vector
        j, q, score = j[some], q[some], score[some]
        new = [pa.array(q), pa.array(score), ids.take(pa.array(j)), pa.array(j), pa.array(np.zeros(len(q), bool))]
        both = pa.concat_tables([self.best[n], pa.table(new, self.best[n].column_names)])
        order = [("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
        both = both.take(pc.sort_indices(both, sort_keys=order, null_placement="at_start"))  # NaN is the largest, as in Spark
        q = both["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        both, q, rank = both.filter(pa.array(rank < self.k)), q[rank < self.k], rank[rank < self.k]
        row, met = both["row"].to_numpy(), both["met"].to_numpy().copy()
        fresh = np.flatnonzero(row >= 0)
        earlier = self.probed[q[fresh], : self.table] == buckets[row[fresh], : self.table, None]
        met[fresh] = earlier.any(axis=(1, 2))
        last = rank == self.k - 1
        score = both["score"].to_numpy()[last]
        self.least[q[last]] = np.where(np.isnan(score), np.inf, score)
        self.best[n] = pa.table([both["q"], both["score"], both["doc_id"], pa.array(np.full(len(q), -1)), pa.array(met)], both.column_names)

    def found(self) -> Iterator[pa.RecordBatch]:
        for best in self.best:
            kept = best.filter(pc.invert(best["met"])).combine_chunks()
            if len(kept):
                out = pa.table([self.qids.take(kept["q"].combine_chunks()), kept["doc_id"], kept["score"]], ["qid", "doc_id", "score"])
                yield from out.combine_chunks().to_batches()


def indexed_topk(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, qid_col: str, qvec_col: str, k: int = 10,
                 planes: Planes | None = None, probes: int = PROBES) -> DataFrame:
    """``qid, rank, doc_id, score``: top k by exact cosine among the rows that share a probed bucket with the query.

    Ties go to the smaller id, zero vectors have no cosine and are left out, vectors of another length, with NULL or with NaN
    entries, too. Equal rows are ranked one after the other. A query without candidates has no rows.
    """
    planes = planes or fit_planes(corpus, vec_col)
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, qid_col), (corpus, id_col))]
    if planes is None:
        return corpus.sparkSession.createDataFrame([], f"qid {kinds[0]}, rank int, doc_id {kinds[1]}, score double")
    c = with_buckets(corpus, id_col, vec_col, planes)
    c = c.select(F.posexplode("found").alias("t", "bucket"), F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("qid"),
                 F.col("id").alias("doc_id"), "vec", "found")
    q = with_buckets(queries, qid_col, qvec_col, planes, probes)
    q = q.select("id", "vec", F.flatten("found").alias("all"), F.posexplode("found").alias("t", "each"))
    q = q.select("t", F.explode("each").alias("bucket"), F.lit(0).alias("side"), F.col("id").alias("qid"),
                 F.lit(None).cast(kinds[1]).alias("doc_id"), "vec", F.col("all").alias("found"))
    tables = planes.tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, bucket = None, [], None  # a bucket's probes come before its rows
        for b in batches:
            t, cell, side = (b.column(n).to_numpy() for n in range(3))
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, b.num_rows]):
                if start == end:
                    continue
                part, key = b.slice(start, end - start), (t[start], cell[start])
                if key != at:
                    if bucket is not None:
                        yield from bucket.found()
                    at, held, bucket = key, [], None
                if side[start] == 0:
                    held.append(part)
                    continue
                if bucket is None and held:
                    every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    probed = _lists(every.column(6), every.num_rows).reshape(every.num_rows, tables, -1)
                    bucket, held = _Bucket(int(key[0]), k, every.column(3), _lists(every.column(5), every.num_rows), probed, b.schema.field(4).type), []
                if bucket is not None:
                    bucket.see(part.column(4), _lists(part.column(5), part.num_rows), _lists(part.column(6), part.num_rows))
        if bucket is not None:
            yield from bucket.found()

    dealt = q.unionByName(c).repartition("t", "bucket").sortWithinPartitions("t", "bucket", "side")
    scored = dealt.mapInArrow(run, f"qid {kinds[0]}, doc_id {kinds[1]}, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("qid", F.col("rank").cast("int").alias("rank"), "doc_id", P.round_half_up("score", 6).alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query the share of the exact answer (``qid, doc_id``) that ``found`` has."""
    hits = found.select("qid", "doc_id").distinct().withColumn("hit", F.lit(1))
    j = exact.select("qid", "doc_id").distinct().join(hits, ["qid", "doc_id"], "left")
    return j.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))

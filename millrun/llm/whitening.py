"""Embedding whitening from the covariance of distinct vectors, weighted by how often each occurs.

Vectors are scaled to whole numbers, so equal ones have equal bytes. They are grouped (counted before the shuffle, so a vector that
a third of all rows hold costs one row a task), and sums, covariance and projection run over the distinct
vectors with the counts as weights (or one, to fit on distinct vectors only): each task reduces its batches to one centred, weighted
matrix product, and the products of the tasks are added row by row in a shuffle. The driver sees sums and a matrix of the dimension's square, decomposes it,
and hands the components to the tasks, which whiten each distinct vector once. Rows join back by a 128-bit digest of the vector:
the few vectors with many rows through a broadcast whose size is bounded by their least count, all others through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: A vector with more than this share of the rows is joined back by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 2000
#: Scaled entries beyond this have no exact whole number as a double.
LARGEST = 2.0**53
WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def packed(embedding: pa.Array) -> list[bytes | None]:
    """Each vector's scaled entries as bytes, in the least width that holds them (so equal vectors have equal bytes);
    None for a null vector, and for one with a null, non-finite or too large entry."""
    out: list[bytes | None] = []
    lists = embedding.cast(pa.list_(pa.float64()))
    flat = lists.flatten()
    bad_entry = np.asarray(flat.is_null())
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    scaled = np.floor(values * SCALE)
    with np.errstate(invalid="ignore"):
        bad_entry = bad_entry | ~(np.abs(scaled) <= LARGEST)
    whole = np.where(bad_entry, 0, scaled).astype(np.int64)
    ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
    present = np.asarray(lists.is_valid())
    for end, length, ok in zip(ends, np.diff(ends, prepend=0), present, strict=True):
        part = whole[end - length : end]
        if not ok or bad_entry[end - length : end].any():
            out.append(None)
            continue
        least = min(part.min(), 0) if length else 0
        most = max(part.max(), 0) if length else 0
        width = next(w for w in WIDTHS if np.iinfo(w).min <= least and most <= np.iinfo(w).max)
        out.append(part.astype(f"<i{np.dtype(width).itemsize}").tobytes())
    return out


def unpacked(vectors: list[bytes], dimension: int) -> np.ndarray:
    """Rows of ``packed`` as whole numbers, without the shift."""
    out = np.empty((len(vectors), dimension), np.int64)
    for i, v in enumerate(vectors):
        out[i] = np.frombuffer(v, f"<i{len(v) // dimension}")
    return out


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """``vec_id, dimension, vector`` of the rows of ``embeddings(vec_id, embedding)`` whose vector is valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(1).cast(pa.list_(pa.float64())).value_lengths().cast(pa.int32())
            rows = pa.RecordBatch.from_arrays([b.column(0), lengths, pa.array(packed(b.column(1)), pa.binary())], ["vec_id", "dimension", "vector"])
            yield rows.filter(rows.column(2).is_valid())

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return embeddings.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, dimension int, vector binary")


@dataclass
class Fit:
    """What the covariance of the fit list says: ``n`` vectors with sums ``s`` (without the shift), components (columns) by falling
    eigenvalue, and the trace of the covariance."""

    dimension: int
    n: int
    s: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - s/n`` as doubles: the whole part of the mean goes first, exactly."""
        whole = np.array([si // self.n for si in self.s], np.int64)
        rest = np.array([si % self.n / self.n for si in self.s])
        return (x - whole).astype(np.float64) - rest


def sums(distinct: DataFrame, dimension: int) -> list[int]:
    """Weighted sums for each dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dimension
        for b in batches:
            x, w = unpacked(b.column(0).to_pylist(), dimension), b.column(1).to_numpy()
            if int(np.abs(x).max(initial=0)) * int(w.sum()) >= 1 << 62:
                x, w = x.astype(object), w.astype(object)
            total = [t + int(v) for t, v in zip(total, w @ x, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array([str(t) for t in total])], ["i", "s"])

    parts = distinct.select("vector", "weight").mapInArrow(run, "i int, s string")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r.s) for r in sorted(rows)] or [0] * dimension


def summed_products(rows: DataFrame, size: int, product) -> np.ndarray:
    """The sum over all batches of ``product(batch)``, a ``size`` x ``size`` matrix: one matrix a task, then added row by row."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            total += product(b)
        yield as_batch(range(size), list(total))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0.0) + np.frombuffer(row)
        yield as_batch(list(total), list(total.values()))

    def as_batch(at, matrix: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([r.tobytes() for r in matrix], pa.binary())], ["i", "row"])

    schema = "i int, row binary"
    found = rows.mapInArrow(per_task, schema).repartition("i").mapInArrow(added, schema).collect()  # size rows
    out = np.zeros((size, size))
    for r in found:
        out[r.i] = np.frombuffer(r.row)
    return out


def fit(distinct: DataFrame, dimension: int, components: int = COMPONENTS) -> Fit:
    """Fit on the distinct vectors ``distinct(vector, weight)`` of one dimension. A component whose eigenvalue is nothing but rounding is left out."""
    n = int(distinct.agg(F.sum(F.col("weight").cast("decimal(38,0)"))).first()[0])
    mean = Fit(dimension, n, sums(distinct, dimension), np.zeros((dimension, 0)), np.zeros(0), 0.0)

    def product(b: pa.RecordBatch) -> np.ndarray:
        c = mean.centred(unpacked(b.column(0).to_pylist(), dimension))
        return (c * b.column(1).to_numpy().astype(np.float64)[:, None]).T @ c

    v = summed_products(distinct.select("vector", "weight"), dimension, product) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(initial=0.0), 0.0) * dimension * 1e-14]
    return Fit(dimension, n, mean.s, vectors[:, order], values[order], float(np.trace(v)))


def deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """Sum over dimensions of ``(n * x - s)^2``, exact; None where a long cannot hold it."""
    s = np.array(model.s, object)
    top = max(int(np.abs(x).max(initial=0)) * model.n, int(np.abs(s).max(initial=0)))
    if 2 * top < 1 << 62:
        d = x * model.n - s.astype(np.int64)
        if len(d) and int(np.abs(d).max()) ** 2 * model.dimension < 1 << 63:
            return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * model.n - s
    exact = [int(v) for v in (d * d).sum(axis=1)]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, weights: str = "counts", hot_share: float = HOT_SHARE) -> DataFrame:
    """``vec_id, n, deviation, whitened (array), explained (array), identity_error`` for each valid row of ``embeddings(vec_id, embedding)``.

    ``weights`` is "counts" (the covariance of all rows) or "one" (of the distinct vectors). Rows whose vector is null or
    holds null or non-finite entries are dropped, and entries beyond 2^53 / 64 count as non-finite. Vectors of another length than the most
    frequent one (of equally frequent ones the longest) are dropped, too. Repeated rows and null ids stay. Only components
    with a variance beyond rounding are returned: none if all vectors are equal, so the arrays may be empty. An
    empty table gives an empty result; other columns are ignored. ``deviation`` is null where it passes a long.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = written(vectors_of(embeddings).withColumn("digest", F.unhex(F.md5("vector"))), "embeddings")
    distinct = written(rows.groupBy("dimension", "vector").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    lengths = distinct.groupBy("dimension").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("dimension")).limit(1)
    modal = lengths.first()
    schema = f"vec_id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    if modal is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dimension = modal.dimension
    distinct = distinct.where(F.col("dimension") == dimension).withColumn("weight", F.col("copies") if weights == "counts" else F.lit(1).cast("bigint"))
    model = fit(distinct, dimension, components) if dimension else Fit(0, int(modal.n), [], np.zeros((0, 0)), np.zeros(0), 0.0)
    scale = model.components / np.sqrt(model.eigenvalues)
    k = scale.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column(2).to_pylist(), dimension) if dimension else np.zeros((b.num_rows, 0), np.int64)
            z = model.centred(x) @ scale if dimension else np.zeros((b.num_rows, 0))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(deviations(x, model), pa.int64()), cells], ["digest", "copies", "weight", "deviation", "whitened"])

    source = distinct.select(F.unhex(F.md5("vector")).alias("digest"), "copies", "vector", "weight")
    whitened = written(source.mapInArrow(project, "digest binary, copies bigint, weight bigint, deviation bigint, whitened array<double>"), "whitened")

    def gram(b: pa.RecordBatch) -> np.ndarray:
        z = b.column(0).flatten().to_numpy().reshape(b.num_rows, k)
        return (z * b.column(1).to_numpy().astype(np.float64)[:, None]).T @ z

    error = float(np.abs(summed_products(whitened.select("whitened", "weight"), k, gram) / model.n - np.eye(k)).max()) if k else 0.0
    ids = rows.where(F.col("dimension") == dimension).select("vec_id", "digest")
    found = joined_back(ids, whitened.select("digest", "copies", "deviation", "whitened"), int(modal.n), hot_share)
    explained = [float(e / model.trace) for e in model.eigenvalues]
    return found.select(
        "vec_id",
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.lit(explained).cast("array<double>").alias("explained") if k else F.array().cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def joined_back(ids: DataFrame, whitened: DataFrame, n: int, hot_share: float) -> DataFrame:
    """Rows of ``ids`` with their vector's columns; vectors with more than ``hot_share`` of all rows by broadcast (at most 1 / hot_share)."""
    least = max(2, int(n * hot_share) + 1)
    hot = whitened.where(F.col("copies") >= least).drop("copies")
    rare = whitened.where(F.col("copies") < least).drop("copies")
    # At most 1 / HOT_SHARE vectors of COMPONENTS numbers: 0.6 MB.
    by_broadcast = ids.join(F.broadcast(hot), "digest")
    others = ids.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return by_broadcast.unionByName(others.join(rare.hint("shuffle_merge"), "digest"))

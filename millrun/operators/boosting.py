"""Boosted trees of all folds at once (L2, L6): the trees of Spark ML's GBTClassifier, one job a level of a tree.

Spark ML fits a fold at a time with a job of two stages for each level of each tree: thousands of short jobs, whatever the rows. Here the rows
lie in bins of a byte a value, and a job counts one level's histograms for the trees of every fold; the driver chooses the splits
from the sums. Thresholds, row sampling, gains, leaf values and residuals are those of GBTClassifier (logistic loss, variance).

A worker keeps the margins of the partitions it has seen and adds the trees made since; they follow from the rows and the trees
alone, so that a worker without them (another executor, a retried task) starts from the first tree and comes to the same.
"""

from __future__ import annotations

import gc
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT_MARGINS, KEPT_CELLS = 64_000_000, 128_000_000  # bytes that a worker keeps
PAIRS = 8  # of features, whose counts are split up together
WEIGHTS = 4  # so many distinct weights are counted apart instead of added up
COLLECTED = 32  # tasks whose histograms go to the driver as they are; those of more are added up by fold first
EPSILON = 2.0**-52


class Boosting(NamedTuple):
    """Parameters and defaults of GBTClassifier."""

    maxIter: int = 20
    maxDepth: int = 5
    stepSize: float = 0.1
    subsamplingRate: float = 1.0
    minInstancesPerNode: int = 1
    minInfoGain: float = 0.0
    maxBins: int = 32
    seed: int = 0


# ---- Spark's random numbers: a row is drawn by its place in the partition -------------------------


def _mixed(data: bytes, seed: int) -> int:
    """MurmurHash3 of whole words, as Scala's bytesHash."""
    low, h = 0xFFFFFFFF, seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & low
        k = (k << 15 | k >> 17) * 0x1B873593 & low
        h ^= k
        h = ((h << 13 | h >> 19) & low) * 5 + 0xE6546B64 & low
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & low
    h = (h ^ h >> 13) * 0xC2B2AE35 & low
    return h ^ h >> 16


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ x << np.uint64(21)
    x = x ^ x >> np.uint64(35)
    return x ^ x << np.uint64(4)


@lru_cache(maxsize=64)
def _leap(j: int) -> np.ndarray:
    """2**j steps, which are linear in the bits: the image of each value of each of the eight bytes."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    image = _leapt(_leapt(bits, j - 1), j - 1) if j else _step(bits)
    table = np.zeros((8, 256), np.uint64)
    for i in range(64):
        has = np.arange(256) >> i % 8 & 1 == 1
        table[i // 8, has] ^= image[i]
    return table


def _leapt(x: np.ndarray, j: int) -> np.ndarray:
    out = np.zeros_like(x)
    for b, table in enumerate(_leap(j)):
        out ^= table[(x >> np.uint64(8 * b) & np.uint64(255)).astype(np.intp)]
    return out


def _states(seed: int, n: int) -> np.ndarray:
    """The first n states of XORShiftRandom(seed)."""
    data = (seed & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")
    low = _mixed(data, 0x3C074A61)
    high = _mixed(data, low)
    x = _step(np.array([high << 32 | low], np.uint64))
    j = 0
    while len(x) < n:
        x = np.concatenate([x, _leapt(x[: n - len(x)], j)])
        j += 1
    return x[:n]


def uniform(seed: int, n: int) -> np.ndarray:
    """The first n doubles of XORShiftRandom(seed)."""
    x = _states(seed, 2 * n)
    high, low = x[::2] & np.uint64((1 << 26) - 1), x[1::2] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(np.float64) * 2.0**-53


def _next_int(seed: int) -> int:
    x = int(_states(seed, 1)[0]) & 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


# ---- bins ---------------------------------------------------------------------------------------


def thresholds(values: np.ndarray, weights: np.ndarray, total: float, most: int) -> np.ndarray:
    """At most ``most`` thresholds of a feature from sampled rows; ``total``: the weight that the sample stands for.

    Between neighbouring values; where there are too many, those that come closest to equal weights. Zeros have what is left of the total."""
    if not np.isfinite(values).all():
        return np.empty(0)
    seen = values != 0.0
    v, which = np.unique(values[seen], return_inverse=True)
    if not len(v):
        return np.empty(0)
    held = np.bincount(which, weights[seen])
    if (rest := total - held.sum()) > EPSILON * seen.sum() * 100:
        at = np.searchsorted(v, 0.0)
        v, held = np.insert(v, at, 0.0), np.insert(held, at, rest)
    between = (v[:-1] + v[1:]) / 2.0
    if len(between) <= most:
        return between
    upto = np.cumsum(held)
    middle = (upto[:-1] + upto[1:]) / 2.0  # a target below it is closer to the sum before than to the sum after
    stride = target = total / (most + 1)
    out, i = [], 0
    while (i := max(i, int(np.searchsorted(middle, target, side="right")))) < len(middle):
        out.append(between[i])
        target += stride
        i += 1
    return np.array(out)


def fold_thresholds(rows: DataFrame, n_features: int, weight: str | None, rows_k: int, p: Boosting) -> list[np.ndarray]:
    """The thresholds of each feature of ``scaled``, from about 10,000 rows as GBTClassifier draws them."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    drawn = rows.select(w.alias("w"), "scaled")
    total = rows.agg(F.sum(w)).first()[0] if weight else float(rows_k)
    share = min(1.0, max(p.maxBins**2, 10_000) / rows_k)
    if share < 1.0:
        spark = rows.sparkSession
        some = drawn._jdf.javaRDD().sample(False, share, _next_int(p.seed))
        drawn = DataFrame(spark._jsparkSession.createDataFrame(some, drawn._jdf.schema()), spark)
    got = drawn.select("w", vector_to_array("scaled").alias("x")).toArrow()
    held = got["w"].to_numpy()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(held), n_features)
    most = min(p.maxBins, rows_k) - 1
    return [thresholds(x[:, f], held, share * total, most) for f in range(n_features)]


class Block(NamedTuple):
    """A partition's rows: label 1 or -1; ``codes`` [feature, row] tell every fold's bin of the value (``bins`` [fold, feature, code])."""

    fold: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    codes: np.ndarray


def _binned(scales: list, cuts: list, n_features: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks: a value's code is the sum of its bins in the folds, which grows with the value, and so tells each of them."""
    most = 1 + max((sum(len(c[f]) for c in cuts) for f in range(n_features)), default=0)
    kind = np.uint8 if most <= 256 else np.uint16
    for b in batches:
        n = b.num_rows
        label, weight = (b[c].to_numpy(zero_copy_only=False) for c in ("label", "weight"))
        if not np.isin(label, (0.0, 1.0)).all() or not (weight >= 0.0).all():
            raise ValueError("labels must be 0 or 1, and weights not negative")
        fold = b["fold"].to_numpy(zero_copy_only=False).astype(np.int16)
        x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, n_features)
        codes, bins = np.zeros((n_features, n), kind), np.full((len(cuts), n_features, most), -1, np.int16)
        for f in range(n_features):
            own = []
            for k, ((mean, scale), cut) in enumerate(zip(scales, cuts, strict=True)):
                scaled = (x[:, f] - mean[f]) * scale[f]
                if not np.isfinite(scaled[fold != k]).all():
                    raise ValueError("features of rows to fit on must not be null, NaN or infinite")
                own.append(np.searchsorted(cut[f], scaled))
                codes[f] += own[-1].astype(kind)
            for k, of in enumerate(own):
                bins[k, f, codes[f]] = of
        parts = (fold, (label * 2.0 - 1.0).astype(np.int8), weight, codes, bins)
        yield pa.RecordBatch.from_pydict({"block": pa.array([np.ascontiguousarray(a).tobytes() for a in parts]).cast(pa.binary()), "n": pa.array([n] * len(parts), pa.int32())})


def _joined(shape: tuple[int, int, int], kind: str, rows) -> Iterator[tuple[Block, np.ndarray]]:
    """The blocks of a partition as one, and the bins seen for each code."""
    n_folds, n_features, most = shape
    parts, bins = [[], [], [], []], np.full(shape, -1, np.int16)
    rows = iter(rows)
    for first in rows:
        more = [next(rows) for _ in range(4)]
        n = first["n"]
        a = [np.frombuffer(r["block"], t) for r, t in zip((first, *more), (np.int16, np.int8, np.float64, kind, np.int16), strict=True)]
        for to, of in zip(parts, (*a[:3], a[3].reshape(n_features, n)), strict=True):
            to.append(of)
        np.maximum(bins, a[4].reshape(shape), out=bins)
    if parts[0]:
        yield Block(*(np.concatenate(x, axis=-1) for x in parts)), bins


# ---- trees --------------------------------------------------------------------------------------


class Trees:
    """Trees of every fold: inner nodes by level, a row with a code above ``cut`` goes right; a leaf above the last level sends all left."""

    def __init__(self, n_folds: int, depth: int, n: int = 1) -> None:
        self.feature = np.zeros((n, n_folds, 2**depth - 1), np.int16)
        self.cut = np.full((n, n_folds, 2**depth - 1), np.iinfo(np.int16).max, np.int16)
        self.value = np.zeros((n, n_folds, 2**depth))
        self.weight = np.zeros(n)

    def upto(self, m: int, since: int = 0) -> Trees:
        out = object.__new__(Trees)
        out.feature, out.cut, out.value, out.weight = (a[since:m] for a in (self.feature, self.cut, self.value, self.weight))
        return out


def _places(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Each row's node of a level, from the left."""
    rows = np.arange(codes.shape[1])
    at = (codes[feature[0]] > cut[0]).astype(np.intp) if levels else np.zeros(len(rows), np.intp)
    for level in range(1, levels):
        node = 2**level - 1 + at
        at = 2 * at + (codes[feature[node], rows] > cut[node])
    return at


class Pairs(NamedTuple):
    """Features counted in pairs [pair, 2], in a cell for each two bins; ``width`` bins at most, ``bins`` [fold, feature, code]."""

    features: np.ndarray
    width: int
    bins: np.ndarray

    def cells(self, block: Block) -> np.ndarray:
        """[fold, pair, row]: the rows' cells."""
        out = np.empty((len(self.bins), len(self.features), len(block.fold)), self.bins.dtype)
        for k, bins in enumerate(self.bins):
            for g, (a, b) in enumerate(self.features):
                out[k, g] = bins[a].take(block.codes[a]) * self.bins.dtype.type(self.width) + bins[b].take(block.codes[b])
        return out


def paired(bins: np.ndarray) -> Pairs:
    """Pairs of the features that can be split, at least one; the last is paired with itself where the number is odd."""
    used = np.flatnonzero((bins > 0).any(axis=(0, 2))).tolist() or [0]
    width = int(bins.max()) + 1
    return Pairs(np.array([*used, *used[-1:] * (len(used) % 2)]).reshape(-1, 2), width, np.maximum(bins, 0).astype(np.min_scalar_type(width**2)))


class Kept:
    """What a worker keeps of each run and partition, up to ``most`` bytes; the rest is made again."""

    def __init__(self, most: int) -> None:
        self.most, self.held = most, OrderedDict()

    def pop(self, key):
        return self.held.pop(key, None)

    def put(self, key, value: tuple, nbytes: int) -> None:
        self.held[key] = (value, nbytes)
        while len(self.held) > 1 and sum(x[1] for x in self.held.values()) > self.most:
            self.held.popitem(last=False)


_MARGINS, _CELLS = Kept(KEPT_MARGINS), Kept(KEPT_CELLS)
_DRAWN = lru_cache(maxsize=8)(uniform)


@lru_cache(maxsize=1)
def _settled() -> None:
    """Spark collects garbage after each task; what a worker has loaded by now (50 ms to go through) is left out of it."""
    gc.freeze()


def _margins(run: str, index: int, block: Block, trees: Trees) -> np.ndarray:
    """The margins [fold, row] after these trees."""
    n, n_folds, leaves = trees.value.shape
    (since, margins), _ = _MARGINS.pop((run, index)) or ((0, None), 0)
    if margins is None or since > n:
        since, margins = 0, np.zeros((n_folds, len(block.fold)))
    for m in range(since, n):
        for k, margin in enumerate(margins):
            margin += trees.weight[m] * trees.value[m, k][_places(block.codes, trees.feature[m, k], trees.cut[m, k], leaves.bit_length() - 1)]
    _MARGINS.put((run, index), (n, margins), margins.nbytes)
    return margins


def _cells(run: str, index: int, block: Block, pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' cells [fold, pair, row]; the weights, and each row's place among them (many weights: none, and all in one place)."""
    found, _ = _CELLS.pop((run, index)) or (None, 0)
    if found is None:
        weights, which = np.unique(block.weight, return_inverse=True)
        few = len(weights) <= WEIGHTS
        found = pairs.cells(block), weights if few else None, which if few else np.zeros(len(which), np.intp)
    _CELLS.put((run, index), found, found[0].nbytes + found[2].nbytes)
    return found


def _count(run: str, p: Boosting, shared, trees: Trees, tree: Trees, level: int, slots: dict[int, np.ndarray], index: int, blocks):
    """(fold, [rows | weight | weighted residual, feature of the pairs, slot, bin]) of a level's nodes; ``slots`` [node]: where it is counted, or -1."""
    _settled()
    pairs: Pairs = shared.value
    n_pairs, width = len(pairs.features), pairs.width
    for block in blocks:
        margins = _margins(run, index, block, trees)
        cells, weights, which = _cells(run, index, block, pairs)
        m, apart = len(trees.weight), 1 if weights is None else len(weights)
        drawn = _DRAWN(p.seed + m + index + 1, len(block.fold)) < p.subsamplingRate if p.subsamplingRate < 1.0 else None
        for k, slot in slots.items():
            own = np.flatnonzero(block.fold != k)
            if drawn is not None:
                own = own[drawn[: len(own)]]
            at = slot[_places(block.codes, tree.feature[0, k], tree.cut[0, k], level)[own]]
            if level:
                own, at = own[at >= 0], at[at >= 0]
            y, w = block.label[own], block.weight[own]
            # the first tree is fitted on the labels, the others on minus the gradient of the loss
            rest = w * (4.0 * y / (1.0 + np.exp(2.0 * y * margins[k, own])) if m else y)
            n_slots = int(slot.max()) + 1
            first = (which[own] * n_slots + at) * width**2
            adding = [None, rest] if weights is not None else [None, rest, w]
            shape = (len(adding), PAIRS, apart, n_slots, width, width)
            joint, one = np.empty(shape), np.ones(width)
            each = np.empty((len(adding), n_pairs, 2, apart, n_slots, width))
            for g in range(n_pairs):
                cell = first + cells[k, g].take(own)
                for to, x in zip(joint, adding, strict=True):
                    to[g % PAIRS] = np.bincount(cell, x, apart * n_slots * width**2).reshape(shape[2:])
                if (done := g % PAIRS + 1) == PAIRS or g == n_pairs - 1:
                    np.matmul(joint[:, :done], one, out=each[:, g + 1 - done : g + 1, 0])
                    np.sum(joint[:, :done], axis=-2, out=each[:, g + 1 - done : g + 1, 1])
            each = each.reshape(len(adding), 2 * n_pairs, apart, n_slots, width)
            held = np.tensordot(weights, each[0], (0, 1)) if weights is not None else each[2, :, 0]
            yield k, np.stack([each[0].sum(axis=1), held, each[1].sum(axis=1)])


def _held_out(run: str, trees: Trees, index: int, blocks) -> Iterator[tuple[int, float, float]]:
    """Fold, label and margin of the rows, by the trees of the fold that did not see them."""
    for block in blocks:
        margins = _margins(run, index, block, trees)
        for kept in (_MARGINS, _CELLS):
            kept.pop((run, index))
        own = margins[block.fold, np.arange(len(block.fold))]
        yield from zip(block.fold.tolist(), ((block.label + 1.0) / 2.0).tolist(), own.tolist(), strict=True)


def _best(counted: np.ndarray, n_cuts: np.ndarray, p: Boosting):
    """The best split of a node's [3, feature, bin]: feature, bin, and the sums to its left; None if no split gains."""
    upto = counted.cumsum(axis=2)
    rows, held, rest = upto
    all_rows, all_held, all_rest = upto[:, :1, -1:]
    may = (rows >= p.minInstancesPerNode) & (all_rows - rows >= p.minInstancesPerNode)
    may &= np.arange(rows.shape[1]) < n_cuts[:, None]

    def square(s, w):
        return np.divide(s * s, w, out=np.zeros_like(s), where=w > 0)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (square(rest, held) + square(all_rest - rest, all_held - held) - square(all_rest, all_held)) / all_held
    gain = np.where(may, gain, -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, b] > 0.0 or gain[f, b] < p.minInfoGain:
        return None
    return int(f), int(b), *upto[:, f, b]


def boost(blocks: RDD, bins: np.ndarray, cuts: list[list[np.ndarray]], p: Boosting, run: str) -> Trees:
    """The trees of the folds; ``cuts`` [fold][feature] are thresholds, ``bins`` the bin of each code. A fold's rows are not in its trees."""
    n_folds = len(cuts)
    n_cuts = np.array([[len(c) for c in of] for of in cuts])
    trees = Trees(n_folds, p.maxDepth, p.maxIter)
    # the last code with a bin is where a split at that bin cuts
    last = np.stack([np.where((bins >= 0) & (bins <= b), np.arange(bins.shape[2]), -1).max(axis=2) for b in range(int(bins.max()) + 1)], axis=2)
    pairs = paired(bins)
    features = pairs.features.ravel()
    shared = blocks.context.broadcast(pairs)
    mean = lambda s, w: s / w if w > 0 else 0.0
    for m in range(p.maxIter):
        trees.weight[m] = p.stepSize if m else 1.0
        tree = trees.upto(m + 1, m)
        nodes: dict[int, dict] = {k: {0: None} for k in range(n_folds)}  # by fold and place: the rows and the parent's sums of a node to split
        for level in range(max(p.maxDepth, 1)):
            slots, wanted = {}, {}
            for k, own in nodes.items():
                # of two halves the one with fewer rows is counted: the other is the rest
                wanted[k] = [c for c, s in own.items() if s is None or (s[0], c & 1) < (own[c ^ 1][0], ~c & 1)]
                slots[k] = np.full(2**level, -1, np.intp)
                slots[k][wanted[k]] = np.arange(len(wanted[k]))
            got = blocks.mapPartitionsWithIndex(partial(_count, run, p, shared, trees.upto(m), tree, level, slots))
            if blocks.getNumPartitions() > COLLECTED:
                got = got.reduceByKey(np.add, len(slots))
            sums: dict[int, np.ndarray] = {}
            for k, part in got.collect():
                sums[k] = sums[k] + part if k in sums else part
            below: dict[int, dict] = {}
            for k, own in nodes.items():
                counted = {c: sums[k][:, :, i] for i, c in enumerate(wanted[k])}
                counted |= {c: own[c][1] - counted[c ^ 1] for c in own if c not in counted}
                for c, of in counted.items():
                    _, all_held, all_rest = of[:, 0].sum(axis=1)
                    if level == 0:
                        tree.value[0, k] = mean(all_rest, all_held)
                    if level == p.maxDepth or not (split := _best(of, n_cuts[k, features], p)):
                        continue
                    i, b, rows, held, rest = split
                    f = features[i]
                    at, span = 2**level - 1 + c, 2 ** (p.maxDepth - level - 1)
                    tree.feature[0, k, at], tree.cut[0, k, at] = f, last[k, f, b]
                    tree.value[0, k, 2 * c * span : (2 * c + 1) * span] = mean(rest, held)
                    tree.value[0, k, (2 * c + 1) * span : (2 * c + 2) * span] = mean(all_rest - rest, all_held - held)
                    below.setdefault(k, {}).update({2 * c: (rows, of), 2 * c + 1: (of[0, 0].sum() - rows, of)})
            if not (nodes := below):
                break
    shared.destroy()
    return trees


def held_out_margins(rows: DataFrame, prepared: dict[int, PipelineModel], sizes: dict[int, int], label: str, weight: str | None, fold: str, p: Boosting) -> DataFrame:
    """DataFrame[fold, label, margin]: each row by the trees fitted on the rows of the other folds, for the folds ``prepared``.

    ``prepared`` has the model that assembles and scales the features (``raw``, ``scaled``), fitted on the other folds' rows; ``sizes`` their number."""
    folds = sorted(prepared)
    scalers = [prepared[k].stages[-1] for k in folds]
    n_features = scalers[0].mean.size
    with ThreadPoolExecutor(max_workers=len(folds)) as pool:
        fitted = lambda k: prepared[k].transform(rows.filter(F.col(fold) != k))
        cuts = list(pool.map(lambda k: fold_thresholds(fitted(k), n_features, weight, sizes[k], p), folds))
    std = [s.std.toArray() for s in scalers]
    scales = [(s.mean.toArray(), np.divide(1.0, d, out=np.zeros_like(d), where=d != 0.0)) for s, d in zip(scalers, std, strict=True)]
    place = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(folds) for x in (k, i))), F.col(fold)), F.lit(-1))
    raw = prepared[folds[0]].stages[0].transform(rows).select(
        place.alias("fold"), F.col(label).cast("double").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), vector_to_array("raw").alias("x"),
    )
    most = 1 + max((sum(len(c[f]) for c in cuts) for f in range(n_features)), default=0)
    shape, kind = (len(folds), n_features, most), "uint8" if most <= 256 else "uint16"
    packed = raw.mapInArrow(partial(_binned, scales, cuts, n_features), "block binary, n int")
    both = packed.rdd.mapPartitions(partial(_joined, shape, kind)).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = both.keys()
    run = uuid.uuid4().hex
    try:
        bins = both.values().reduce(np.maximum)
        trees = boost(blocks, bins, cuts, p, run)
        scored = blocks.mapPartitionsWithIndex(partial(_held_out, run, trees)).filter(lambda r: r[0] >= 0)
        spark = rows.sparkSession
        out = spark.createDataFrame(scored, f"{fold} int, {label} double, margin double", verifySchema=False).persist()
        out.count()
    finally:
        both.unpersist()
    return out

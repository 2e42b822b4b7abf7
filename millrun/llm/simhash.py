"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set if more than half of its shingle hashes have it. Two
fingerprints at most ``max_bits`` apart share a string at most half that far from either, so every
distinct fingerprint emits all variants within ``max_bits / 2`` flips, the variants are shuffled, and
fingerprints that meet on a variant are verified by their bit distance.

The variants travel implicitly. They are dealt out by their leading bits: a fingerprint is sent once
to every leading-bit pattern that one of its variants has (1 + b + b(b-1)/2 for b bits and radius 2),
and the receiving task spells out exactly those variants. A pattern around which many fingerprints
lie is split by a hash of the variant, so no task spells out more than a bounded number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import fits_broadcast, shuffle_partitions, sorted_groups, written
from millrun.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Variants that one task spells out at a time, about.
VARIANTS_A_TASK = 1 << 20


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, words between ASCII white space, word shingles with repeats.

    Fewer words than a shingle: the whole sequence is the one shingle. No word, or null: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[min(shingle_words, len(words)) - 1 :].tolist()
    first = [0, *(ends + 1).tolist()][: len(last)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[s:e], seed) for s, e in zip(first, last, strict=True)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, th, fp)`` for every row of ``docs(doc_id, text)``: text hash and the fingerprint's signed 64-bit value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle_words, seed) for t in b.column(2).to_pylist()), np.uint64, len(b))
            cols = [b.column(0), b.column(1), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, th bigint, fp bigint")


def flips(low: int, high: int, most: int) -> np.ndarray:
    """All 64-bit masks with at most ``most`` bits set, among bits low..high-1."""
    sets = (c for n in range(most + 1) for c in combinations(range(low, high), n))
    return np.array([sum(1 << i for i in c) for c in sets], np.uint64)


def meeting_edges(distinct_fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``distinct_fps(fp)`` -> edges ``(a, b)`` that connect exactly the fingerprints linked at ``max_bits``.

    Every emitted edge joins fingerprints of one class, and all links are implied by the edges;
    links that a task already has by way of others are left out, so hot classes give few rows.
    """
    spark = distinct_fps.sparkSession
    radius = (max_bits + 1) // 2
    n = distinct_fps.count()
    ball = sum(math.comb(64, i) for i in range(radius + 1))
    bits = min(48, max(1, math.ceil(math.log2(max(2, n * ball / VARIANTS_A_TASK)))))
    low = 64 - bits
    inner = [flips(0, low, r) for r in range(radius + 1)]
    outer = flips(low, 64, radius)
    # Patterns that hold more than a task's share of the fingerprints, and the parts that each is split into.
    patterns = distinct_fps.groupBy(F.shiftrightunsigned("fp", low).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") * len(inner[radius]) / (4 * VARIANTS_A_TASK))
    hot = written(patterns.select("k", parts.alias("salts")).where("salts > 1"), "hot-patterns")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 4096):
                fp = b.column(0).slice(i, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                fp = np.ascontiguousarray(fp)
                k = ((fp[:, None] ^ outer[None, :]) >> np.uint64(low)).astype(np.int64).ravel()
                owner = np.repeat(fp, len(outer)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(owner)], ["k", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, salt, salts), (fp,) in sorted_groups(batches, 3):
            a, b = meet_in_bucket(fp.view(np.uint64), int(k), int(salt), int(salts), low, inner, max_bits)
            if len(a):
                out = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, ["a", "b"])

    sent = distinct_fps.select("fp").mapInArrow(emit, "k bigint, fp bigint")
    split = sent.join(F.broadcast(hot) if fits_broadcast(hot) else hot, "k", "left")
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    sent = split.select("k", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"), salts.alias("salts"), "fp")
    dealt = sent.repartition(shuffle_partitions(spark), "k", "salt").sortWithinPartitions("k", "salt")
    return dealt.mapInArrow(meet, "a bigint, b bigint")


def meet_in_bucket(
    fp: np.ndarray, k: int, salt: int, salts: int, low: int, inner: list[np.ndarray], max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Spell out the variants of ``fp`` whose leading bits are ``k`` (and whose hash falls on ``salt``); link those that meet."""
    fp = np.unique(fp)
    radius = len(inner) - 1
    left = radius - np.bitwise_count((fp >> np.uint64(low)) ^ np.uint64(k)).astype(np.int64)
    base = (fp & np.uint64((1 << low) - 1)) | np.uint64(k << low)
    variants, owners = [], []
    for r, masks in enumerate(inner):
        at = np.flatnonzero(left == r)
        step = max(1, VARIANTS_A_TASK // len(masks))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            v = (base[part][:, None] ^ masks[None, :]).ravel()
            o = np.repeat(part, len(masks))
            if salts > 1:
                mine = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(salts) == np.uint64(salt)
                v, o = v[mine], o[mine]
            variants.append(v)
            owners.append(o)
    if not variants:
        return fp[:0], fp[:0]
    v, o = np.concatenate(variants), np.concatenate(owners)
    s = np.sort(v)
    met = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(met):
        return fp[:0], fp[:0]
    hit = met[np.minimum(np.searchsorted(met, v), len(met) - 1)] == v
    v, o = v[hit], o[hit]
    order = np.lexsort((o, v))
    v, o = v[order], o[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    head = np.repeat(o[first], np.diff(np.append(first, len(v))))
    pair = np.unique(head * len(fp) + o)
    a, b = pair // len(fp), pair % len(fp)
    near = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= max_bits)
    root = local_roots(a[near], b[near], len(fp))
    at = np.flatnonzero(root != np.arange(len(fp)))
    return fp[root[at]], fp[at]


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of each node's class, for links a-b among n nodes."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def fingerprint_classes(fps: DataFrame, first: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, first``: for each distinct fingerprint of ``fps``, the least value of the expression ``first`` in its class."""
    reps = written(fps.groupBy("fp").agg(F.expr(f"min({first})").alias("first")), "distinct-fps")
    roots = connected_components(meeting_edges(reps.select("fp"), max_bits))
    named = reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("fp", "root").join(least, "root").select("fp", "first")


def simhash_near_dedup(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest doc_id of all
    documents reachable by links of at most ``max_bits`` differing bits. Empty and null texts have
    fingerprint zero and link like any other. Repeated rows come back as often as they come in;
    a null doc_id is never smallest unless all are null. Other columns are ignored, an empty table gives
    an empty result. Copies share one fingerprint and never form pairs.
    """
    fps = written(fingerprints(docs, shingle_words), "fps")
    classes = fingerprint_classes(fps, "doc_id", max_bits)
    return fps.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id")
    )


def keep_one_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest doc_id.

    Of rows with that doc_id, the one of least text hash stays; of those that differ in other columns only, the one whose
    columns have the least hash. A null doc_id comes after all others. All columns are kept; names that begin with an underscore are reserved.
    """
    fps = written(fingerprints(docs, shingle_words), "fps")
    best = fingerprint_classes(fps, "struct(doc_id is null as n, doc_id, th)", max_bits).select("first").distinct()
    best = best.select(F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th"))
    rows = docs.withColumn("_h", F.xxhash64("text"))
    kept = rows.join(best, rows.doc_id.eqNullSafe(best._id) & (rows._h == best._th), "left_semi")
    one = kept.groupBy("doc_id", "_h").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return one.select("_row.*")

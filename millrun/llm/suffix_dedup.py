"""Exact substring dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

A suffix array of every byte position would be many times the corpus, so suffixes are sampled by
content. Every window of ``length`` bytes has one *anchor*, the gram of ``GRAM`` bytes in it with the
least hash (leftmost of equals). Equal windows have their anchors at the same offset, so windows can
repeat only where anchor grams repeat, and each anchor answers for the consecutive windows that
chose it.

1. Anchors of all documents; grams that occur once are dropped (partial counts, then a join).
2. Each task sorts the suffixes that start at its repeated anchors, collapses equal ones, and writes
   them as a sorted *run*, cut at splitters drawn from the grams and front-coded (each suffix holds
   only what differs from the one before).
3. Each key range merges its runs with a loser tree that carries common-prefix lengths: two suffixes
   are compared from the first byte that is not already known to be equal. The merge gives the longest
   common prefixes of neighbours; the bytes before the anchors are ranked likewise. Windows at offset
   d are equal exactly if the classes of both sides are equal at d and length - d bytes.
4. The repeated offsets go back to the documents, whose covered bytes are cut out.

A gram that holds more than a fair part of a key range (a passage in a third of all documents) is not
merged in one task: its windows are counted by their 128-bit digest with partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import shuffle_partitions, written

LENGTH = 200
GRAM = 64
#: Bytes hashed at a time; a longer text is taken in overlapping pieces with the same anchors.
PIECE = 1 << 17
POSITION = np.uint64((1 << 18) - 1)
#: Distinct suffixes in one run, bytes of a gram that splitters are compared by, and how many grams are sampled for them.
RUN_SUFFIXES = 60_000
SPLIT_BYTES = 24
SAMPLE_EVERY = 64
SAMPLE_A_RANGE = 16
RANGE_SUFFIXES = 50_000
#: A gram is merged in one task unless it occurs oftener than LEAST_HOT times and than a FAIR_PARTS-th of a range's mean.
LEAST_HOT = 256
FAIR_PARTS = 4


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    table = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table, run(base), run(inverse)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A content hash of each gram of ``b`` (at most one piece)."""
    table, up, down = _powers(PIECE + 4 * LENGTH)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[b] * up[: len(b)], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, position, least and greatest distance to the start of its windows, of each anchor of ``b``."""
    out = []
    for s in range(0, len(b) - length + 1, PIECE):
        h = gram_hashes(b[s : s + PIECE + length - 1])
        key = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, length - GRAM + 1) & POSITION).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        a = at[first]
        out.append((h[a], s + a, a - last, a - first))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def common_prefixes(items: list[bytes], width: int) -> np.ndarray:
    """Length of the common prefix of each item with the one before (0 for the first)."""
    out = np.zeros(len(items), np.int64)
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    for i in range(1, len(items), 8192):
        part = items[i - 1 : i + 8192]
        m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(-1, width)
        differ = m[1:] != m[:-1]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[i : i + len(n)] = np.minimum(n, np.minimum(sizes[i : i + len(n)], sizes[i - 1 : i - 1 + len(n)]))
    return out


# --- runs -------------------------------------------------------------------------------------------


def encode_run(entries: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Front-code suffixes sorted by bytes. An entry: suffix, bytes before the anchor, number, 1 or 2 (or more) copies."""
    suffixes = [e[0] for e in entries]
    lcp = common_prefixes(suffixes, LENGTH)
    head = np.array(
        [(n, len(e[0]), len(e[1]), e[3]) for n, e in zip(lcp.tolist(), entries, strict=True)], np.uint8
    ).tobytes()
    numbers = np.array([e[2] for e in entries], np.uint32).tobytes()
    body = b"".join(x[n:] for n, x in zip(lcp.tolist(), suffixes, strict=True)) + b"".join(e[1] for e in entries)
    return zstandard.ZstdCompressor(level=3).compress(len(entries).to_bytes(4, "little") + head + numbers + body)


class Run:
    """A decoded run: ``lcp`` and numbers as arrays; suffixes are rebuilt as the merge asks for them."""

    def __init__(self, blob: bytes):
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(data[:4], "little")
        head = np.frombuffer(data, np.uint8, 4 * n, 4).reshape(n, 4).astype(np.int64)
        self.lcp, self.size, back, self.copies = (head[:, i] for i in range(4))
        self.number = np.frombuffer(data, np.uint32, n, 4 + 4 * n).astype(np.int64)
        ends = np.cumsum(self.size - self.lcp) + 4 + 8 * n
        self._tails = zip(self.lcp.tolist(), (ends - self.size + self.lcp).tolist(), ends.tolist(), strict=True)
        stops = np.cumsum(back) + (ends[-1] if n else 0)
        self.backs = [data[s:e] for s, e in zip((stops - back).tolist(), stops.tolist(), strict=True)]
        self._data, self._now = data, b""

    def next(self) -> tuple[bytes | None, int]:
        """The next suffix and its common prefix with the one before; (None, -1) at the end."""
        for lcp, s, e in self._tails:
            self._now = self._now[:lcp] + self._data[s:e]
            return self._now, lcp
        return None, -1


def differ_at(x: bytes, y: bytes, known: int) -> int:
    """First place from ``known`` on where x and y differ, or the length of the shorter."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    bits = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length()
    return n - (bits + 7) // 8


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """Merge sorted runs with a loser tree; yield the run and the common prefix with the suffix before.

    ``known[i]`` is the common prefix of run i's current suffix with the winner that last beat it on
    its path. The greater known prefix is the smaller suffix; only at equal values are bytes
    compared, and only from that place on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    now: list[bytes | None] = [None] * k
    known = [-1] * k
    for i, r in enumerate(runs):
        now[i], n = r.next()
        known[i] = 0 if n >= 0 else -1

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows its common prefix with the winner."""
        a, b = known[i], known[j]
        if a > b:
            return i, j
        if b > a:
            return j, i
        if a < 0:
            return i, j
        x, y = now[i], now[j]
        d = differ_at(x, y, a)
        if x[d : d + 1] <= y[d : d + 1]:
            known[j] = d
            return i, j
        known[i] = d
        return j, i

    losers = [0] * k
    level = list(range(k))
    width = k
    while width > 1:
        width //= 2
        up = []
        for m in range(width):
            w, losers[width + m] = play(level[2 * m], level[2 * m + 1])
            up.append(w)
        level = up
    w = level[0]
    while known[w] >= 0:
        yield w, known[w]
        now[w], known[w] = runs[w].next()
        node = (k + w) >> 1
        while node:
            w, losers[node] = play(w, losers[node])
            node >>= 1


def repeated_offsets(runs: list[Run], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run: numbers of its suffixes with a repeated window, least and greatest offset of one."""
    order = list(merge_runs(runs))
    total = len(order)
    of_run = np.fromiter((w for w, _ in order), np.int64, total)
    lcp = np.fromiter((n for _, n in order), np.int64, total)
    within = np.zeros(total, np.int64)
    for i in range(len(runs)):
        mine = np.flatnonzero(of_run == i)
        within[mine] = np.arange(len(mine))
    pairs = list(zip(of_run.tolist(), within.tolist(), strict=True))
    backs = [runs[i].backs[j][::-1] for i, j in pairs]
    size, copies, number = (
        np.fromiter((getattr(runs[i], x)[j] for i, j in pairs), np.int64, total) for x in ("size", "copies", "number")
    )
    least, most = length - size, np.fromiter(map(len, backs), np.int64, total)
    by_back = sorted(range(total), key=backs.__getitem__)
    back_lcp = common_prefixes([backs[i] for i in by_back], length)
    by_back = np.array(by_back, np.int64)
    back_class = np.zeros(total, np.int64)
    low, high = np.full(total, length), np.full(total, -1)
    for d in range(length - GRAM + 1):
        at = np.flatnonzero((least <= d) & (most >= d))
        if not len(at):
            continue
        back_class[by_back] = np.cumsum(back_lcp < d)
        ahead = np.cumsum(lcp < length - d)
        _, inverse = np.unique(ahead[at] * (total + 1) + back_class[at], return_inverse=True)
        again = at[np.bincount(inverse, copies[at])[inverse] > 1]
        low[again] = np.minimum(low[again], d)
        high[again] = d
    out = []
    for i in range(len(runs)):
        mine = np.flatnonzero((of_run == i) & (high >= 0))
        out.append((number[mine], low[mine], high[mine]))
    return out


# --- the operator -----------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, th, z``: the key of a row (its id and text hash) and its text, compressed for the shuffles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z], ["doc_id", "th", "z"])

    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, th bigint, z binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text)


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """``h, doc_id, th, packed, prefix``: every anchor; the prefix of one gram in SAMPLE_EVERY, for splitters."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 1024):
                part = batch.slice(s, 1024)
                hs, packs, owner, prefix = [], [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    b = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                    h, a, least, most = anchors(b, length)
                    hs.append(h)
                    packs.append((a << 16) | (least << 8) | most)
                    owner.append(np.full(len(h), i))
                    prefix += [
                        b[x : x + SPLIT_BYTES].tobytes() if not k else None
                        for k, x in zip((h & np.uint64(SAMPLE_EVERY - 1)).tolist(), a.tolist(), strict=True)
                    ]
                at = pa.array(np.concatenate(owner))
                cols = [
                    pa.array(np.concatenate(hs).view(np.int64)),
                    part.column(0).take(at),
                    part.column(1).take(at),
                    pa.array(np.concatenate(packs)),
                    pa.array(prefix, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["h", "doc_id", "th", "packed", "prefix"])

    return _keyed(docs).mapInArrow(run, f"h bigint, doc_id {kind}, th bigint, packed bigint, prefix binary")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row of ``docs(doc_id, text)``.

    ``spans`` lists the maximal runs (start, end) of bytes covered by a string of ``length`` bytes that
    starts at two or more places of the input (same document included, overlaps count); ``kept`` is
    what remains, as bytes, for a cut may fall inside a character. Null text is empty; a text shorter than
    ``length`` is kept whole; repeated rows are separate documents, so both lose what they share.
    Other columns are ignored. An empty table gives an empty result. ``length`` is 65 to 255.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _anchor_rows(docs, length)
    counted = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("prefix").alias("prefix"))
    repeated = written(counted.where("c > 1"), "grams")
    flagged = repeated.agg(F.sum("c")).first()[0] or 0
    n_ranges = max(shuffle_partitions(spark), -(-flagged // RANGE_SUFFIXES))
    hot = max(LEAST_HOT, flagged // (FAIR_PARTS * n_ranges))
    # A few short strings a task: the driver keeps no more of the data than of its own task list.
    sample = repeated.where("prefix is not null").orderBy("h").limit(SAMPLE_A_RANGE * n_ranges).select("prefix").collect()
    sample = sorted({bytes(r[0]) for r in sample})
    splitters = np.array(
        sorted({sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)} if sample else []), object
    )

    found = rows.select("h", "doc_id", "th", "packed").join(
        repeated.select("h", (F.col("c") > hot).cast("bigint").alias("hot")), "h"
    )
    marked = found.groupBy("doc_id", "th").agg(
        F.collect_set(F.shiftleft("packed", 1).bitwiseOR(F.col("hot"))).alias("marks")
    )
    texts = _texts(docs)
    some = _same_key(texts, written(marked, "anchors"), "inner").select("doc_id", "th", "z", "marks")
    runs = written(some.mapInArrow(lambda it: _build_runs(it, splitters, length), _RUN_ROWS.format(kind=kind)), "runs")

    blobs = runs.where("kind = 0").select("pid", "run", "blob")
    dealt = blobs.repartitionByRange(n_ranges, "pid").sortWithinPartitions("pid", "run")
    offsets = dealt.mapInArrow(lambda it: _merge_ranges(it, length), "run bigint, number bigint, low int, high int")
    windows = runs.where("kind = 2").select("run", "number", "low", "copies", "blob")
    twice = windows.groupBy("blob").agg(F.sum("copies").alias("n")).where("n > 1").select("blob")
    hot_offsets = windows.join(twice, "blob").groupBy("run", "number").agg(
        F.min("low").alias("low"), F.max("low").alias("high")
    )
    members = runs.where("kind = 1").select("run", "number", "doc_id", "th", "at")
    covered = members.join(offsets.unionByName(hot_offsets), ["run", "number"]).select(
        "doc_id", "th", F.struct((F.col("at") - F.col("high")).alias("s"), (F.col("at") - F.col("low") + length).alias("e")).alias("x")
    )
    spans = written(covered.groupBy("doc_id", "th").agg(F.collect_set("x").alias("marks")), "spans")
    cut = _same_key(texts, spans, "left").select(
        "doc_id", "z", F.col("marks.s").alias("s"), F.col("marks.e").alias("e")
    )
    return cut.mapInArrow(
        _cut, f"doc_id {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    )


def _same_key(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    other = marks.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "marks")
    return texts.join(other, texts.doc_id.eqNullSafe(other._id) & (texts.th == other._th), how)


_RUN_ROWS = (
    "kind int, run bigint, number bigint, pid int, doc_id {kind}, th bigint, at bigint, low int, copies bigint, blob binary"
)


def _build_runs(
    batches: Iterator[pa.RecordBatch], splitters: np.ndarray, length: int
) -> Iterator[pa.RecordBatch]:
    """Runs of a task's marked suffixes. Kinds of rows: 0 a front-coded piece of a run for one key range;
    1 a suffix's document and place; 2 a window of a very frequent gram, by its digest."""
    unpack = zstandard.ZstdDecompressor().decompress
    task = TaskContext.get().partitionId() << 32
    names = [x.split()[0] for x in _RUN_ROWS.split(", ")]
    n_run = 0
    numbers: dict[tuple[bytes, bytes, int], int] = {}
    copies: list[int] = []
    members: tuple[list, list, list, list] = ([], [], [], [])
    like: pa.DataType | None = None

    def rows(kind: int, n: int, **cols) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), like, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        fixed = {"kind": [kind] * n, "run": [task + n_run] * n}
        out = [pa.array((fixed | cols).get(c, [None] * n), t) for c, t in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays(out, names)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal n_run, members
        entries = sorted((f, b, i, min(2, copies[i])) for (f, b, hot), i in numbers.items() if not hot)
        grams = np.array([e[0][:SPLIT_BYTES] for e in entries], object)
        pid = np.searchsorted(splitters, grams, side="right") if len(splitters) else np.zeros(len(entries), int)
        cut = np.flatnonzero(np.append(True, pid[1:] != pid[:-1])).tolist() if entries else []
        for s, e in zip(cut, [*cut[1:], len(entries)]):
            yield rows(0, 1, pid=[int(pid[s])], blob=[encode_run(entries[s:e])])
        hot = [(f, b, i) for (f, b, hot), i in numbers.items() if hot]
        for s in range(0, len(hot), 256):
            part = [
                (i, d, hashlib.blake2b(w[len(b) - d : len(b) - d + length], digest_size=16).digest())
                for f, b, i in hot[s : s + 256]
                for w in [b + f]
                for d in range(length - len(f), len(b) + 1)
            ]
            n, d, digest = zip(*part, strict=True)
            yield rows(2, len(part), number=n, low=d, copies=[min(2, copies[i]) for i in n], blob=digest)
        yield rows(1, len(members[0]), number=members[0], doc_id=members[1], th=members[2], at=members[3])
        numbers.clear()
        copies.clear()
        members = ([], [], [], [])
        n_run += 1

    for batch in batches:
        like = batch.column(0).type
        for doc_id, th, z, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(z)
            for m in marks:
                a, least, most, hot = m >> 17, (m >> 9) & 255, (m >> 1) & 255, m & 1
                key = (text[a : a - least + length], text[a - most : a], hot)
                i = numbers.setdefault(key, len(numbers))
                if i == len(copies):
                    copies.append(0)
                copies[i] += 1
                for to, x in zip(members, (i, doc_id, th, a), strict=True):
                    to.append(x)
            if len(numbers) >= RUN_SUFFIXES or len(members[0]) >= 8 * RUN_SUFFIXES:
                yield from close()
    if members[0]:
        yield from close()


def _merge_ranges(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    pid, ids, runs = None, [], []

    def done() -> pa.RecordBatch:
        parts = repeated_offsets(runs, length)
        out = [np.repeat(ids, [len(p[0]) for p in parts]), *(np.concatenate(x) for x in zip(*parts, strict=True))]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(out, types, strict=True)], ["run", "number", "low", "high"]
        )

    for batch in batches:
        for p, run, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != pid and runs:
                yield done()
                ids, runs = [], []
            pid = p
            ids.append(run)
            runs.append(Run(blob))
    if runs:
        yield done()


def merge_spans(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.slice(i, 512)
            sizes, spans, kept = [], [], []
            for z, s, e in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                text = unpack(z)
                gone = merge_spans(s or [], e or [])
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in gone])
                edges = [0, *(x for p in gone for x in p), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            cols = [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "spans", "kept"])

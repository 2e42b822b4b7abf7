"""I-Match fingerprints over randomised lexicons.

The lexicon is every term whose document frequency lies in a band (inverse document frequency neither
too low nor too high). Random subsets of it are drawn by hashing the term, at rates 1, 1/2, 1/4, ...; a
document uses the rates at which a subset holds a term or two of it, so that long and short documents
alike survive an edit in part of their subsets. For each of ``SUBSETS`` subsets at two rates, the
document's distinct terms in the subset are sorted and hashed. The likeness of two fingerprints is the
share of equal hashes among the subsets that are not empty in both.

Where many near copies of a text are in the corpus, what they share lies above the band. So a text less than half of
whose terms lie in it takes its rarest terms above it, too, until half are covered.

The edited text needs the next document by doc_id: texts are dealt out by doc_id ranges once, in
compressed form, and the first text of each range is handed to the range before.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrun.llm.common import fits_broadcast, shuffle_partitions, written

SUBSETS = 8
#: The band: terms in at least so many documents and at most this share of them.
MIN_DOCUMENTS = 2
MAX_SHARE = 0.02
#: Share of a text's terms (of those in MIN_DOCUMENTS or more) that its lexicon must cover, with terms above the band if need be.
COVER = 0.5
#: Distinct terms that a task counts or remembers at a time.
TERMS_A_TASK = 200_000
_MIX = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(SUBSETS)]
#: Marks a fingerprint of a text without a term in any subset: the hash of the whole text.
WHOLE = 255


class TermHashes(dict):
    """64-bit hash of a term, remembered."""

    def __missing__(self, term: str) -> int:
        h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))
        if len(self) >= TERMS_A_TASK:
            self.clear()
        self[term] = h
        return h


def terms_of(text: str) -> set[str]:
    """Distinct lower-cased terms between white space."""
    return set(text.lower().split())


def subset_hashes(h: np.ndarray) -> np.ndarray:
    """For each subset (row), a hash of each term; the term is in the subset at rate 2^-j if its first j bits are zero."""
    g = np.empty((SUBSETS, len(h)), np.uint64)
    for i, c in enumerate(_MIX):
        x = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        g[i] = x * np.uint64(0xD6E8FEB86659FD93)
    return g


def rate_of(n_terms: int) -> int:
    """j such that a subset at rate 2^-j holds one or two of n terms; the finer rate is j, the coarser j - 1."""
    return max(1, n_terms.bit_length() - 1)


def select(h: np.ndarray, j: int) -> np.ndarray:
    """Terms in any subset at rate 2^-(j-1)."""
    return h[(subset_hashes(h) < np.uint64(1 << (65 - j) if j > 1 else 0xFFFFFFFFFFFFFFFF)).any(axis=0)]


def in_lexicon(df: np.ndarray, most: int) -> np.ndarray:
    """Which of a text's terms are used, by their document frequencies: those in the band, and the rarest (all of equal frequency) to COVER."""
    if not len(df):
        return np.zeros(0, bool)
    need = int(np.ceil(COVER * len(df)))
    return df <= max(most, np.partition(df, need - 1)[need - 1])


def fingerprint_of(h: np.ndarray, j: int, whole: bytes) -> bytes:
    """Rate and 32-bit hashes of the subsets at the coarser and finer rate (0: empty) of a text's lexicon terms."""
    out = np.zeros(2 * SUBSETS, "<u4")
    if len(h):
        h = np.sort(h)
        g = subset_hashes(h)
        for half, rate in enumerate((j - 1, j)):
            inside = g >> np.uint64(64 - rate) == 0 if rate else np.ones(g.shape, bool)
            for k in np.flatnonzero(inside.any(axis=1)):
                value = hashlib.blake2b(h[inside[k]].tobytes(), digest_size=4).digest()
                out[half * SUBSETS + k] = int.from_bytes(value, "little") or 1
    if not out.any():
        return bytes([WHOLE]) + whole[:16]
    return bytes([j]) + out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal hashes among subsets at common rates that are not empty in both; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if WHOLE in (a[0], b[0]) or abs(a[0] - b[0]) > 1:
        return 0.0
    if a[0] > b[0]:
        a, b = b, a
    x, y = np.frombuffer(a[1:], "<u4"), np.frombuffer(b[1:], "<u4")
    if b[0] > a[0]:
        x, y = x[SUBSETS:], y[:SUBSETS]
    some = int(((x != 0) | (y != 0)).sum())
    return float(((x == y) & (x != 0)).sum() / some) if some else 0.0


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``h, df``: hash of each term and the number of documents that have it, counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            h = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in seen]
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["h", "n"]
            )
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(terms_of(text or ""))
                if len(seen) > TERMS_A_TASK:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("df"))


_ROW = "uid bigint, next_uid bigint, doc_id {kind}, n_chars bigint, whole binary, edited binary, j int, edited_j int, terms array<bigint>, sides array<tinyint>"


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class _Describe:
    """Rows of ``_ROW``: what the fingerprints of a text and its edited text are made from."""

    def __init__(self):
        self.hash = TermHashes()

    def side(self, text: str) -> tuple[np.ndarray, int]:
        h = np.fromiter(map(self.hash.__getitem__, terms_of(text)), np.uint64)
        j = rate_of(len(h))
        return select(h, j), j

    def __call__(self, uid: int, next_uid: int, doc_id, text: str, following: str) -> dict:
        edited = _edited(text, following)
        (a, j), (b, edited_j) = self.side(text), self.side(edited)
        terms = np.union1d(a, b)
        sides = np.isin(terms, a) + 2 * np.isin(terms, b)
        return {
            "uid": uid,
            "next_uid": next_uid,
            "doc_id": doc_id,
            "n_chars": len(text),
            "whole": hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(),
            "edited": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest(),
            "j": j,
            "edited_j": edited_j,
            "terms": terms.view(np.int64),
            "sides": sides.astype(np.int8),
        }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)
    rows.clear()
    return out


def _describe_rows(docs: DataFrame) -> DataFrame:
    """``_ROW`` of every document but the last of each doc_id range, whose text is handed on in ``z`` with its range's first."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=6).compress
        for b in batches:
            z = [deflate((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["doc_id", "th", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        pid = TaskContext.get().partitionId()
        uid = pid << 33
        describe, rows, before, schema = _Describe(), [], None, None
        for b in batches:
            if schema is None:
                schema = pa.schema(_FIELDS(b.schema.field(0).type))
            for doc_id, z in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = inflate(z).decode("utf-8", "surrogatepass")
                if before is None:
                    rows.append({"pid": pid, "place": 1, "uid": uid, "z": z})
                else:
                    rows.append({"pid": pid, "place": 0} | describe(uid - 1, uid, before[0], before[1], text))
                before = (doc_id, text, z)
                uid += 1
                if len(rows) >= 512:
                    yield _batch(rows, schema)
        if before is not None:
            rows.append({"pid": pid, "place": 2, "uid": uid - 1, "doc_id": before[0], "z": before[2]})
            yield _batch(rows, schema)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    z = keyed.mapInArrow(pack, f"doc_id {kind}, th bigint, z binary")
    dealt = z.repartitionByRange(shuffle_partitions(spark), "doc_id", "th").sortWithinPartitions("doc_id", "th")
    return dealt.mapInArrow(run, "pid int, place int, z binary, " + _ROW.format(kind=kind))


def _FIELDS(kind: pa.DataType) -> list[tuple[str, pa.DataType]]:
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "tinyint": pa.int8(), "{kind}": kind}
    types |= {"array<bigint>": pa.list_(pa.int64()), "array<tinyint>": pa.list_(pa.int8())}
    head = [("pid", pa.int32()), ("place", pa.int32()), ("z", pa.binary())]
    return head + [(n, types[t]) for n, t in (x.split() for x in _ROW.split(", "))]


def imatch(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text is the text with its last quarter (code points, rounded down) replaced by as many
    of the first of the next document's, or all it has; next by doc_id, then text hash; after the last comes the first. Null text
    counts as empty; null doc_ids come first; repeated rows are documents of their own (copies follow each other). Equal texts have equal fingerprints; a text
    with no lexicon term in its subsets is fingerprinted by its whole text. An only document is its own next. Other
    columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = written(_describe_rows(docs), "terms")
    names = [x.split()[0] for x in _ROW.split(", ")]

    # The last of each range with the first of the next: a row for each task.
    heads = described.where("place = 1").select("pid", F.col("uid").alias("next_uid"), F.col("z").alias("next_z"))
    order = Window.orderBy("pid")
    ranges = heads.select("pid").withColumn("to", F.lead("pid").over(order))
    first = heads.agg(F.min("pid")).first()[0]
    ranges = ranges.select("pid", F.coalesce("to", F.lit(first)).alias("to"))
    tails = described.where("place = 2").select("pid", "uid", "doc_id", "z").join(ranges, "pid")
    pairs = tails.join(heads.withColumnRenamed("pid", "to"), "to").select("uid", "next_uid", "doc_id", "z", "next_z")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        describe = _Describe()
        for b in batches:
            schema = pa.schema(_FIELDS(b.schema.field(2).type)[3:])
            for uid, next_uid, doc_id, z, next_z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                texts = [inflate(x).decode("utf-8", "surrogatepass") for x in (z, next_z)]
                yield _batch([describe(uid, next_uid, doc_id, *texts)], schema)

    rows = described.where("place = 0").select(*names)
    rows = written(rows.unionByName(pairs.mapInArrow(finish, _ROW.format(kind=kind))), "described")

    n = docs.count()
    most = max(min_documents, int(max_share * n))
    known = written(document_frequencies(docs).where(F.col("df") >= min_documents), "frequencies")
    band, frequent = known.where(F.col("df") <= most), known.where(F.col("df") > most)
    found = rows.select(F.inline(F.arrays_zip(F.col("terms").alias("h"), F.col("sides").alias("side"))), "uid")
    found = found.select("h", (F.shiftleft("uid", 2).bitwiseOR(F.col("side").cast("bigint"))).alias("u"))
    if fits_broadcast(frequent):
        # At most 1 / max_share times the mean number of terms: these meet in place, and no frequent term is one task's key.
        met = found.join(F.broadcast(frequent), "h")
        others = found.join(F.broadcast(frequent.select("h")), "h", "left_anti")
        met = met.unionByName(others.join(band, "h"))
    else:
        met = found.join(known, "h")
    inside = met.groupBy(F.shiftright("u", 2).alias("_uid")).agg(
        F.collect_list(F.struct(F.col("h"), (F.col("u") % 4).cast("tinyint").alias("side"), F.col("df"))).alias("lexicon")
    )
    info = rows.drop("terms", "sides")
    full = info.join(inside, info.uid == inside._uid, "left").select(*info.columns, "lexicon.h", "lexicon.side", "lexicon.df")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)}
            a, e = [], []
            for whole, edited, j, ej, h, side, df in zip(
                *(at[c] for c in ("whole", "edited", "j", "edited_j", "h", "side", "df")), strict=True
            ):
                h = np.array(h or [], np.int64).view(np.uint64)
                side, df = np.array(side or [], np.int8), np.array(df or [], np.int64)
                for out, bit, rate, digest in ((a, 1, j, whole), (e, 2, ej, edited)):
                    mine = side & bit > 0
                    out.append(fingerprint_of(h[mine][in_lexicon(df[mine], most)], rate, digest))
            cols = [b.column(c) for c in ("uid", "next_uid", "doc_id", "n_chars", "edited")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(a, pa.binary()), pa.array(e, pa.binary())],
                ["uid", "next_uid", "doc_id", "n_chars", "edited", "f", "ef"],
            )

    schema = f"uid bigint, next_uid bigint, doc_id {kind}, n_chars bigint, edited binary, f binary, ef binary"
    made = written(full.mapInArrow(make, schema), "fingerprints")
    after = made.select(F.col("uid").alias("_to"), F.col("f").alias("next_f"))
    both = made.join(after, made.next_uid == after._to).select("doc_id", "n_chars", "edited", "f", "ef", "next_f")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edited, f, ef, nf = (b.column(c).to_pylist() for c in ("edited", "f", "ef", "next_f"))
            out = [b.column(0), b.column(1)]
            out += [pa.array([x.hex() for x in v], pa.string()) for v in (edited, f, ef)]
            out += [pa.array([likeness(x, y) for x, y in zip(f, v, strict=True)], pa.float64()) for v in (ef, nf)]
            yield pa.RecordBatch.from_arrays(out, _NAMES)

    return both.mapInArrow(
        compare,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

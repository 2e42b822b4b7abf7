"""Fill-in-middle: blocks of a text exchanged in place, and put back.

A text's bytes go into a bytearray with one scan for the line ends, where the cuts lie. The sentinels are inserted where the
blocks begin in the order of the text, ``<P>`` prefix ``<M>`` middle ``<S>`` suffix, and neighbouring blocks change
places by three reversals (each block, then both together): a rotation that needs no second buffer. To restore,
the blocks are found by their sentinels, the inverse rotation runs in the same way, and the sentinels are taken out.

Everything is map-only and a row at a time: memory is a small multiple of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Texts a hundred that are transformed, and transformed texts a hundred that put the suffix first.
RATE = 100
SUFFIX_FIRST = 50
SEED = "7"
#: Bytes of texts that one batch to or from Python may hold before it is sent on (a longer text goes alone).
BATCH_BYTES = 16 << 20


def reverse(block: np.ndarray) -> None:
    """Reverse the bytes of a view in place, by swaps from both ends."""
    half = len(block) // 2
    if half:
        left, right = block[:half], block[len(block) - half :][::-1]
        kept = left.copy()
        left[:] = right
        right[:] = kept


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange ``buffer[start:cut]`` and ``buffer[cut:end]`` in place."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view[start:cut])
    reverse(view[cut:end])
    reverse(view[start:end])


def line_ends(text: bytes) -> np.ndarray:
    """Offsets where a prefix of whole lines may end: 0, after each ``\\n``, and the end of the text."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    tail = [len(text)] if len(text) and (not len(ends) or ends[-1] != len(text)) else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


def numbers(key: str, seed: str = SEED) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(text: bytes, key: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> tuple[str, bytes, int, int, int]:
    """``(form, output, lines, first cut, second cut)``; the cuts are byte offsets of the text (0 if plain)."""
    ends = line_ends(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = numbers(key, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return "plain", text, n, 0, 0
    a, b = (int(ends[i]) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    buffer = bytearray(text)
    for at, sentinel in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = a + 3, b + 6
    if h4 % 100 < suffix_first:
        rotate(buffer, 0, suffix, len(buffer))
        return "spm", bytes(buffer), n, a, b
    rotate(buffer, middle, suffix, len(buffer))
    return "psm", bytes(buffer), n, a, b


def restore(output: bytes, form: str) -> bytes:
    """The text again, from the output and its form alone. No sentinel can begin in one block and end in the next."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    middle = output.index(MIDDLE)
    if form == "spm":
        prefix = output.index(PREFIX)
        rotate(buffer, 0, prefix, len(buffer))
        suffix, middle = len(buffer) - prefix, middle - prefix
    else:
        suffix = output.index(SUFFIX)
        rotate(buffer, suffix, middle, len(buffer))
        suffix, middle = suffix + len(buffer) - middle, suffix
    for at in (suffix, middle, 0):
        del buffer[at : at + 3]
    return bytes(buffer)


def code_points(text: bytes) -> int:
    """Code points of UTF-8 bytes: those that don't continue another."""
    return len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, restored`` (UTF-8 bytes) of every row of ``docs(doc_id, text)``.

    ``restored`` is rebuilt from ``output`` and ``form``. A null text counts as empty; an empty text, one that holds a
    sentinel and the share beyond ``rate`` stay plain, with null block lengths. A null doc_id is hashed as an empty
    string. Equal rows give equal rows, a table without rows none; other columns are ignored. Bytes that are no UTF-8 are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, keys, out, held = batch.column(0), batch.column(1), [], 0
            start = 0
            for i, text in enumerate(batch.column(2)):
                raw = text.as_py() or b""
                form, output, n, a, b = transform(raw, keys[i].as_py(), rate, suffix_first, seed)
                counts = (None, None) if form == "plain" else (code_points(raw[:a]), code_points(raw[a:b]))
                out.append((n, form, *counts, output, restore(output, form)))
                held += len(output)
                if held > BATCH_BYTES:
                    yield record(ids.slice(start, i + 1 - start), kind, out)
                    start, out, held = i + 1, [], 0
            if out:
                yield record(ids.slice(start), kind, out)

    def record(ids: pa.Array, kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([ids.cast(kind), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
        F.col("text").cast("binary").alias("text"),
    )
    columns = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary, restored binary"
    return rows.mapInArrow(run, f"doc_id {kind}, {columns}")

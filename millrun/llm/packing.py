"""Packing token sequences into fixed windows by the sum-of-squares rule (online).

Every task packs the documents of its partition as they come. Per fill level it keeps the open windows
of that level; a piece of s tokens goes where the sum over levels of (open windows)^2 grows least:
moving a window from level h to h + s changes it by 2 (N[h+s] - N[h]) + 2, a new window or a window
that becomes full by a little less. The rule keeps all levels thinly populated, so whatever comes next
finds a window it fills exactly. Documents longer than a window are cut into full windows and a rest.
At the end of the task the documents in windows still open are packed again, now with cuts, so that
at most one window a task is not full.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 1024
END_ID = 0


class SumOfSquares:
    """Open windows by fill level, and the rule that chooses among them."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.n = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def choose(self, size: int) -> int:
        """Level of the open window to use for a piece of ``size`` < window tokens; 0: a new one. Ties: the fullest."""
        top = self.window - size
        growth = 2 * (self.n[size:] - self.n[: top + 1]) + 2
        growth[0] -= 1
        growth[top] -= 1
        usable = np.append(0, 1 + np.flatnonzero(self.n[1 : top + 1]))
        best = growth[usable]
        return int(usable[len(best) - 1 - best[::-1].argmin()])

    def place(self, piece: tuple, size: int) -> list | None:
        """Put the piece into a window; return the window's pieces if it is now full."""
        level = self.choose(size)
        window = self.open[level].pop() if level else []
        window.append(piece)
        if level:
            self.n[level] -= 1
        if level + size == self.window:
            return window
        self.n[level + size] += 1
        self.open[level + size].append(window)
        return None

    def rest(self) -> list[tuple]:
        return [p for level in self.open for window in level for p in window]


class Encoder:
    """Ids of a text by the rank file at ``path``; one string is a special token."""

    def __init__(self, path: str, pattern: str, special: dict[str, int], fallback: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._core = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._fallback = fallback

    def __call__(self, text: str) -> list[int]:
        try:
            return self._core.encode(text, allowed_special="all")
        except ValueError:  # the pattern engine gives up on a million blanks in a row; this one does not
            from tokenizers import Tokenizer

            return Tokenizer.from_file(self._fallback).encode(text, add_special_tokens=False).ids


def pack(docs: DataFrame, vocabulary: dict, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``docs(doc_id, text)``; a document is the ids of its text (null: empty) and then id 0, so the empty
    text is one token. ``start`` counts the document's ids before the piece, ``offset`` those before it in
    its sequence; ``ids`` is binary, little-endian unsigned 32 bits each. Sequence ids are unique; the
    ids of one task follow each other. Repeated rows are packed as documents of their own, null
    doc_ids are kept, other columns are ignored, an empty table gives an empty result.
    ``vocabulary``: the arguments of ``Encoder``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(**vocabulary)
        packer = SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        like = pa.null()

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            types = [like, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            like = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for s in range(0, len(ids), window):
                    piece = (doc, s, ids[s : s + window], len(ids))
                    full = [piece] if len(piece[2]) == window else packer.place(piece, len(piece[2]))
                    if full:
                        close(full)
                if len(rows) >= 4096:
                    yield flush()
        filled, pieces = 0, []
        for doc, start, ids, total in packer.rest():
            while len(ids):
                part = ids[: window - filled]
                pieces.append((doc, start, part, total))
                start, ids, filled = start + len(part), ids[len(part) :], filled + len(part)
                if filled == window:
                    close(pieces)
                    filled, pieces = 0, []
        if pieces:
            close(pieces)
        if rows:
            yield flush()

    schema = (
        f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def byte_bpe_50k() -> dict:
    """The public byte-level vocabulary of 50,257 ids; where the tokenizer files are is their package's matter."""
    import public_tokenizers as p

    return {
        "path": p.path("byte_bpe_50k.tiktoken"),
        "pattern": p.PATTERN,
        "special": {"<|endoftext|>": 50256},
        "fallback": p.path("byte_bpe_50k.json"),
    }

"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words, and only the document has a label. A passage is encoded from the mean of its
words' hashed vectors and a few shares (repeated words, upper case, digits, symbols); gated attention
``w . (tanh(V h) * sigmoid(U h))``, a softmax over the document's passages, weighs the encodings; and a
linear unit scores the weighted sum. Vectors, encoder, attention and unit are fitted together in numpy on the documents' labels.

Training runs over a bounded sample (``TRAIN_DOCUMENTS`` documents, ``TRAIN_PASSAGES`` of each); scoring reads every word of every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.llm.toxicity import platt

BUCKETS = 1 << 15
DIMENSION = 12
HIDDEN = 16
GATES = 8
PASSAGE = 48
#: Labelled documents that train the model, half of each label if there are as many; passages of each.
TRAIN_DOCUMENTS = 6000
TRAIN_PASSAGES = 24
EPOCHS = 8
BATCH = 64
RATE = 0.01
THRESHOLD = 0.7
#: Words remembered by a task at a time; bytes of text that a task encodes at a time (a longer text alone).
WORDS_A_TASK = 300_000
TEXT_BYTES = 2 << 20
#: Shares of a passage: distinct words, words equal to their predecessor, filling, and four means over its words.
SHARES = 7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Words(dict):
    """A number for each word met, with the word's bucket and four features; forgets all when full (``fresh``)."""

    def __init__(self):
        super().__init__()
        self.buckets = np.zeros(1024, np.uint16)
        self.features = np.zeros((1024, 4), np.float32)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        if i == len(self.buckets):
            self.buckets = np.concatenate([self.buckets, np.zeros_like(self.buckets)])
            self.features = np.concatenate([self.features, np.zeros_like(self.features)])
        n = len(word)
        self.buckets[i] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        letters, digits = sum(map(str.isalpha, word)), sum(map(str.isdigit, word))
        self.features[i] = min(n, 24) / 12, sum(map(str.isupper, word)) / n, digits / n, (n - letters - digits) / n
        return i

    def fresh(self) -> None:
        if len(self) > WORDS_A_TASK:
            self.clear()


class Bags:
    """Documents as passages: words' buckets, words of each passage, passages of each document, and shares of each passage.

    A text without words has one passage without words, whose shares are 0.
    """

    def __init__(self, texts: list[str], words: Words):
        words.fresh()
        split = [t.split() for t in texts]
        n_words = np.array([len(s) for s in split])
        ids = np.fromiter((words[w] for s in split for w in s), np.int32, int(n_words.sum()))
        self.passages = np.maximum(1, -(-n_words // PASSAGE))
        self.sizes = np.full(int(self.passages.sum()), PASSAGE)
        self.sizes[np.cumsum(self.passages) - 1] = n_words - (self.passages - 1) * PASSAGE
        self.buckets = words.buckets[ids]
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        column = np.arange(len(ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        grid = np.full((len(self.sizes), PASSAGE), -1, np.int32)
        grid[owner, column] = ids
        repeats = (grid[:, 1:] == grid[:, :-1]) & (grid[:, 1:] >= 0)
        grid.sort(axis=1)
        distinct = ((grid[:, 1:] != grid[:, :-1]) & (grid[:, 1:] >= 0)).sum(axis=1) + (grid[:, 0] >= 0)
        n = np.maximum(self.sizes, 1)
        means = [np.bincount(owner, words.features[ids, f], len(n)) / n for f in range(4)]
        self.shares = np.stack([distinct / n, repeats.sum(axis=1) / n, self.sizes / PASSAGE, *means], axis=1).astype(np.float32)


def in_parts(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about TEXT_BYTES characters (null as empty)."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= TEXT_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def training_bags(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple], float]:
    """``doc_id, quality, buckets, sizes, shares`` of the sample (labelled documents of least hash among those not held out, one
    row for each), and the share of label 1 among all that are not held out."""
    seen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seen = seen.where(~held_out(F.col("doc_id")))
    half = TRAIN_DOCUMENTS // 2
    by_hash = F.xxhash64("doc_id")
    parts = [seen.where(F.col("quality") == q).orderBy(by_hash, "doc_id").limit(half) for q in (1, 0)]
    sample = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                bag = Bags([text or ""], words)
                chosen = np.arange(len(bag.sizes))
                if len(chosen) > TRAIN_PASSAGES:
                    seed = zlib.crc32(text[:64].encode("utf-8", "surrogatepass")) + len(text)
                    chosen = np.sort(np.random.default_rng(seed).choice(chosen, TRAIN_PASSAGES, False))
                starts = np.cumsum(bag.sizes) - bag.sizes
                buckets = [bag.buckets[starts[i] : starts[i] + bag.sizes[i]] for i in chosen]
                out.append((np.concatenate(buckets).tobytes(), bag.sizes[chosen].astype(np.uint16).tobytes(), bag.shares[chosen].tobytes()))
            cols = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "quality", "buckets", "sizes", "shares"])

    # TRAIN_DOCUMENTS rows of two numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = found.select("doc_id", "quality", "text").mapInArrow(run, f"doc_id {kind}, quality int, buckets binary, sizes binary, shares binary")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "buckets", "sizes", "shares")).alias("row")).select("doc_id", "row.*")
    share = seen.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    got = [(r[0], r[1], np.frombuffer(r[2], np.uint16), np.frombuffer(r[3], np.uint16).astype(np.int64), np.frombuffer(r[4], np.float32).reshape(-1, SHARES)) for r in one.collect()]
    return sorted(got, key=lambda r: str(r[0])), share or 0.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of ``values`` for each owner 0..n-1 (0 for one without rows)."""
    return np.stack([np.bincount(owner, values[:, d], n) for d in range(values.shape[1])], axis=1)


class Model:
    """Word vectors, passage encoder, gated attention and scoring unit."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        width = DIMENSION + SHARES
        self.p = {
            "words": rng.normal(0, 0.1, (BUCKETS, DIMENSION)),
            "encode": rng.normal(0, width**-0.5, (width, HIDDEN)),
            "encode_0": np.zeros(HIDDEN),
            "gate_v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)),
            "gate_u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)),
            "gate_w": rng.normal(0, GATES**-0.5, GATES),
            "unit": rng.normal(0, HIDDEN**-0.5, HIDDEN),
            "unit_0": np.zeros(1),
        }
        self.center, self.spread = np.zeros(SHARES), np.ones(SHARES)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def forward(self, buckets: np.ndarray, sizes: np.ndarray, shares: np.ndarray, passages: np.ndarray) -> dict:
        """Logit of each document, with what the gradient needs; ``attention`` holds each passage's weight."""
        p, n = self.p, len(sizes)
        word_owner = np.repeat(np.arange(n), sizes)
        weight = 1 / np.maximum(sizes, 1)
        mean = sums_by(word_owner, p["words"][buckets], n) * weight[:, None]
        x = np.concatenate([mean, (shares - self.center) / self.spread], axis=1)
        h = np.tanh(x @ p["encode"] + p["encode_0"])
        t, g = np.tanh(h @ p["gate_v"]), sigmoid(h @ p["gate_u"])
        raw = (t * g) @ p["gate_w"]
        starts = np.cumsum(passages) - passages
        owner = np.repeat(np.arange(len(passages)), passages)
        e = np.exp(raw - np.maximum.reduceat(raw, starts)[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"logit": z @ p["unit"] + p["unit_0"][0], "attention": a, "x": x, "h": h, "t": t, "g": g, "z": z, "owner": owner, "starts": starts, "word_owner": word_owner, "weight": weight}

    def gradient(self, f: dict, buckets: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradient of the mean cross entropy; the word vectors' rows are given for the buckets returned second."""
        p, owner, a, h, t, g = self.p, f["owner"], f["attention"], f["h"], f["t"], f["g"]
        d_logit = (sigmoid(f["logit"]) - y) / len(y)
        dz = d_logit[:, None] * p["unit"]
        da = (dz[owner] * h).sum(axis=1)
        d_raw = a * (da - np.add.reduceat(a * da, f["starts"])[owner])
        dt, dg = d_raw[:, None] * p["gate_w"] * g * (1 - t * t), d_raw[:, None] * p["gate_w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[owner] + dt @ p["gate_v"].T + dg @ p["gate_u"].T) * (1 - h * h)
        d_mean = (dh @ p["encode"].T)[:, :DIMENSION] * f["weight"][:, None]
        at, inverse = np.unique(buckets, return_inverse=True)
        return {
            "words": sums_by(inverse, d_mean[f["word_owner"]], len(at)),
            "encode": f["x"].T @ dh,
            "encode_0": dh.sum(axis=0),
            "gate_v": h.T @ dt,
            "gate_u": h.T @ dg,
            "gate_w": d_raw @ (t * g),
            "unit": d_logit @ f["z"],
            "unit_0": np.array([d_logit.sum()]),
        }, at

    def step(self, gradient: dict, at: np.ndarray) -> None:
        """Adam; of the word vectors only the rows in use move."""
        self.steps += 1
        rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, d in gradient.items():
            rows = at if k == "words" else slice(None)
            self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * d
            self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * d * d
            self.p[k][rows] -= rate * self.m[k][rows] / (np.sqrt(self.v[k][rows]) + 1e-8)


def joined(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.concatenate([r[2] for r in rows]),
        np.concatenate([r[3] for r in rows]),
        np.concatenate([r[4] for r in rows]),
        np.array([len(r[3]) for r in rows]),
    )


def fit(rows: list[tuple], share: float) -> tuple[Model, float, float]:
    """The model from ``training_bags``, and slope and offset of the score's curve, fitted on a fifth held back from the training.

    The sample has both labels alike; the offset is moved back to their share among all labels. Without
    both labels the curve is flat: all documents score the share of label 1.
    """
    y = np.array([r[1] for r in rows], np.float64)
    model = Model()
    if len(set(y.tolist())) < 2:
        return model, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    held = np.arange(len(rows)) % 5 == 0
    if len(set(y[held].tolist())) < 2:
        held[:] = True
    learn = np.flatnonzero(~held) if not held.all() else np.arange(len(rows))
    every = np.concatenate([rows[i][4] for i in learn])
    model.center, model.spread = every.mean(axis=0), every.std(axis=0) + 1e-2
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for s in range(0, len(order), BATCH):
            part = joined([rows[i] for i in order[s : s + BATCH]])
            model.step(*model.gradient(model.forward(*part), part[0], y[order[s : s + BATCH]]))
    logits = np.concatenate([model.forward(*joined(rows[s : s + 512]))["logit"] for s in range(0, len(rows), 512)])
    slope, offset = platt(logits[held], y[held])
    sampled = float(y[held].mean().clip(1e-3, 1 - 1e-3))
    share = min(max(share, 1e-3), 1 - 1e-3)
    return model, slope, offset + float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages, top_passage, top_weight`` for every row of ``docs(doc_id, text)``.

    The last two are the passage that weighs most (from 0) and its weight. The model is fitted on ``labels(doc_id, quality)`` but
    for the rows held out (CRC-32 of the doc_id as text leaves 2 on division by 4); of repeated labels the greatest
    counts, of repeated documents the one of least bytes, null labels don't. Null and empty texts score as one passage without words.
    Repeated rows score alike; a null doc_id is scored and not held out; other columns are ignored; an empty table
    gives an empty result. Without labels of both classes every score is the share of label 1.
    """
    model, slope, offset = fit(*training_bags(docs, labels))
    model.m = model.v = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            logits, passages, tops, weights = [], [], [], []
            for texts in in_parts(b.column(2).to_pylist()):
                bags = Bags(texts, words)
                f = model.forward(bags.buckets, bags.sizes, bags.shares, bags.passages)
                logits.append(f["logit"])
                passages.append(bags.passages)
                for s, n in zip(f["starts"], bags.passages, strict=True):
                    top = int(f["attention"][s : s + n].argmax())
                    tops.append(top)
                    weights.append(float(f["attention"][s + top]))
            if not logits:
                continue
            score = sigmoid(slope * np.concatenate(logits) + offset)
            cols = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(np.concatenate(passages), pa.int64()), pa.array(tops, pa.int64()), pa.array(weights)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "held_out", "score", "predicted", "n_passages", "top_passage", "top_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages bigint, top_passage bigint, top_weight double")

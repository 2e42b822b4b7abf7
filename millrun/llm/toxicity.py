"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed to a fixed number of rows), so
unseen inflections and misspellings share most of their vectors with known words. A passage of
``PASSAGE`` words is the mean of its words, and goes through a linear softmax; embeddings and softmax are
fitted together. Labels are by document, so after a first round over random passages, each toxic
document teaches by its most toxic passages and each clean one by its most toxic and by random ones. A document scores as its
most toxic passage does, through a logistic curve fitted on documents held back from the training.

Training runs over a bounded sample of labelled rows (``TRAIN_DOCUMENTS``, ``TRAIN_PASSAGES`` of each); scoring reads every
word of every text. For two classes the softmax depends on one number a word, so the tasks get one number
for each hashed n-gram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIMENSION = 8
GRAMS = (3, 6)
PASSAGE = 16
#: Labelled documents that train the model, half of them toxic if there are as many; passages of each.
TRAIN_DOCUMENTS = 6000
TRAIN_PASSAGES = 64
EPOCHS = 6
THRESHOLD = 0.7
#: Words remembered by a task at a time.
WORDS_A_TASK = 400_000
#: Longest part of a word whose n-grams are taken one by one; a longer word is taken in such parts.
WORD_PART = 64


def gram_rows(word: str) -> list[int]:
    """Hashed rows of the n-grams (of UTF-8 bytes) of a word with its ends marked, and of the word itself."""
    whole, crc, out = word.encode("utf-8", "surrogatepass"), zlib.crc32, []
    for s in range(0, max(1, len(whole)), WORD_PART):
        w = b"<%b>" % whole[s : s + WORD_PART]
        out.append(crc(w) % BUCKETS)
        for n in range(GRAMS[0], GRAMS[1] + 1):
            out += [crc(w[i : i + n]) % BUCKETS for i in range(len(w) - n + 1)]
    return out


def words_of(text: str) -> list[str]:
    return text.lower().split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_passages(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple], float]:
    """``doc_id, toxic, passages`` of the bounded training sample (those of least hash among rows not held out), and the
    share of toxic rows among all that are not held out."""
    seen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = seen.where(~held_out(F.col("doc_id")))
    half = TRAIN_DOCUMENTS // 2
    by_hash = F.xxhash64("doc_id")
    parts = [seen.where(F.col("toxic") == t).orderBy(by_hash, "doc_id").limit(half) for t in (1, 0)]
    sample = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("_id"), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = words_of(text or "")
                starts = np.arange(0, max(1, len(w) - PASSAGE // 2), PASSAGE // 2)
                if len(starts) > TRAIN_PASSAGES:
                    starts = np.sort(np.random.default_rng(zlib.crc32(str(doc_id).encode())).choice(starts, TRAIN_PASSAGES, False))
                out.append([" ".join(w[s : s + PASSAGE]) for s in starts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], ["doc_id", "toxic", "passages"])

    # TRAIN_DOCUMENTS rows of two numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = found.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(
        run, f"doc_id {kind}, toxic int, passages array<string>"
    )
    # Of a doc_id's rows one, so that no more than TRAIN_DOCUMENTS reach the driver.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "passages")).alias("row")).select("doc_id", "row.*")
    share = seen.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return sorted(((r[0], r[1], list(r[2])) for r in rows.collect()), key=lambda r: (str(r[0]), r[1], r[2])), share or 0.0


def summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows that share an index, for indexes 0..n-1."""
    return np.stack([np.bincount(index, rows[:, d], n) for d in range(rows.shape[1])], axis=1)


class Model:
    """Embeddings and softmax, fitted by Adagrad on the cross entropy of passages."""

    def __init__(self, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        self.e = self.rng.normal(0, 0.1, (BUCKETS, DIMENSION))
        self.w = self.rng.normal(0, 0.1, (DIMENSION, 2))
        self.b = np.zeros(2)
        self.sums = [np.full_like(x, 1e-8) for x in (self.e, self.w, self.b)]

    def word_scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """Toxic less clean logit that each word adds before averaging."""
        u = self.e @ (self.w[:, 1] - self.w[:, 0])
        return np.array([u[g].mean() for g in grams]) if grams else np.zeros(0)

    def step(self, bags: list[np.ndarray], y: np.ndarray, grams: list[np.ndarray], rate: float = 0.3) -> None:
        words, place = np.unique(np.concatenate(bags), return_inverse=True)
        owner = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
        share = (1 / np.array([len(x) for x in bags]))[owner]
        rows = np.concatenate([grams[i] for i in words])
        of_word = np.repeat(np.arange(len(words)), [len(grams[i]) for i in words])
        gram_share = (1 / np.array([len(grams[i]) for i in words]))[of_word]
        v = np.add.reduceat(self.e[rows] * gram_share[:, None], np.flatnonzero(np.diff(of_word, prepend=-1)))
        x = np.add.reduceat(v[place] * share[:, None], np.flatnonzero(np.diff(owner, prepend=-1)))
        z = x @ self.w + self.b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dx = p @ self.w.T
        dv = summed(place, dx[owner] * share[:, None], len(words))
        at, inverse = np.unique(rows, return_inverse=True)
        de = summed(inverse, dv[of_word] * gram_share[:, None], len(at))
        for x, s, g, k in ((self.w, self.sums[1], x.T @ p, ...), (self.b, self.sums[2], p.sum(axis=0), ...), (self.e, self.sums[0], de, at)):
            s[k] += g * g
            x[k] -= rate * g / np.sqrt(s[k])


def fit(rows: list[tuple], toxic_share: float) -> tuple[np.ndarray, float, float]:
    """From ``training_passages``: a number for each hashed n-gram, and slope and offset of the score's curve.

    The sample has more toxic documents than the labels have; the offset is moved back to their share.
    Without two classes the curve is flat: all documents score the share of toxic ones.
    """
    y = np.array([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = toxic_share
        return np.zeros(BUCKETS), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    index: dict[str, int] = {}
    bags = [[np.array([index.setdefault(w, len(index)) for w in p.split()] or [index.setdefault("", len(index))]) for p in r[2]] for r in rows]
    grams = [np.array(gram_rows(w) or [0]) for w in index]
    model = Model()
    held = np.arange(len(rows)) % 5 == 0
    for epoch in range(EPOCHS):
        scores = model.word_scores(grams)
        chosen: list[tuple[np.ndarray, int]] = []
        for doc, label, hold in zip(bags, y.tolist(), held, strict=True):
            if hold:
                continue
            order = np.argsort([-scores[p].mean() for p in doc]) if epoch else model.rng.permutation(len(doc))
            top = order[: (4 if label else 8) if epoch else 8]
            if epoch and not label:
                top = np.unique(np.append(top, model.rng.choice(len(doc), min(len(doc), 8), False)))
            chosen += [(doc[i], label) for i in top]
        order = model.rng.permutation(len(chosen))
        for s in range(0, len(order), 256):
            part = [chosen[i] for i in order[s : s + 256]]
            model.step([p for p, _ in part], np.array([label for _, label in part]), grams)
    scores = model.word_scores(grams)
    best = np.array([max(scores[p].mean() for p in doc) for doc in bags])
    slope, offset = platt(best[held], y[held])
    sampled = y[held].mean().clip(1e-3, 1 - 1e-3)
    offset += np.log(toxic_share / (1 - toxic_share)) - np.log(sampled / (1 - sampled))
    return model.e @ (model.w[:, 1] - model.w[:, 0]), slope, offset


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y over x (a slope of at least 0), by Newton steps on smoothed labels."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    center, scale = x.mean(), x.std() or 1.0
    u = (x - center) / scale
    a = np.array([1.0, 0.0])
    m = np.stack([u, np.ones_like(u)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -30, 30)))
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-6 * np.eye(2)
        a += np.clip(np.linalg.solve(h, m.T @ (t - p)), -2, 2)
    slope = max(0.0, a[0]) / scale
    return float(slope), float(a[1] - slope * center)


def best_passage(scores: np.ndarray) -> float:
    """Greatest mean over any PASSAGE words in a row (over all words, if fewer; 0 without a word)."""
    if len(scores) <= PASSAGE:
        return float(scores.mean()) if len(scores) else 0.0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return float((total[PASSAGE:] - total[:-PASSAGE]).max() / PASSAGE)


class _WordScores(dict):
    def __init__(self, u: np.ndarray):
        super().__init__()
        self.u = u.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS_A_TASK:
            self.clear()
        rows = gram_rows(word)
        x = self[word] = sum(map(self.u.__getitem__, rows)) / len(rows)
        return x


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    The model is fitted on ``labels(doc_id, toxic)`` but for the rows held out (CRC-32 of the doc_id as
    text leaves 1 on division by 3); of repeated labels the greatest counts, of repeated documents the first by its passages, null ones don't. Null and empty texts score like a
    text of neutral words. Repeated rows score alike; a null doc_id is scored and not held out; other columns are ignored; an empty
    table gives an empty result. Without labels of both classes every score is the share of toxic labels.
    """
    u, slope, offset = fit(*training_passages(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordScores(u)
        for b in batches:
            best = []
            for text in b.column(2).to_pylist():
                words = words_of(text or "")
                best.append(best_passage(np.fromiter(map(known.__getitem__, words), np.float64, len(words))))
            score = 1 / (1 + np.exp(-np.clip(slope * np.array(best) + offset, -30, 30)))
            cols = [b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

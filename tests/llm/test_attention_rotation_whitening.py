"""Attention classifier, block rotation and whitening against brute force, on awkward rows and empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrun.llm import attention, middle, queries, whitening


def as_rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- fill-in-middle ---


def brute_middle(text, key):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_rows(spark, small):
    extra = [(500 + i, t) for i, t in enumerate(("\n", "a\n\n", "\r\nb\rc\n", "x<S>y\n", "<P", "<\nS>\n<M\n>", "a" * 300_000 + "\n" + "é\n" * 9000))]
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    docs = docs.withColumn("output", F.lit("clash"))
    expect = sorted(str((d.doc_id, *brute_middle(d.text or "", "" if d.doc_id is None else d.doc_id))) for d in docs.collect())
    got = as_rows(middle.fill_in_middle(docs))
    key = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    assert sorted(str((*(g[k] for k in key), bytes(g["output"]).decode())) for g in got) == expect
    texts = sorted((d.text or "").encode() for d in docs.collect())
    assert sorted(bytes(g["restored"]) for g in got) == texts
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_query_digests(spark, sf_dir):
    got = {r["doc_id"]: r for r in as_rows(queries.op12_block_rotation(spark, sf_dir))}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, form, p, m, output = brute_middle(d.text or "", d.doc_id)
        r = got[d.doc_id]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((d.text or "").encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>\n aé", max_size=40), st.integers(0, 10**6), st.sampled_from([0, 50, 100]), st.sampled_from([0, 30, 100]))
def test_rotations_are_inverted(text, key, rate, suffix_first):
    raw = text.encode()
    form, output, n, a, b = middle.transform(raw, str(key), rate, suffix_first)
    assert middle.restore(output, form) == raw
    assert n == len(re.findall(r"[^\n]*\n|[^\n]+", text))
    if form != "plain":
        assert sorted(output) == sorted(raw + b"<P><S><M>") and rate > 0 and 0 <= a <= b <= len(raw)


@given(st.binary(max_size=30), st.integers(0, 30), st.integers(0, 30))
def test_rotate(data, i, j):
    cut, end = sorted((min(i, len(data)), min(j, len(data))))
    buffer = bytearray(data)
    middle.rotate(buffer, 0, cut, end)
    assert bytes(buffer) == data[cut:end] + data[:cut] + data[end:]


# --- whitening ---


EMBEDDINGS = "vec_id bigint, embedding array<float>, whitened string, n int"


def brute_fit(vectors, weights):
    x = np.repeat(np.array(vectors, object), weights, axis=0)
    n, s = len(x), x.sum(axis=0)
    deviation = ((x * n - s) ** 2).sum(axis=1)
    centred = (x - np.array([si // n for si in s])).astype(float) - np.array([si % n / n for si in s])
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], components[:, ::-1]


@pytest.mark.parametrize("hot_share", [whitening.HOT_SHARE, 0.2])
def test_whitening_against_numpy(spark, hot_share):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (300, 6)) @ rng.normal(0, 1, (6, 6)) + rng.normal(0, 3, 6)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    hot = [0.5, -0.25, 1.0, -3.999, 200.0, 0.0]
    rows += [(1000 + i, hot) for i in range(150)] + [(7, rows[7][1]), (None, rows[8][1]), (None, hot)]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [math.nan] * 6, [math.inf] + [0.0] * 5, [1.0] * 5, [3e38] + [0.0] * 5]
    data = rows + [(2000 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], EMBEDDINGS).repartition(7)
    got = as_rows(whitening.whiten(df, components=4, hot_share=hot_share))
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, deviation, centred, values, components = brute_fit(x, [1] * len(x))
    assert len(got) == n == len(rows) and {g["n"] for g in got} == {n}
    z = centred @ components[:, :4] / np.sqrt(values[:4])
    signs = np.sign(z[0]) * np.sign(next(g["whitened"] for g in got if g["vec_id"] == 0))
    mine = sorted((str(g["vec_id"]), g["deviation"], *np.round(np.array(g["whitened"]) * signs, 6) + 0.0) for g in got)
    want = sorted((str(i), int(d), *np.round(w, 6) + 0.0) for (i, _), d, w in zip(rows, deviation, z, strict=True))
    for a, b in zip(mine, want, strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=2e-6)
    assert np.allclose(got[0]["explained"], values[:4] / values.sum(), rtol=1e-9)
    assert all(g["identity_error"] == got[0]["identity_error"] < 1e-9 for g in got)


def test_whitening_fit_on_distinct_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (60, 3)).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(500)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], EMBEDDINGS)
    got = as_rows(whitening.whiten(df, weights="one"))
    x = {tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in rows}
    n, _, _, values, _ = brute_fit(sorted(x), [1] * len(x))
    assert len(got) == 560 and {g["n"] for g in got} == {n}
    assert np.allclose(got[0]["explained"], values / values.sum())
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="two")


def test_whitening_of_flat_and_empty_tables(spark):
    flat = spark.createDataFrame([(i, [1.0, 2.0], "", 0) for i in range(5)], EMBEDDINGS)
    assert [(g["deviation"], g["whitened"]) for g in as_rows(whitening.whiten(flat))] == [(0, [])] * 5
    assert whitening.whiten(flat.limit(0)).count() == 0
    assert whitening.whiten(flat.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "", 0) for i in range(5)], EMBEDDINGS)
    assert {len(g["whitened"]) for g in as_rows(whitening.whiten(line))} == {1}


def test_sums_and_deviations_stay_exact_beyond_64_bits(spark):
    large = 2.0**46
    rows = [(0, [large, 1.0]), (1, [-large, 0.0]), *((i, [large, 0.5]) for i in range(2, 9))]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<double>")
    got = {g["vec_id"]: g["deviation"] for g in as_rows(whitening.whiten(df))}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    deviation = brute_fit(x, [1] * len(x))[1]
    assert got == {i: int(d) if d < 2**63 else None for (i, _), d in zip(rows, deviation, strict=True)}


def test_whitening_query_shape(spark, sf_dir):
    got = queries.op13_embedding_whitening(spark, sf_dir).toPandas()
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert len(got) == 32 * n and set(got.component) == set(range(1, 33)) and got.identity_error.max() < 1e-9
    columns = {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert columns <= set(got.columns)


# --- attention classifier ---


def brute_forward(model, text):
    """One document through the formulas, passage by passage."""
    p, words = model.p, text.split()
    h = []
    for s in range(0, max(1, len(words)), attention.PASSAGE):
        part = words[s : s + attention.PASSAGE]
        n = max(1, len(part))
        rows = [zlib.crc32(w.lower().encode()) % attention.BUCKETS for w in part]
        mean = p["words"][rows].sum(axis=0) / n
        shares = [len(set(part)) / n, sum(a == b for a, b in zip(part, part[1:], strict=False)) / n, len(part) / attention.PASSAGE]
        shares.append(sum(min(len(w), 24) / 12 for w in part) / n)
        for kind in (str.isupper, str.isdigit, lambda c: not c.isalpha() and not c.isdigit()):
            shares.append(sum(sum(map(kind, w)) / len(w) for w in part) / n)
        x = np.concatenate([mean, (np.array(shares) - model.center) / model.spread])
        h.append(np.tanh(x @ p["encode"] + p["encode_0"]))
    raw = np.array([(np.tanh(v @ p["gate_v"]) / (1 + np.exp(-(v @ p["gate_u"])))) @ p["gate_w"] for v in h])
    a = np.exp(raw - raw.max())
    a /= a.sum()
    return float((a @ np.array(h)) @ p["unit"] + p["unit_0"][0]), a


TEXTS = ["", "one", "a a a B2 !! " * 40, "é𝄞 Ünï x9 " * 55, " ".join(f"w{i % 90}" for i in range(400)), "x" * 5000, "tail"]


def test_attention_of_flat_bags_equals_loops():
    model = attention.Model()
    rng = np.random.default_rng(0)
    model.center, model.spread = rng.normal(0, 1, attention.SHARES), rng.uniform(0.5, 2, attention.SHARES)
    b = attention.Bags(TEXTS, attention.Words())
    f = model.forward(b.buckets, b.sizes, b.shares, b.passages)
    for i, text in enumerate(TEXTS):
        logit, a = brute_forward(model, text)
        assert abs(f["logit"][i] - logit) < 1e-5
        assert np.allclose(f["attention"][f["starts"][i] :][: len(a)], a, atol=1e-5)


def test_attention_gradient_by_differences():
    model = attention.Model()
    b = attention.Bags(TEXTS, attention.Words())
    y = np.array([0, 1, 0, 1, 1, 0, 1.0])
    args = (b.buckets, b.sizes, b.shares, b.passages)

    def loss():
        z = model.forward(*args)["logit"]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    gradient, at = model.gradient(model.forward(*args), b.buckets, y)
    rng = np.random.default_rng(1)
    for k, d in gradient.items():
        for _ in range(6):
            i = tuple(int(rng.integers(0, s)) for s in d.shape)
            j = (int(at[i[0]]), i[1]) if k == "words" else i
            old, e = model.p[k][j], 1e-5
            model.p[k][j] = old + e
            up = loss()
            model.p[k][j] = old - e
            down = loss()
            model.p[k][j] = old
            assert abs((up - down) / (2 * e) - d[i]) < 1e-6


def test_words_forget_when_full(monkeypatch):
    monkeypatch.setattr(attention, "WORDS_A_TASK", 3)
    words = attention.Words()
    for _ in range(3):
        for texts in (["a b c d"], ["d e", "a"]):
            fresh = attention.Bags(texts, attention.Words())
            again = attention.Bags(texts, words)
            assert (fresh.buckets == again.buckets).all() and (fresh.shares == again.shares).all()


def labelled(spark, n=600):
    """Clean texts, and bad ones of which only one passage is bad."""
    r = random.Random(2)
    clean = lambda k: " ".join(f"{r.choice('abcdefgh')}{r.choice('ou')}{r.randrange(40)}n" for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, clean(96) + (" " + "BUY!! NOW## " * 24 if bad else " " + clean(48)) + " " + clean(r.randrange(0, 200))))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_attention_learns_from_document_labels(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in as_rows(attention.quality_scores(docs, labels))}
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got) and len(held) > 50
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    bad = [r for r in held if r["doc_id"] % 4 == 0]
    assert np.mean([r["top_passage"] in (2, 3) for r in bad]) > 0.8


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(spark, 200)
    turned = labels.withColumn("quality", F.when(attention.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in as_rows(attention.quality_scores(docs, x))) for x in (labels, turned))
    assert a == b


def test_attention_awkward_rows(spark, small):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] * 2 + [(None, 1, 0), (300, 0, 0), (3, None, 0), (10**6, 1, 1)], "doc_id bigint, quality int, toxic int")
    docs = small.withColumn("score", F.lit("clash"))
    got = as_rows(attention.quality_scores(docs, labels))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    texts = {d.doc_id: d.text for d in docs.collect()}
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["score"])
    assert all(max(s) - min(s) < 1e-9 for s in by_text.values())
    assert [r["n_passages"] for r in got if r["doc_id"] == 400] == [-(-9000 // attention.PASSAGE)]
    assert attention.quality_scores(docs.limit(0), labels).count() == 0
    flat = as_rows(attention.quality_scores(docs, labels.where("quality = 1")))
    assert {r["predicted"] for r in flat} == {1}
    none = as_rows(attention.quality_scores(docs, labels.limit(0)))
    assert {r["predicted"] for r in none} == {0}


def test_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(attention, "TRAIN_DOCUMENTS", 40)
    docs, labels = labelled(spark, 200)
    rows, share = attention.training_bags(docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit("other"))), labels)
    assert len(rows) <= 40 and len({r[0] for r in rows}) == len(rows)
    assert 0.6 < share < 0.9
    assert all(len(r[3]) <= attention.TRAIN_PASSAGES for r in rows)

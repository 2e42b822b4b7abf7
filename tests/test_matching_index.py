"""Blocking of name pairs and the vector index against all pairs, with hot grams and hot buckets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrun.operators import text as T
from millrun.operators import vector_index as VI
from millrun.plans.text_queries import index_queries
from millrun.sources.tables import Tables


def grams(s):
    return frozenset(s[i : i + 3] for i in range(len(s) - 2)) if len(s) >= 3 else frozenset([s] if s else [])


def cosine(a, b):
    return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0


@pytest.mark.parametrize("gram_rows", [16, 512])
@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_blocking_loses_no_pair(spark, threshold, gram_rows):
    """Hundreds of names that all share a prefix (grams as hot as can be), some of them near copies."""
    r = random.Random(5)
    names = ["", "a", "ab", "abc", "pumpabc"]
    for _ in range(260):
        core = "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 14)))
        names += [r.choice(["", "pump ", "steel pump "]) + core, "pump " + core + r.choice(["", "x", "xyz"])]
    names = sorted(set(names))
    df = spark.createDataFrame(list(enumerate(names)), "id int, d string").repartition(4)
    got = {(p.id_a, p.id_b) for p in T.candidate_pairs(T.with_grams(df, "d"), "id", "grams", threshold, gram_rows).collect()}
    sets = [grams(x.lower()) for x in names]
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if cosine(sets[i], sets[j]) >= threshold}
    assert want <= got and all(a < b for a, b in got)
    assert len(got) < 0.8 * len(names) * (len(names) - 1) / 2


def test_prefilter_keeps_every_match(spark):
    r = random.Random(6)
    words = ["valve", "pump", "motor", "gear", "steel", "drive"]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) + r.choice(["", "s", " 2", " ii"]) for _ in range(160)})
    df = T.with_grams(spark.createDataFrame(list(enumerate(names)), "id int, d string"), "d")
    every = df.select(F.col("id").alias("id_a")).crossJoin(df.select(F.col("id").alias("id_b"))).where("id_a < id_b")
    full = T.score_pairs(every, df, "id", "d").where("match_tier <> 'LOW'")
    assert sorted(map(str, T.fuzzy_match(df.drop("grams"), "id", "d").collect())) == sorted(map(str, full.collect()))
    assert full.count() > 100


def test_one_gram_goes_to_a_grid_of_keys(spark):
    """One gram in every name: no (gram, part, part) key holds more rows of a side than asked for, or little more."""
    names = spark.createDataFrame([(i, ["hot", f"g{i}"]) for i in range(600)], "id int, grams array<string>")
    pairs = T.candidate_pairs(names, "id", "grams", 0.4, gram_rows=50)
    assert pairs.count() == 600 * 599 // 2


# --- vector index ---


def exact_topk(corpus, queries, k):
    c = T.vector_topk(corpus, "vec_id", "embedding", queries, "qid", "qvec", k)
    return c


def test_index_recall_on_the_given_embeddings(spark):
    for sf in ("sf0.01", "sf0.1"):
        t = Tables(spark, f"/root/testdata/{sf}")
        queries = index_queries(t)
        found = VI.indexed_topk(t.embeddings, "vec_id", "embedding", queries, "qid", "qvec", k=10)
        exact = exact_topk(t.embeddings, queries, 10)
        mean = VI.recall(found, exact).agg(F.avg("recall"), F.count("qid")).first()
        assert mean[0] >= 0.9 and mean[1] == queries.count()


def test_index_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (20, 16))
    data = [(int(i), (centers[i % 20] + rng.normal(0, 0.05, 16)).tolist()) for i in range(1500)]
    corpus = spark.createDataFrame(data, "vec_id int, embedding array<double>")
    queries = corpus.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    planes = VI.fit_planes(corpus, "embedding", bits=8, tables=4)
    found = VI.indexed_topk(corpus, "vec_id", "embedding", queries, "qid", "qvec", 10, planes, probes=3)
    assert VI.recall(found, exact_topk(corpus, queries, 10)).agg(F.min("recall")).first()[0] >= 0.9
    x = np.array([v for _, v in data])
    b = planes.buckets(x)
    scanned = np.mean([np.any([np.isin(b[:, t], planes.nearest(x[q], 3)[t]) for t in range(4)], axis=0).mean() for q in range(0, 1500, 100)])
    assert scanned < 0.4


def test_every_probe_makes_the_index_exact(spark):
    """All buckets probed: the exact answer, each pair once, with hot equal vectors, ties, zero and bad vectors."""
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(0, 1, 5).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(40)]
    data += [(200, [0.0] * 5), (201, None), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [1.0]), (205, [])]
    corpus = spark.createDataFrame(data, "vec_id int, embedding array<double>")
    good = corpus.where("vec_id < 200")
    queries = good.where("vec_id % 7 = 0 or vec_id = 100").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    planes = VI.fit_planes(corpus, "embedding", bits=3, tables=2)
    found = VI.indexed_topk(corpus, "vec_id", "embedding", queries, "qid", "qvec", 12, planes, probes=8)
    want = exact_topk(good, queries, 12)
    assert sorted(map(str, found.select("qid", "rank", "doc_id", "score").collect())) == sorted(map(str, want.select("qid", "rank", "doc_id", "score").collect()))
    none = VI.indexed_topk(corpus.limit(0), "vec_id", "embedding", queries, "qid", "qvec")
    assert none.count() == 0 and none.columns == ["qid", "rank", "doc_id", "score"]


def test_index_scores_in_blocks_without_a_row_a_pair(spark):
    """Equal copies by the thousand, more probes than a block has, an infinite and a zero vector; ids are text. No pairs in a join."""
    rng = np.random.default_rng(5)
    data = [(f"a{i:05d}", rng.normal(0, 1, 6).tolist()) for i in range(900)] + [(f"b{i:05d}", [1.0, 2.0, 0.5, 4.0, 5.0, 1.0]) for i in range(1500)]
    data += [("c0", [0.0] * 6), ("c1", [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0])]
    corpus = spark.createDataFrame(data, "vec_id string, embedding array<float>")
    queries = corpus.where("vec_id < 'a00300' or vec_id in ('b00007', 'c0')").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    planes = VI.Planes(np.zeros(6), np.random.default_rng(1).normal(size=(6, 6)), 2, 3)
    found = VI.indexed_topk(corpus, "vec_id", "embedding", queries, "qid", "qvec", 7, planes, probes=4)
    key = ["qid", "rank", "doc_id", "score"]
    want = exact_topk(corpus, queries, 7).where("score is not null")
    assert sorted(map(str, found.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_index_keeps_pairs_of_a_narrow_probe_once(spark):
    """Few probes: each answer is the best of the rows that share a probed bucket in any table, each row once."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    queries = corpus.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    planes = VI.fit_planes(corpus, "embedding", bits=5, tables=3)
    found = VI.indexed_topk(corpus, "vec_id", "embedding", queries, "qid", "qvec", 10, planes, probes=2).collect()
    b, unit = planes.buckets(x), x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 400, 10):
        near = planes.nearest(x[q], 2)
        met = np.flatnonzero(np.any([np.isin(b[:, t], near[t]) for t in range(3)], axis=0))
        want = sorted(met, key=lambda i: (-(unit[q] @ unit[i]), i))[:10]
        assert [r.doc_id for r in sorted(found, key=lambda r: r.rank) if r.qid == q] == want

"""Keywords of conversations: hits inside turns, across turns and across slices, against the joined text."""

import random

from pyspark.sql import functions as F

from millrun.operators import text as T

WORDS = ["a", "b", "c", "d e", "a b c", "c a", "b  b", " a", "c ", "abcabc", "a a a a a"]


def _brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv and r[2] is not None), key=lambda r: (r[1] is not None, r[1] or 0))
        joined = " ".join(r[2] for r in turns).lower()
        out[conv] = {w for w in WORDS if w in joined}
    return out


def _found(spark, rows):
    t = spark.createDataFrame(rows, "conv string, n int, text string").withColumn("found", F.lit("clash"))
    return {r["conv"]: set(r["found"]) for r in T.keywords_of_turns(t, "conv", "n", "text", WORDS).collect()}


def test_found_keywords_equal_the_joined_texts(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(60):
        for n in rng.sample(range(-200, 200), rng.choice((1, 3, 20))):
            text = rng.choice((None, "", "A", "b", "c", "d", "e", "bc", "abca", " "))
            rows.append((f"k{conv}", n, text))
    hot = [("hot", n, rng.choice(("", "x", "c", None))) for n in range(1500)]
    rows += hot + [("hot", 1500 + i, "a") for i in range(5)]
    rows += [("gap", 63, "d"), ("gap", 640, "e"), ("empty", 1, None), ("nulls", None, "d"), ("nulls", 0, "e")]
    rng.shuffle(rows)
    got = _found(spark, rows)
    assert got == _brute(rows)
    assert "d e" in got["gap"] and got["empty"] == set() and "d e" in got["nulls"] and "a a a a a" in got["hot"]


def test_conversations_equal_the_joined_form(spark):
    conv = [("p", 1, "the Hydraulic"), ("p", 2, "pump had a stockout in Chicago"), ("q", 1, "robot welding"), ("q", 2, "E-047"), ("z", 1, None)]
    t = spark.createDataFrame(conv, "conv string, n int, text string")
    joined = spark.createDataFrame(
        [("p", "the Hydraulic pump had a stockout in Chicago"), ("q", "robot welding E-047"), ("z", "")], "conv string, text string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(T.conversation_action_rank(t, "conv", "n", "text")) == rows(T.keyword_action_rank(joined, "conv", "text"))
    assert rows(T.conversation_best_answer(t, "conv", "n", "text")) == rows(T.keyword_best_answer(joined, "conv", "text"))
    none = t.limit(0)
    assert T.conversation_action_rank(none, "conv", "n", "text").count() == 0


def test_texts_do_not_cross_the_shuffle(spark):
    t = spark.createDataFrame([("p", 1, "x")], "conv string, n int, text string")
    plan = T.conversation_best_answer(t, "conv", "n", "text")._jdf.queryExecution().executedPlan().toString()
    first = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x][-1]
    assert "text" not in first and plan.count("Exchange hashpartitioning") <= 3

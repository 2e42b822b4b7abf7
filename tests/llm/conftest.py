import random

import pytest

WORDS = "the of and to river stone light amber quiet seven orbit lantern copper meadow signal harbor velvet".split()


@pytest.fixture(scope="session")
def small(spark):
    """Documents with nulls, empty texts, ties, repeated rows, a long text, near copies, shared passages, clashing columns."""
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))
    passage = text(70)
    rows = [(i, text(r.randrange(1, 120)), "en", "a") for i in range(30)]
    rows += [(100 + i, text(20) + "\n" + passage + "\n" + text(15), "en", "b") for i in range(8)]
    base = text(150)
    rows += [(200 + i, base if i < 4 else base + " end" + str(i), "de", "b") for i in range(8)]
    rows += [(300, None, None, None), (301, "", "en", "a"), (302, " \t\n", "xx", "c"), (None, text(40), "en", None)]
    rows += [rows[3], rows[3], (400, text(9000), "fr", "c"), (401, "ab" * 600, "en", "c"), (402, "é𝄞 Ünï" * 90, "en", "c")]
    rows = [(*x, "clash", 1.5) for x in rows]
    schema = "doc_id bigint, text string, lang string, source string, fp string, h double"
    return spark.createDataFrame(rows, schema).repartition(5).cache()

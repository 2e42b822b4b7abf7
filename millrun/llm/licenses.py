"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line, or a window of the words of consecutive lines (a block without a blank line, comment marks
and indents taken off), so that a notice wrapped at any width is read whole. It is a sparse bag of word n-grams. Features are the n-grams of the templates that contain a telling
word, so a paragraph without a telling word has no feature at all: it scores as the intercepts do, which is the
unknown class, and need not be looked at further. A multinomial logistic regression is fitted on variants
of the templates and on lines of the corpus with a telling word (those that hold a whole template, and as the unknown class those
with hardly a trigram of one). Its temperature is calibrated on sets of n-grams that the model did not see. A predicted family counts only if the paragraph also holds most of the
word trigrams of one of the family's templates. Training and scoring are DataFrame operations.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases by which licences are granted or named, by family.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "released under the bsd license",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
    ),
    "cc-by-nc": (
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    ),
    "cc-by-sa": (
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
    ),
    "cc0": (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "dedicated to the public domain under cc0 1.0 universal",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 3",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "licensed under the mit license",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v. 2.0",
        "licensed under the mozilla public license version 2.0",
    ),
}
UNKNOWN = "unknown"
#: Phrases that name licences in general and grant none.
UNTELLING = (
    "see the license file for details",
    "all rights reserved no part may be reproduced without permission",
    "he had a driving license and a fishing permit",
    "the general public was asked to attend with free admission",
    "the software was distributed without charge to every person",
    "copyright notice",
)
#: A paragraph without one of these has no feature.
TELLING = r"licen[cs]e|copyright|redistribut|warrant|merchantab|permission|creative|public|cc0|\bcc\b|\bby-|software|waived"
NGRAMS = (1, 2, 3)
#: Corpus paragraphs that teach the unknown class, and those that teach the family of a template they hold, at most.
BACKGROUND_PARAGRAPHS = 2000
KNOWN_PARAGRAPHS = 40
#: Characters that such a paragraph keeps on each side of its first telling word.
AROUND = 200
#: One in this many sets of n-grams calibrates instead of teaching.
HELD_BACK = 4
#: Least calibrated probability, and least share of a template's trigrams.
MIN_PROBABILITY = 0.5
MIN_COVERAGE = 0.6
#: Corpus lines with at least this share of a template's trigrams don't teach the unknown class.
BACKGROUND_COVERAGE = 0.1
SPACE = r"[^a-z0-9.\-]+"
#: Words of a window, and from one window's start to the next's: a span of up to 48 words is whole in one of them.
WINDOW_WORDS = 64
WINDOW_STEP = 16
#: Ends of lines, and the comment marks that are letters (others are no words).
LINE_END = r"\r\n|\r|\n"
COMMENT = r"(?i)^\s*(?:rem|dnl)(?=\s|$)"


def words(text: Column) -> Column:
    """Lower-case words of letters, digits, dots and hyphens, without a dot at their end."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), SPACE, " "), r"\.+( |$)", "$1")
    return F.filter(F.split(flat, " "), lambda w: w.rlike("[a-z0-9]"))


def ngrams(w: Column, n: int) -> Column:
    last = F.size(w) - n
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def _py_words(text: str) -> list[str]:
    return text.split()


def _grams(w: list[str], n: int) -> list[str]:
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def feature_names() -> list[str]:
    """The n-grams of all templates that contain a telling word, in order."""
    import re

    every = {g for ts in TEMPLATES.values() for t in ts for n in NGRAMS for g in _grams(_py_words(t), n)}
    return sorted(g for g in every if re.search(TELLING, g))


def with_paragraphs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_blocks``: for each block of lines with a telling word, ``lines`` and ``windows`` (their words).

    ``lines`` are the block's lines that have a telling word, ``windows`` those of its windows, none if it is one line.
    """
    telling = lambda x: x.rlike(f"(?i){TELLING}")
    lines = F.transform(F.split("text", LINE_END), lambda x: F.regexp_replace(x, COMMENT, " "))
    # A line without a letter or digit (blank, or comment marks alone) ends a block; \n\n then stands between blocks.
    joined = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"[\p{L}\p{N}]"), x).otherwise("")), "\n")
    blocks = F.when(telling(F.col("text")), F.filter(F.split(joined, "\n{2,}"), lambda x: telling(F.replace(x, F.lit("\n"), F.lit(" ")))))
    blocks = F.coalesce(blocks, F.array().cast("array<string>"))

    def windows(w: Column) -> Column:
        last = F.greatest(F.size(w) - (WINDOW_WORDS - WINDOW_STEP), F.lit(1)) - 1
        cut = F.transform(F.sequence(F.lit(0), last, F.lit(WINDOW_STEP)), lambda i: F.slice(w, i + 1, WINDOW_WORDS))
        return F.filter(cut, lambda x: telling(F.array_join(x, " ")))

    def read(x: Column) -> Column:
        own = F.transform(F.filter(F.split(x, "\n"), telling), words)
        wrapped = F.when(F.trim(x, F.lit("\n")).contains("\n"), F.flatten(F.transform(F.array(words(x)), windows)))
        return F.struct(own.alias("lines"), F.coalesce(wrapped, F.array().cast("array<array<string>>")).alias("windows"))

    return docs.withColumn("_blocks", F.transform(blocks, read))


def template_grams() -> dict[str, list[list[str]]]:
    """The trigrams of each template, by family."""
    return {f: [sorted(set(_grams(_py_words(t), 3))) for t in ts] for f, ts in TEMPLATES.items()}


def _features(w: Column, names: list[str]) -> Column:
    every = F.concat(*(ngrams(w, n) for n in NGRAMS))
    return F.array_intersect(every, F.array(*map(F.lit, names)))


def template_rows() -> list[tuple[list[str], str]]:
    """Words and family of variants of the templates and of phrases that grant nothing."""
    rng = np.random.default_rng(5)
    rows: list[tuple[list[str], str]] = []
    filler = _py_words("of the and in with work text file page note see also for more by this")

    def padded(w: list[str]) -> list[str]:
        a, b = (list(rng.choice(filler, rng.integers(0, 12))) for _ in range(2))
        return a + w + b

    for family, templates in TEMPLATES.items():
        for t in templates:
            w = _py_words(t)
            for drop in (0.0, 0.0, 0.05, 0.1, 0.15) * 8:
                rows.append((padded([x for x in w if rng.random() >= drop]), family))
    for t in UNTELLING:
        rows += [(padded(_py_words(t)), UNKNOWN) for _ in range(20)]
    every = [_py_words(t) for ts in TEMPLATES.values() for t in ts]
    for _ in range(600):  # stray bits of templates grant nothing
        w = every[rng.integers(len(every))]
        n = int(rng.integers(1, 4))
        s = int(rng.integers(0, max(1, len(w) - n)))
        rows.append((padded(w[s : s + n]), UNKNOWN))
    return rows


def corpus_rows(docs: DataFrame) -> list[tuple[list[str], str]]:
    """Words and family of a bounded sample of the corpus's lines with a telling word, from one scan.

    Lines with hardly a trigram of a template are unknown; lines that hold a whole template are of its family
    (less is not enough: most of an LGPL notice also stands in a GPL one).
    """
    line = F.explode(F.split("text", LINE_END)).alias("line")
    lines = docs.where(F.col("text").rlike(f"(?i){TELLING}")).select(line)
    # The surroundings of the first telling word, so that a row is small however long the line.
    place = F.regexp_instr("line", F.lit(f"(?i){TELLING}"))
    near = F.substring("line", F.greatest(place - AROUND, F.lit(1)), F.least(place - 1, F.lit(AROUND)) + AROUND + 20)
    templates = F.array(*(F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, g)).alias("grams")) for f, ts in template_grams().items() for g in ts))

    def share(own: Column, t: Column) -> Column:
        return F.size(F.array_intersect(t["grams"], own)).cast("double") / F.size(t["grams"])

    def closest(x: Column) -> Column:
        return F.array_max(F.transform(templates, lambda t: F.struct(share(x["own"], t).alias("share"), t["family"].alias("family"))))

    def family(x: Column) -> Column:
        known = F.when(x["best"]["share"] == 1.0, x["best"]["family"])
        return F.when(x["best"]["share"] < BACKGROUND_COVERAGE, F.lit(UNKNOWN)).otherwise(known)

    # Arrays of one element, so that each step is evaluated once a line.
    step = F.transform(F.array(words(near)), lambda w: F.struct(w.alias("w"), ngrams(w, 3).alias("own")))
    step = F.transform(step, lambda x: F.struct(x["w"].alias("w"), closest(x).alias("best")))
    step = F.transform(step, lambda x: F.struct(x["w"].alias("w"), family(x).alias("family")))
    judged = lines.where(place > 0).select(F.explode(F.filter(step, lambda x: x["family"].isNotNull())).alias("x"))
    distinct = judged.select("x.w", "x.family").distinct()
    # Ranks are cut in each task before the shuffle: a task takes at most this many rows of a family from each.
    order = Window.partitionBy("family").orderBy(F.xxhash64("w"), F.array_join("w", " "))
    ranked = distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BACKGROUND_PARAGRAPHS)
    taken = ranked.where((F.col("family") == UNKNOWN) | (F.col("rank") <= KNOWN_PARAGRAPHS)).collect()
    return [(list(r["w"]), r["family"]) for r in sorted(taken, key=lambda r: (r["family"], r["rank"]))]


def training_rows(docs: DataFrame) -> list[tuple[list[str], str]]:
    """Words and family: variants of the templates, phrases that grant nothing, and a bounded sample of the corpus."""
    return template_rows() + corpus_rows(docs)


class Classifier:
    """Weights by family and n-gram, and the temperature that calibrates the probabilities.

    One in four sets of n-grams is held back for the temperature, with all rows that have it: rows that differ only in words
    which are no features are one example, and none of them is on both sides.
    """

    def __init__(self, spark, rows: list[tuple[list[str], str]]):
        self.names = feature_names()
        self.families = [UNKNOWN, *TEMPLATES]
        numbered = [(w, self.families.index(f)) for w, f in rows]
        table = spark.createDataFrame(numbered, "w array<string>, label int")
        found = table.withColumn("found", _features(F.col("w"), self.names))
        held_back = F.pmod(F.xxhash64(F.array_sort("found")), F.lit(HELD_BACK)) == 0
        vector = F.transform(F.array(*map(F.lit, self.names)), lambda g: F.array_contains("found", g).cast("double"))
        data = found.withColumn("held", held_back & (F.size("found") > 0))
        fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=100, standardization=False).fit(
            data.where("not held").select(F.col("label").cast("double"), array_to_vector(vector).alias("features"))
        )
        self.weights = fitted.coefficientMatrix.toArray()
        self.intercepts = fitted.interceptVector.toArray()
        at = {g: k for k, g in enumerate(self.names)}
        self.held = [(sorted(r["found"]), r["label"]) for r in data.where("held").collect()]
        z = np.array([self.intercepts + self.weights[:, [at[g] for g in w]].sum(axis=1) for w, _ in self.held])
        self.temperature = _temperature(z, np.array([label for _, label in self.held]))

    def probabilities(self, found: Column) -> Column:
        """Array of probabilities, one for each of ``families``, of a paragraph's n-grams."""
        table = F.map_from_arrays(
            F.array(*map(F.lit, self.names)),
            F.array(*(F.array(*(F.lit(float(x)) for x in self.weights[:, k])) for k in range(len(self.names)))),
        )
        start = F.array(*(F.lit(float(x)) for x in self.intercepts))
        z = F.aggregate(found, start, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda x, y: x + y))
        e = F.transform(z, lambda x: F.exp(x / self.temperature))
        return F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))[0]


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least cross entropy on held-back rows."""

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return min((a * b for a, b in product((0.5, 1.0, 2.0, 4.0), (1.0, 1.2, 1.4, 1.7))), key=loss)


def scan(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs(text, ...)`` and ``_licenses``: an array of (paragraph, family, probability, coverage, confirmed).

    An entry for each line with a telling word whose likeliest class is a family with at least
    ``MIN_PROBABILITY``; ``coverage`` is the greatest share of a template's trigrams, ``confirmed`` if it is at least
    ``MIN_COVERAGE``. A family that a block of lines confirms only by a window has one entry for the block, the window
    of greatest coverage, in place of its unconfirmed lines. Null and empty texts have no entry. Repeated rows
    are scanned alike; further columns pass through, names that begin with an underscore are reserved; an empty table gives an empty result.
    """
    model = Classifier(docs.sparkSession, training_rows(docs))
    rows = with_paragraphs(docs)
    names = model.names
    families = F.array(*map(F.lit, model.families))
    grams = {f: F.array(*(F.array(*map(F.lit, g)) for g in ts)) for f, ts in template_grams().items()}
    templates = F.create_map(*(x for f, a in grams.items() for x in (F.lit(f), a)))

    def coverage(x: Column) -> Column:
        own = ngrams(x["w"], 3)
        shares = F.transform(
            F.element_at(templates, x["family"]), lambda t: F.size(F.array_intersect(t, own)).cast("double") / F.size(t)
        )
        return F.array_max(shares)

    def found(x: Column) -> Column:
        return F.struct(x["wrapped"].alias("wrapped"), x["w"].alias("w"), _features(x["w"], names).alias("found"))

    def scored(x: Column) -> Column:
        return F.struct(x["wrapped"].alias("wrapped"), x["w"].alias("w"), model.probabilities(x["found"]).alias("p"))

    def best(x: Column) -> Column:
        family = F.get(families, (F.array_position(x["p"], F.array_max(x["p"])) - 1).cast("int"))
        return F.struct(x["wrapped"].alias("wrapped"), x["w"].alias("w"), F.array_max(x["p"]).alias("p"), family.alias("family"))

    def compared(x: Column) -> Column:
        fields = {"paragraph": F.array_join(x["w"], " "), "family": x["family"], "probability": x["p"], "coverage": coverage(x)}
        return F.struct(x["wrapped"].alias("wrapped"), *(c.alias(k) for k, c in fields.items()))

    def units(b: Column) -> Column:
        """A block's lines and windows, marked."""
        mark = lambda k, flag: F.transform(b[k], lambda w: F.struct(F.lit(flag).alias("wrapped"), w.alias("w")))
        return F.concat(mark("lines", False), mark("windows", True))

    def settled(e: Column) -> Column:
        """A block's entries: its lines', and the best window of each family that no line confirms."""
        sure = F.filter(e, lambda x: x["coverage"] >= MIN_COVERAGE)
        by_line = F.transform(F.filter(sure, lambda x: ~x["wrapped"]), lambda x: x["family"])
        across = F.filter(sure, lambda x: x["wrapped"] & ~F.array_contains(by_line, x["family"]))
        ahead = lambda y, x: (y["family"] == x["family"]) & (
            (y["coverage"] > x["coverage"]) | ((y["coverage"] == x["coverage"]) & (y["paragraph"] < x["paragraph"]))
        )
        first = F.filter(F.array_distinct(across), lambda x: ~F.exists(across, lambda y: ahead(y, x)))
        taken = F.transform(first, lambda x: x["family"])
        lines = F.filter(e, lambda x: ~x["wrapped"] & ~F.array_contains(taken, x["family"]))
        return F.concat(lines, first)

    def entry(x: Column) -> Column:
        return F.struct(
            *(x[k].alias(k) for k in ("paragraph", "family", "probability", "coverage")),
            (x["coverage"] >= MIN_COVERAGE).alias("confirmed"),
        )

    known = lambda x: (x["family"] != UNKNOWN) & (x["p"] >= MIN_PROBABILITY)
    steps = (
        units,
        lambda b: F.filter(F.transform(b, found), lambda x: F.size(x["found"]) > 0),
        lambda b: F.transform(b, scored),
        lambda b: F.filter(F.transform(b, best), known),
        lambda b: F.transform(b, compared),
        settled,
        lambda b: F.transform(b, entry),
    )
    for step in steps:
        rows = rows.withColumn("_blocks", F.transform("_blocks", step))
    return rows.select(*docs.columns, F.flatten("_blocks").alias("_licenses"))

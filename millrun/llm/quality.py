"""Quality rules: base counts, and the distance of a document's histograms from its language's.

Two histograms of every document are compared to reference histograms of its language (medians over documents
and sources that pass the base rule): character classes, and common function words. The distance is the Jensen-Shannon distance (square root of the
divergence in bits: 0 equal, 1 disjoint). A document fails if a distance is over its limit and the
document is long enough to tell. Everything is DataFrame expressions; the only shuffle is of
one partial state a language, source and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import fits_broadcast, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
#: Shortest document, in characters of words and in words, whose histogram is compared.
MIN_CHARS = 200
MIN_HISTOGRAM_WORDS = 100
MAX_CLASS_DISTANCE = 0.34
MAX_WORD_DISTANCE = 0.32
#: Shares are rounded to this part before their medians are taken.
SHARE_STEPS = 1000
SPACE = r" \t\n\x0B\f\r"
#: Frequent function words by language.
COMMON_WORDS = {
    "de": "und der die das den dem des ein eine in im ist nicht zu von mit sich auf für als",
    "en": "the of and to in a is that it for was on as with be by at this are from",
    "es": "de la que el en y a los del se las por un para con no una su al es",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
}
#: Character classes, stripped from the words one after another; what is left is the last class.
CLASSES = (
    ("lower", "[a-z]+"),
    ("upper", "[A-Z]+"),
    ("letter", r"\p{L}+"),
    ("digit", r"\p{N}+"),
    ("symbol", "[#*$%&|<>]+"),
    ("stop", r"[.,;:!?'\"()\-]+"),
)


def _words_of(lang: Column) -> Column:
    table = F.create_map(*(x for k, w in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, w.split())))))
    return F.coalesce(F.element_at(table, F.coalesce(lang, F.lit(""))), F.array().cast("array<string>"))


def with_histograms(docs: DataFrame) -> DataFrame:
    """Add ``_words, _joined, _classes, _common``: the words, their text, and both histograms (arrays of counts).

    Works on ``_text`` and ``_lang``. ``_common`` counts each common word of the language and last all other words.
    """
    everything = sorted({w for ws in COMMON_WORDS.values() for w in ws.split()})
    out = docs.withColumn("_words", F.filter(F.split("_text", f"[{SPACE}]+"), lambda w: w != ""))
    out = out.withColumn("_joined", F.array_join("_words", "")).withColumn("_l0", F.col("_joined"))
    for i, (_, pattern) in enumerate(CLASSES):
        out = out.withColumn(f"_l{i + 1}", F.regexp_replace(f"_l{i}", pattern, ""))
    sizes = [F.char_length(f"_l{i}") for i in range(len(CLASSES) + 1)]
    classes = F.array(*(a - b for a, b in zip(sizes, sizes[1:], strict=False)), sizes[-1])
    out = out.withColumn("_classes", classes).drop(*(f"_l{i}" for i in range(len(CLASSES) + 1)))
    # The common words among the text's, each between two blanks of its own, so that replace() counts them.
    found = F.filter(F.transform("_words", F.lower), lambda w: w.isin(everything))
    out = out.withColumn("_found", F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")))

    def count(word: Column) -> Column:
        gone = F.replace(F.col("_found"), F.concat(F.lit(" "), word, F.lit(" ")), F.lit(""))
        return ((F.char_length("_found") - F.char_length(gone)) / (F.char_length(word) + 2)).cast("int")

    out = out.withColumn("_counts", F.transform(_words_of(F.col("_lang")), count))
    rest = F.size("_words") - F.aggregate("_counts", F.lit(0), lambda a, x: a + x)
    return out.withColumn("_common", F.concat("_counts", F.array(rest))).drop("_found", "_counts")


def base_failed(features: str) -> Column:
    """The base rule, from the struct of counts."""
    n = F.col(f"{features}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{features}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def language_references(rows: DataFrame) -> DataFrame:
    """``_ref, _ref_classes, _ref_common`` from ``with_features``: the typical shares of a language (null: '').

    Only documents count that pass the base rule and are long enough to tell. The share of a class or word is the
    median over a source's documents, then the median over sources, each weighted by the square root of its
    documents; so neither a junk source with most rows nor junk in fewer than half of the documents of each source
    moves it. Without a ``source`` column all is one source. Shares are counted in steps of 1 / SHARE_STEPS, so that
    medians are exact and a source's state is small. Null where no document of the language is long enough.
    """
    longest = max(len(w.split()) for w in COMMON_WORDS.values()) + 1
    sizes = {"classes": len(CLASSES) + 1, "common": longest}
    enough = {
        "classes": F.col("_features.word_chars") >= MIN_CHARS,
        "common": F.col("_features.n_words") >= MIN_HISTOGRAM_WORDS,
    }

    def steps(col: str, i: int) -> Column:
        counts = F.col(f"_features.{col}")
        total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when(enough[col], F.round(F.try_divide(F.get(counts, F.lit(i)) * SHARE_STEPS, total)).cast("int"))

    source = F.col("source") if "source" in rows.columns else F.lit(None).cast("string")
    passed = rows.where(~base_failed("_features"))
    names = [(col, i, f"_{col}{i}") for col, n in sizes.items() for i in range(n)]
    flat = passed.select(
        F.coalesce("lang", F.lit("")).alias("_ref"),
        source.alias("_source"),
        *(enough[col].cast("int").alias(f"_n_{col}") for col in sizes),
        *(steps(col, i).alias(k) for col, i, k in names),
    )
    by_source = flat.groupBy("_ref", "_source").agg(
        *(F.floor(F.sqrt(F.sum(f"_n_{col}")) * 1000).alias(f"_w_{col}") for col in sizes),
        *(F.percentile(k, F.lit(0.5)).alias(k) for _, _, k in names),
    )
    typical = by_source.groupBy("_ref").agg(
        *(F.percentile(k, F.lit(0.5), F.col(f"_w_{col}")).alias(k) for col, _, k in names)
    )

    def shares(col: str) -> Column:
        medians = [F.col(k) for c, _, k in names if c == col]
        total = reduce(lambda a, b: a + b, (F.coalesce(m, F.lit(0.0)) for m in medians))
        return F.array(*(F.try_divide(m, total) for m in medians)).alias(f"_ref_{col}")

    return typical.select("_ref", shares("classes"), shares("common"))


def js_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts from one of shares; null if either is empty or unknown."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    p = F.transform(counts, lambda x: x / total)

    def part(x: Column, y: Column) -> Column:
        mid = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / mid)).otherwise(0.0)

    both = F.zip_with(p, F.slice(shares, 1, F.size(counts)), part)
    divergence = F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2
    known = (total > 0) & F.get(shares, F.lit(0)).isNotNull()
    return F.when(known, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def repeat_words(words: str) -> list[tuple[str, Column]]:
    """Columns to add one after another; the last, ``_n_repeat``, counts words in windows found twice or more.

    Windows are compared by a 64-bit hash within the text. Only a text with a repeated window sorts them.
    """
    n, w = F.size(words), WINDOW_WORDS
    window = lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(w)))
    hashes = F.when(n >= w, F.transform(F.sequence(F.lit(0), F.greatest(n - w, F.lit(0))), window))
    hashes = F.coalesce(hashes, F.array().cast("array<bigint>"))
    placed = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    again = F.when(F.size("_h") > F.size(F.array_distinct("_h")), placed)
    s = F.col("_s")
    same = lambda e, k: F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))
    # get() is null before the first and after the last window
    twice = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
    starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
    p = F.col("_p")
    reach = F.transform(p, lambda x, k: F.least(F.lit(w), F.coalesce(F.get(p, k + 1) - x, F.lit(w))))
    total = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0))
    return [("_h", hashes), ("_s", again), ("_p", starts), ("_n_repeat", total)]


def with_features(docs: DataFrame) -> DataFrame:
    """All columns of ``docs(text, lang, source, ...)`` and ``_features``: the counts and histograms of each row."""
    rows = docs.withColumns({"_text": F.coalesce("text", F.lit("")), "_lang": F.coalesce("lang", F.lit(""))})
    rows = with_histograms(rows)
    for name, col in repeat_words("_words"):
        rows = rows.withColumn(name, col)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    symbol = [k for k, _ in CLASSES].index("symbol")
    rows = rows.withColumn("_lines", lines)
    fields = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length("_joined"),
        "n_symbols": F.get("_classes", F.lit(symbol)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("_n_repeat"),
    }
    counts = [c.cast("bigint").alias(k) for k, c in fields.items()]
    arrays = [F.col("_classes").alias("classes"), F.col("_common").alias("common")]
    return rows.select(*docs.columns, F.struct(*counts, *arrays).alias("_features"))


def judge(rows: DataFrame) -> DataFrame:
    """Replace ``_features`` of ``with_features`` (written before, for it is read twice) by the struct ``_quality``.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed, kept.
    """
    refs = written(language_references(rows), "references")
    refs = F.broadcast(refs) if fits_broadcast(refs) else refs
    joined = rows.join(refs, F.coalesce(rows.lang, F.lit("")) == refs._ref, "left")
    f = {k: F.col(f"_features.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    joined = joined.withColumns(
        {
            "_by_class": js_distance(F.col("_features.classes"), F.col("_ref_classes")),
            "_by_word": js_distance(F.col("_features.common"), F.col("_ref_common")),
        }
    )
    failed = base_failed("_features")
    odd = ((f["word_chars"] >= MIN_CHARS) & (F.col("_by_class") > MAX_CLASS_DISTANCE)) | (
        (f["n_words"] >= MIN_HISTOGRAM_WORDS)
        & (F.size("_features.common") > 1)
        & (F.col("_by_word") > MAX_WORD_DISTANCE)
    )
    fields = f | {
        "class_distance": F.col("_by_class"),
        "word_distance": F.col("_by_word"),
        "base_failed": failed,
        "kept": ~failed & ~F.coalesce(odd, F.lit(False)),
    }
    rest = [c for c in rows.columns if c != "_features"]
    return joined.select(*rest, F.struct(*(c.alias(k) for k, c in fields.items())).alias("_quality"))


def quality(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs(text, lang, source, ...)`` with a struct ``_quality`` (see ``judge``).

    Null text counts as empty (fails the base rule); a null source is a source. A null language is a language of its own, one
    outside COMMON_WORDS has no common words and is compared by character classes alone; short texts
    have no verdict but the base rule's. Distances are null where they cannot be told. Repeated rows are
    judged alike; further columns pass through, only names that begin with an underscore are
    reserved; an empty table gives an empty result. Rows and features are written once in between.
    """
    return judge(written(with_features(docs), "features"))

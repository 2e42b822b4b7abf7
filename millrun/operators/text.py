"""Text, matching and retrieval.

* Chunking is a per-row ``split`` / ``sequence`` / ``posexplode``: whole texts, no shuffle.
* Vector top-k scores a bounded, size-checked query set against the whole corpus and keeps the
  top k per query (S8) with ``row_number() <= k``, which Spark plans as a WindowGroupLimit: each
  map task keeps k rows per query before the shuffle, so no query gathers the corpus.
* Fuzzy matching never forms all pairs. A pair can reach the MEDIUM tier only when its
  trigram cosine is at least 0.4, and two sets with cosine >= t share a token within their
  first |X| - ceil(t^2 |X|) + 1 rarest tokens (prefix filtering). Candidates come from an
  equi-join on those prefix tokens, which is exact for every non-LOW pair; LOW pairs are
  counted, not listed (their number is the pair total minus the rest). This replaces the
  reference's ``a.id < b.id`` theta self-join (J11) over the distinct trimmed names (U2). Frequent grams are
  dealt to a grid of keys, and pairs pass size and position bounds before they are scored.
* Keyword ranking embeds the small fixed knowledge base as a literal array, so scoring is a
  per-row expression with no join.
"""

from __future__ import annotations

import functools

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.functions import scalar as P
from millrun.functions import similarity as S

# Fixed values of the reference's chunker and retrieval.
CHUNK_SIZE = 600
CHUNK_OVERLAP = 80
CONTEXT_SEPARATOR = "\n\n---\n\n"
# Fixed values of the fuzzy-match score.
W_SEMANTIC, W_JW, W_LEV = 0.50, 0.30, 0.20
TIER_HIGH, TIER_MEDIUM = 0.85, 0.70


def normalize_ws(text: Column | str) -> Column:
    """Runs of whitespace -> one space, trimmed."""
    return F.trim(F.regexp_replace(P.col(text), r"\s+", " "))


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Word windows of ``size`` with step ``size - overlap``; id = md5("source:index").

    A tail shorter than the overlap is still emitted (it lies inside the previous chunk), and
    an empty text yields no chunk - the same as the reference's loop.
    """
    step = size - overlap
    norm = normalize_ws(text_col)
    words = F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))
    d = docs.select(F.col(id_col).cast("string").alias("source"), words.alias("w"))
    d = d.filter(F.size("w") > 0)
    # the chunk texts are built inside the document row, so each exploded row carries only its
    # own text - not a copy of the whole word array (which would be quadratic in document length)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
    texts = F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, F.lit(size)), " "))
    d = d.select("source", F.posexplode(texts).alias("chunk_index", "content"))
    return d.select(
        F.md5(F.concat_ws(":", "source", F.col("chunk_index").cast("string"))).alias("chunk_id"),
        "source",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "content",
    )


def label_centroids(vectors: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    """Mean vector per label (query vectors for V1): one running mean a task and label, no explode."""
    v = vectors.select(label_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    return v.groupBy(label_col).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("qvec"))


def vector_topk(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, qid_col: str, qvec_col: str,
                k: int = 4) -> DataFrame:
    """V1: exact cosine top-k of every query over the whole corpus.

    The query set is stated by the caller and meets every corpus row in blocks of partitions. Spark broadcasts it
    when its measured bytes are under the session's threshold; nothing is counted while the plan is built.
    """
    q = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("qvec"))
    c = corpus.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("vec"))
    scored = c.join(q, how="inner", on=F.lit(True)).select("qid", "doc_id", S.cosine("qvec", "vec").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(
        F.col("qid").alias(qid_col), F.col("rank").cast("int").alias("rank"), "doc_id",
        P.round_half_up("score", 6).alias("score"),
    )


def retrieval_context(topk: DataFrame, qid_col: str, docs: DataFrame, doc_id: str, text_col: str, source_col: str) -> DataFrame:
    """The top chunks' texts joined in rank order with a separator, and their distinct sources."""
    j = topk.join(docs.select(F.col(doc_id).alias("doc_id"), text_col, source_col), "doc_id")  # retrieved chunks that exist
    return j.groupBy(qid_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text_col))), lambda s: s[text_col]),
                     CONTEXT_SEPARATOR).alias("context"),
        F.array_sort(F.collect_set(source_col)).alias("sources"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


# ---- fuzzy matching (M1-M4) -----------------------------------------------------------------


def semantic_threshold(medium: float = TIER_MEDIUM) -> float:
    """Smallest trigram cosine that can still reach ``medium`` (the other parts at most 1),
    less a margin for the 4-dp rounding of each part."""
    return max((medium - W_JW - W_LEV) / W_SEMANTIC - 1e-3, 0.0)


#: Rows of one gram and side that meet in one task: a gram with more is dealt to a grid of keys.
GRAM_ROWS = 512


def candidate_pairs(names: DataFrame, id_col: str, grams_col: str, threshold: float, gram_rows: int = GRAM_ROWS) -> DataFrame:
    """M2: exact blocking for a set cosine (Ochiai) of at least ``threshold``: no such pair is lost.

    The smaller set of a pair (of equal ones that of smaller id) is found by its first |X| - ceil(t |X|) + 1 rarest grams, the larger one by its first
    |Y| - ceil(t^2 |Y|) + 1: the overlap is at least t sqrt(|X||Y|), which is t |X| or more and t^2 |Y| or more. A
    pair that meets at places i and j of the common order can share 1 + min(|X| - i, |Y| - j) grams at most, and is dropped
    unless that and the sizes suffice (it would also have met at its first common gram).

    A gram with many rows is split: its rows are dealt to parts of about ``gram_rows``, and each part of the one side meets each part of
    the other under a key of its own, so no task compares more than gram_rows^2 pairs of one gram.
    """
    tok = names.select(id_col, F.size(grams_col).alias("size"), F.explode(grams_col).alias("tok"))
    freq = tok.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    one_name = Window.partitionBy(id_col).orderBy("df", "tok")  # one name's grams
    ranked = tok.join(freq, "tok").withColumn("place", F.row_number().over(one_name))
    size = F.col("size")
    small = F.col("place") <= size - F.ceil(size * threshold - 1e-9) + 1
    large = ranked.filter(F.col("place") <= size - F.ceil(size * (threshold * threshold) - 1e-9) + 1).withColumn("small", small)
    sides = large.groupBy("tok").agg(F.count_if("small").alias("n_small"), F.count(F.lit(1)).alias("n_large"))
    parts = {side: F.ceil(F.col(f"n_{side}") / gram_rows).cast("int").alias(f"{side}_parts") for side in ("small", "large")}
    rows = large.join(sides.filter("n_small > 0 and n_large > 1").select("tok", *parts.values()), "tok")
    mine = lambda n: F.pmod(F.xxhash64(id_col), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("small").select("tok", F.col(id_col).alias("x"), F.col("size").alias("x_size"), F.col("place").alias("i"),
                                       mine("small_parts").alias("a"), every("large_parts").alias("b"))
    right = rows.select("tok", F.col(id_col).alias("y"), F.col("size").alias("y_size"), F.col("place").alias("j"),
                        mine("large_parts").alias("b"), every("small_parts").alias("a"))
    ordered = (F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x") < F.col("y")))
    most = 1 + F.least(F.col("x_size") - F.col("i"), F.col("y_size") - F.col("j"))
    enough = most >= threshold * F.sqrt(F.col("x_size") * F.col("y_size")) - 1e-9
    length = F.col("x_size") >= threshold * threshold * F.col("y_size") - 1e-9
    met = left.join(right, ["tok", "a", "b"]).filter(ordered & length & enough)
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def score_pairs(pairs: DataFrame, names: DataFrame, id_col: str, text_col: str, at_least: float = 0.0) -> DataFrame:
    """M1 + M3 over given pairs: edit distance, its similarity, Jaro-Winkler, trigram cosine,
    composite and tier (tier on the un-rounded sum of the 4-dp parts).

    With ``at_least``, pairs whose composite cannot reach it by their grams and lengths are left out before the edit distance and the
    Python function see them."""
    n = names.select(id_col, text_col, "grams")
    a = n.select(F.col(id_col).alias("id_a"), F.col(text_col).alias("description_a"), F.col("grams").alias("ga"))
    b = n.select(F.col(id_col).alias("id_b"), F.col(text_col).alias("description_b"), F.col("grams").alias("gb"))
    p = pairs.join(a, "id_a").join(b, "id_b")
    la, lb = F.lower("description_a"), F.lower("description_b")
    dist = F.levenshtein(la, lb)
    longest = F.greatest(F.length("description_a"), F.length("description_b"))
    lev_sim = F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - dist / longest.cast("double"))  # Q18 guard
    r4 = lambda c: P.round_half_up(c, 4)
    if at_least > 0:
        # The cheap part first: with the best Jaro-Winkler the lengths allow, could the pair still reach the tier?
        p = p.withColumn("_cosine", r4(S.set_cosine("ga", "gb")))
        share = F.when(longest == 0, F.lit(1.0)).otherwise(F.least(F.length("description_a"), F.length("description_b")) / longest.cast("double"))
        jaro = (2 + share) / 3
        best = F.col("_cosine") * W_SEMANTIC + (jaro + 4 * S.JW_PREFIX_WEIGHT * (1 - jaro)) * W_JW + share * W_LEV
        p = p.filter(best >= at_least - 1e-3)
    scored = p.select(
        F.col("id_a").alias("sku_id_a"),
        "description_a",
        F.col("id_b").alias("sku_id_b"),
        "description_b",
        dist.alias("levenshtein_distance"),
        r4(lev_sim).alias("levenshtein_similarity"),
        r4(S.jaro_winkler_udf(la, lb)).alias("jarowinkler_similarity"),
        (F.col("_cosine") if at_least > 0 else r4(S.set_cosine("ga", "gb"))).alias("ngram_similarity"),
    )
    raw = F.col("ngram_similarity") * W_SEMANTIC + F.col("jarowinkler_similarity") * W_JW + F.col("levenshtein_similarity") * W_LEV
    tier = (
        F.when(F.col("levenshtein_distance") == 0, F.lit("EXACT"))
        .when(raw >= TIER_HIGH, F.lit("HIGH"))
        .when(raw >= TIER_MEDIUM, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
    return scored.withColumn("composite_score", r4(raw)).withColumn("match_tier", tier)


def with_grams(names: DataFrame, text_col: str) -> DataFrame:
    return names.withColumn("grams", S.char_trigrams(F.lower(F.col(text_col))))


def fuzzy_match(names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """M1-M3: every pair of distinct names whose tier is EXACT, HIGH or MEDIUM."""
    g = with_grams(names, text_col)
    pairs = candidate_pairs(g, id_col, "grams", semantic_threshold())
    return score_pairs(pairs, g, id_col, text_col, TIER_MEDIUM).filter(F.col("match_tier") != "LOW")


def fuzzy_tier_counts(names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """M4: pairs per tier over all n(n-1)/2 pairs; LOW = total - the listed tiers (exact)."""
    matched = fuzzy_match(names, id_col, text_col)
    listed = matched.groupBy("match_tier").agg(F.count(F.lit(1)).alias("pairs"))
    n = names.agg(F.count(F.lit(1)).alias("n"))
    total = n.select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("total"))
    low = total.join(listed.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("s")), how="inner", on=F.lit(True)).select(
        F.lit("LOW").alias("match_tier"), (F.col("total") - F.col("s")).cast("bigint").alias("pairs")
    )
    return listed.unionByName(low)


def top_duplicates(matched: DataFrame, n: int = 50) -> DataFrame:
    """M4: the top EXACT/HIGH pairs by composite score (ids break ties)."""
    return matched.filter(F.col("match_tier").isin("EXACT", "HIGH")).orderBy(
        F.desc("composite_score"), "sku_id_a", "sku_id_b"
    ).limit(n)


# ---- keyword knowledge bases (T3-T5) --------------------------------------------------------

# The action knowledge base (id, type, impact in USD, keywords).
ACTIONS = (
    ("ACT-001", "emergency_reorder", 421000, ("fg-55102", "hydraulic pump", "stockout", "chicago", "reorder", "stockouts")),
    ("ACT-002", "lateral_transfer", 284000, ("fg-78421", "sprocket", "rotterdam", "excess", "chicago", "transfer", "warehouse")),
    ("ACT-003", "update_contract", 143000, ("pacific components", "price discrepancy", "rate card", "contract", "po", "exceptions")),
    ("ACT-004", "expedite_shipment", 14000, ("po-91207", "eurotech", "rotterdam", "delivery", "delay", "shipment", "expedite")),
    ("ACT-005", "post_goods_receipt", 38000, ("po-84029", "allied", "invoice", "unmatched", "goods receipt", "actuator")),
    ("ACT-006", "adjust_forecast", 0, ("fg-55102", "hydraulic pump", "forecast", "mape", "bias", "demand", "error")),
    ("ACT-007", "dual_source", 218000, ("cp-33901", "control module", "pacific", "quantity variance", "dual source", "rfq")),
    ("ACT-008", "safety_stock_review", 67000, ("fg-91033", "drive belt", "singapore", "stockout", "safety stock", "at risk")),
    ("ACT-009", "capacity_escalation", 4200000, ("emea", "capacity", "attainment", "s&op", "ibp", "plan", "shortfall")),
    ("ACT-010", "fx_rate_refresh", 23500, ("precision parts", "fx", "eur", "currency", "invoice", "delivery mismatch")),
)
# The manuals fallback knowledge base (question keywords); item 0 is the default.
MANUAL_ANSWERS = (
    ("e-047", "encoder", "fault", "fal-asm"),
    ("oil pressure", "die lube", "bdy-stm", "stamping"),
    ("welding", "robot", "fanuc", "r-2000", "maintenance", "pm"),
    ("e-coat", "electrocoat", "paint", "rectifier", "voltage"),
    ("vision", "inspection", "camera", "false reject", "calibration"),
)
# Energy-vertical keywords (substring match, false hits such as "total" kept).
ENERGY_KEYWORDS = (
    "oil", "gas", "energy", "petroleum", "petro", "fuel", "refin", "lng", "lpg",
    "exxon", "shell", "chevron", "bp ", " bp", "total", "conocophillips", "conoco",
    "halliburton", "schlumberger", "slb", "baker hughes", "marathon", "valero",
    "phillips", "hess", "pioneer", "devon", "diamondback", "coterra", "ovintiv",
    "woodside", "santos", "origin energy", "repsol", "eni ", " eni", "equinor",
    "expro", "vistra", "entergy", "enersys", "duke energy", "dominion",
    "aramco", "adnoc", "lukoil", "rosneft", "gazprom",
)


def _hits(text: Column, keywords) -> Column:
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.instr(text, k) > 0))


def _ranked_actions(rows: DataFrame, key: str, hits, k: int, closed_ids) -> DataFrame:
    """T3 by ``hits(keywords)``, the number of an action's keywords that a row's text holds."""
    scored = F.array(*[
        F.struct(F.lit(aid).alias("action_id"), F.lit(atype).alias("action_type"), F.lit(impact).cast("bigint").alias("impact_usd"),
                 hits(kws).alias("score"))
        for aid, atype, impact, kws in ACTIONS if aid not in set(closed_ids)
    ])
    kept = F.filter(scored, lambda s: s["score"] > 0)
    ordered = F.array_sort(
        kept,
        lambda x, y: F.when(x["score"] != y["score"], y["score"] - x["score"])
        .when(x["impact_usd"] != y["impact_usd"], F.when(y["impact_usd"] > x["impact_usd"], 1).otherwise(-1))
        .otherwise(F.when(x["action_id"] < y["action_id"], -1).when(x["action_id"] > y["action_id"], 1).otherwise(0)),
    )
    top = rows.select(key, F.posexplode(F.slice(ordered, 1, k)).alias("pos", "a"))
    return top.select(key, (F.col("pos") + 1).cast("int").alias("rank"), "a.action_id", "a.action_type", "a.impact_usd", "a.score")


def _best_answer(rows: DataFrame, key: str, hits) -> DataFrame:
    """T4 by ``hits(keywords)``."""
    scores = F.array(*[hits(kws) for kws in MANUAL_ANSWERS])
    best = F.array_max(scores)
    idx = F.when(best > 0, F.array_position(scores, best) - 1).otherwise(F.lit(0))
    return rows.select(key, idx.cast("int").alias("answer_id"), best.cast("int").alias("score"))


def keyword_action_rank(texts: DataFrame, key: str, text_col: str, k: int = 3, closed_ids=()) -> DataFrame:
    """Actions scored by keywords contained in the lower-cased text; zero scores and closed
    actions dropped; top k by (score desc, impact desc, id)."""
    return _ranked_actions(texts, key, lambda kws: _hits(F.lower(F.col(text_col)), kws), k, closed_ids)


def keyword_best_answer(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """T4: the knowledge-base item with the most keyword hits; ties keep the first; no hit -> item 0."""
    return _best_answer(texts, key, lambda kws: _hits(F.lower(F.col(text_col)), kws))


def conversation_action_rank(turns: DataFrame, key: str, turn_col: str, text_col: str, k: int = 3, closed_ids=()) -> DataFrame:
    """T3 over whole conversations, a row a turn: ``keyword_action_rank`` of the turns joined by blanks, never joined."""
    rows = keywords_of_turns(turns, key, turn_col, text_col, [w for action in ACTIONS for w in action[3]])
    return _ranked_actions(rows, key, _found_among, k, closed_ids)


def conversation_best_answer(turns: DataFrame, key: str, turn_col: str, text_col: str) -> DataFrame:
    """T4 over whole conversations, a row a turn: ``keyword_best_answer`` of the turns joined by blanks, never joined."""
    rows = keywords_of_turns(turns, key, turn_col, text_col, [w for kws in MANUAL_ANSWERS for w in kws])
    return _best_answer(rows, key, _found_among)


def _found_among(keywords) -> Column:
    return F.size(F.array_intersect("found", F.array(*[F.lit(k) for k in keywords])))


TURNS_PER_SLICE = 64
BITS = 62  # keywords of one mask


def keywords_of_turns(turns: DataFrame, key: str, turn_col: str, text_col: str, keywords) -> DataFrame:
    """(key, found): the keywords contained in a conversation's lower-cased turns, in order and joined by blanks.

    A keyword lies inside a turn or across the border of turns. Each turn is searched where it is read and leaves a
    bit mask and its two ends, as long as the longest keyword less one; only these cross the shuffle. Ends meet inside
    slices of ``TURNS_PER_SLICE`` turn numbers, then the slices' ends meet, so that a conversation of any length is
    never gathered; masks are joined by ``bit_or``. Null texts are left out; a conversation without a text has none
    found. Turns of equal number go by the text's MD5; null numbers come first."""
    words = list(dict.fromkeys(keywords))
    groups = [words[i:i + BITS] for i in range(0, len(words), BITS)]
    masks = [f"_m{i}" for i in range(len(groups))]
    reach = max(len(w) for w in words) - 1

    def mask(text: Column, group) -> Column:
        bits = [F.when(F.instr(text, w) > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint") for b, w in enumerate(group)]
        return functools.reduce(lambda x, y: x.bitwiseOR(y), bits)

    def joined(pieces: Column, at_end: bool) -> Column:
        """The outer characters of pieces joined by blanks; null without a piece."""
        text = F.array_join(pieces, " ")
        return F.when(F.size(pieces) > 0, F.right(text, F.lit(reach)) if at_end else F.left(text, F.lit(reach)))

    low = F.lower(F.col(text_col))
    rows = turns.select(
        F.col(key), F.col(turn_col).alias("_turn"), F.floor(F.col(turn_col) / TURNS_PER_SLICE).alias("_slice"),
        F.col(text_col).isNull().alias("_void"), F.md5(F.col(text_col)).alias("_tie"),
        F.left(low, F.lit(reach)).alias("_head"), F.right(low, F.lit(reach)).alias("_tail"),
        *[mask(low, g).alias(m) for m, g in zip(masks, groups)],
    )
    # a turn adds at least the blank before it, so `reach` neighbours hold `reach` characters
    w = Window.partitionBy(key, "_void", "_slice").orderBy("_turn", "_tie")
    border = F.concat_ws(" ", "_before", "_head")
    rows = (
        rows.withColumn("_before", joined(F.collect_list("_tail").over(w.rowsBetween(-reach, -1)), True))
        .withColumn("_upto", joined(F.collect_list("_tail").over(w.rowsBetween(-reach, 0)), True))
        .withColumn("_from", joined(F.collect_list("_head").over(w.rowsBetween(0, reach)), False))
    )
    place = F.struct("_turn", "_tie")
    slices = rows.groupBy(key, "_void", "_slice").agg(
        *[F.bit_or(F.col(m).bitwiseOR(mask(border, g))).alias(m) for m, g in zip(masks, groups)],
        F.min_by("_from", place).alias("_head"), F.max_by("_upto", place).alias("_tail"),
    )
    w = Window.partitionBy(key, "_void").orderBy("_slice")
    slices = slices.withColumn("_before", joined(F.collect_list("_tail").over(w.rowsBetween(-reach, -1)), True))
    found = slices.groupBy(key).agg(*[F.bit_or(F.col(m).bitwiseOR(mask(border, g))).alias(m) for m, g in zip(masks, groups)])
    bits = [F.when(F.col(m).bitwiseAND(F.lit(1 << b)) != 0, F.lit(w)) for m, g in zip(masks, groups) for b, w in enumerate(g)]
    return found.select(key, F.array_compact(F.array(*bits)).alias("found"))


def keyword_classifier(texts: DataFrame, key: str, text_col: str, default: str = "manufacturing") -> DataFrame:
    """T5: ``energy`` when any keyword is a substring of the lower-cased text, else the default."""
    low = F.lower(F.col(text_col))
    hit = F.exists(F.array(*[F.lit(k) for k in ENERGY_KEYWORDS]), lambda k: F.instr(low, k) > 0)
    return texts.select(key, F.when(hit, F.lit("energy")).otherwise(F.lit(default)).alias("vertical"))


# ---- T2 as a Python UDTF (the UDF surface of SURVEY §2.12; the built-in form above is the default) ----

# The whitespace class of the built-in chunker's regular expression (Java ``\s``).
_WS = "[ \t\n\x0b\f\r]+"


def _chunk_udtf():
    import hashlib
    import re

    from pyspark.sql.functions import udtf

    ws = re.compile(_WS)

    @udtf(returnType="chunk_id: string, source: string, chunk_index: int, content: string")
    class ChunkWords:
        """One row per word window of one document (per-row helper; Spark partitions the documents)."""

        def eval(self, source, text, size: int, step: int):
            if source is None or text is None:
                return
            words = ws.sub(" ", text).strip(" ")
            if not words:
                return
            w = words.split(" ")
            for i, start in enumerate(range(0, len(w), step)):
                yield (hashlib.md5(f"{source}:{i}".encode()).hexdigest(), source, i, " ".join(w[start:start + size]))

    return ChunkWords


def chunk_documents_udtf(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_SIZE,
                         overlap: int = CHUNK_OVERLAP, view: str = "millrun_chunk_docs") -> DataFrame:
    """T2 through a Python UDTF applied laterally to every document; same rows as ``chunk_documents``.
    Kept as the table-function form of the chunker; the built-in expression form stays the default
    (no Python worker, whole-stage codegen)."""
    spark = docs.sparkSession
    spark.udtf.register("millrun_chunk_words", _chunk_udtf())
    docs.select(F.col(id_col).cast("string").alias("source"), F.col(text_col).alias("text")).createOrReplaceTempView(view)
    return spark.sql(
        f"SELECT c.chunk_id, c.source, c.chunk_index, c.content FROM {view} d, "
        f"LATERAL millrun_chunk_words(d.source, d.text, {int(size)}, {int(size - overlap)}) c")

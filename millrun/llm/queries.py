"""The registered queries of the training-data operators (whole tables, production parameters) and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.llm import attention, imatch, licenses, middle, mixing, packing, pii, quality, simhash, suffix_dedup, toxicity, warc, whitening
from millrun.llm.common import read, written
from millrun.session import ensure_checkpoint_dir

def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens; the ids as their CRC-32."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), packing.byte_bpe_50k())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and their edited texts, and their likeness."""
    return imatch.imatch(read(spark, sf_dir, "documents"))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-warc-{uuid.uuid4().hex}"
    pages = read(spark, sf_dir, "pages")
    got = warc.round_trip(pages, path)
    kind = pages.schema["page_id"].dataType
    rows = got.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
    # A revisit's payload is its response's: one row for each digest that is revisited.
    rows = written(rows, "read-back")
    revisits, responses = rows.where("record_type = 'revisit'"), rows.where("record_type <> 'revisit'")
    sizes = responses.join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi")
    sizes = sizes.groupBy("payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    full = revisits.join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.col("_bytes")).drop("_bytes")
    return responses.unionByName(full)


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity by a model fitted on the labels that are not held out."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all documents: predicted paragraphs, confirmed families, and the surest probability."""
    rows = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    confirmed = F.filter("_licenses", lambda x: x["confirmed"])
    return rows.select(
        "doc_id",
        F.size("_licenses").alias("n_predicted"),
        F.size(confirmed).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x["family"]))), ",").alias("families"),
        F.array_max(F.transform(confirmed, lambda x: x["probability"])).alias("probability"),
    )


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights flattened by a square root, as many documents as there are."""
    return mixing.poisson_mix(read(spark, sf_dir, "documents")).withColumnRenamed("_copy", "copy")


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, histogram distances and verdict of every document."""
    rows = quality.with_features(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    judged = quality.judge(written(rows, "features")).select("doc_id", "_quality.*")
    # Logarithms differ in the last place between engines.
    return judged.withColumns({k: F.round(k, 6) for k in ("class_distance", "word_distance")})


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal numbers, dates and addresses as format-preserving pseudonyms."""
    rows = pii.pseudonymise(read(spark, sf_dir, "documents"), pii.session_key(spark))
    return rows.select("doc_id", "text", F.col("_replaced").cast("bigint").alias("n_replaced"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents covered by a 200-byte string that also starts elsewhere."""
    cut = suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-dedup of all documents: 4-word shingles, links at 4 bits or fewer."""
    return simhash.simhash_near_dedup(read(spark, sf_dir, "documents"))


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality by a model fitted on the labels that are not held out."""
    return attention.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with prefix, middle and suffix exchanged, and restored; both texts as digests."""
    rows = middle.fill_in_middle(read(spark, sf_dir, "documents"))
    return rows.select(
        *("doc_id", "n", "form", "prefix_chars", "middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid embeddings whitened: a row for each of the first 32 components."""
    rows = whitening.whiten(read(spark, sf_dir, "embeddings"))
    cells = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "cell")
    return rows.select("vec_id", "n", "deviation", "identity_error", cells).select(
        *("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation"),
        *("cell.whitened", "cell.explained", "identity_error"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op8_feistel_pseudonyms": op8_feistel_pseudonyms,
    "op1_sum_of_squares_packing": op1_sum_of_squares_packing,
    "op2_imatch_fingerprints": op2_imatch_fingerprints,
    "op3_warc_segments": op3_warc_segments,
    "op7_subword_toxicity": op7_subword_toxicity,
    "op4_license_classifier": op4_license_classifier,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_quality_divergence": op6_quality_divergence,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_attention_quality": op11_attention_quality,
    "op12_block_rotation": op12_block_rotation,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_COMMON = ", ".join(f"('{lang}', {i}, '{w}')" for lang, ws in quality.COMMON_WORDS.items() for i, w in enumerate(ws.split()))

#: op6 from its definitions, with a row for each document, histogram and place.
QUALITY_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS l, source FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
    j AS (SELECT *, len(ws) AS n_words, array_to_string(ws, '') AS s,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
    n AS (SELECT r, doc_id, l, source, n_words, length(s) AS word_chars, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                 length(regexp_replace(s, '[^a-z]', '', 'g')) AS lo, length(regexp_replace(s, '[^A-Z]', '', 'g')) AS up,
                 length(regexp_replace(s, '[^\pL]', '', 'g')) AS letters, length(regexp_replace(s, '[^\pN]', '', 'g')) AS digits,
                 length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 length(regexp_replace(s, '[^.,;:!?''"()\-]', '', 'g')) AS stops FROM j),
    u AS (SELECT r, l, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
    v AS (SELECT r, p, string_agg(word, ' ') OVER five AS five_words, count(*) OVER five AS k FROM u
          WINDOW five AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    twice AS (SELECT r, unnest(list(p)) AS p FROM v WHERE k = 5 GROUP BY r, five_words HAVING count(*) > 1),
    covered AS (SELECT r, count(DISTINCT p + o) AS n_repeat_words FROM twice, range(5) t(o) GROUP BY r),
    b AS (SELECT n.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 n_words < {quality.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
          FROM n LEFT JOIN covered USING (r)),
    common(l, i, word) AS (VALUES {_COMMON}),
    hits AS (SELECT u.r, common.i, count(*) AS c FROM u JOIN common ON u.l = common.l AND lower(u.word) = common.word GROUP BY ALL),
    h AS (SELECT r, 'classes' AS kind, unnest(range(7)) AS i,
                 unnest([lo, up, letters - lo - up, digits, n_symbols, stops, word_chars - letters - digits - n_symbols - stops]) AS c FROM n
          UNION ALL SELECT n.r, 'common', common.i, coalesce(hits.c, 0) FROM n JOIN common USING (l) LEFT JOIN hits ON hits.r = n.r AND hits.i = common.i
          UNION ALL SELECT n.r, 'common', (SELECT count(*) FROM common WHERE common.l = n.l),
                           n_words - coalesce((SELECT sum(c) FROM hits WHERE hits.r = n.r), 0) FROM n),
    g AS (SELECT h.*, sum(c) OVER (PARTITION BY r, kind) AS total FROM h),
    told AS (SELECT b.l, b.source, kind, i, r, round(c * {quality.SHARE_STEPS}::DOUBLE / nullif(total, 0)) AS x FROM g JOIN b USING (r)
             WHERE NOT base_failed AND CASE kind WHEN 'classes' THEN word_chars >= {quality.MIN_CHARS} ELSE n_words >= {quality.MIN_HISTOGRAM_WORDS} END),
    by_source AS (SELECT l, source, kind, i, quantile_cont(x, 0.5) AS x, floor(sqrt(count(*)::DOUBLE) * 1000)::BIGINT AS weight
                  FROM told GROUP BY ALL),
    run AS (SELECT *, sum(weight) OVER (PARTITION BY l, kind, i ORDER BY x) AS upto,
                   (sum(weight) OVER (PARTITION BY l, kind, i) - 1) / 2.0::DOUBLE AS mid FROM by_source),
    med AS (SELECT l, kind, i, min(x) FILTER (upto > floor(mid)) AS below, min(x) FILTER (upto > ceil(mid)) AS above FROM run GROUP BY ALL),
    ref AS (SELECT l, kind, i, (below + above) / 2 / nullif(sum((below + above) / 2) OVER (PARTITION BY l, kind), 0) AS q FROM med),
    part AS (SELECT g.r, g.kind, q, c / total::DOUBLE AS p, (c / total::DOUBLE + q) / 2 AS m FROM g JOIN n USING (r)
             JOIN ref ON ref.l = n.l AND ref.kind = g.kind AND ref.i = g.i WHERE total > 0),
    js AS (SELECT r, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END
                                             + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 0)) AS dist
           FROM part GROUP BY ALL),
    k AS (SELECT b.*, x.dist AS class_distance, y.dist AS word_distance FROM b
          LEFT JOIN js x ON x.r = b.r AND x.kind = 'classes' LEFT JOIN js y ON y.r = b.r AND y.kind = 'common')
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(class_distance, 6) AS class_distance,
           round(word_distance, 6) AS word_distance, base_failed,
           NOT base_failed AND NOT coalesce(word_chars >= {quality.MIN_CHARS} AND class_distance > {quality.MAX_CLASS_DISTANCE}, false)
           AND NOT coalesce(n_words >= {quality.MIN_HISTOGRAM_WORDS} AND l IN (SELECT l FROM common)
                            AND word_distance > {quality.MAX_WORD_DISTANCE}, false) AS kept
    FROM k
"""

#: DuckDB SQL where SQL can express the operator.
ORACLE: dict[str, str] = {
    "op6_quality_divergence": QUALITY_SQL,
    "op5_poisson_mixing": """
        WITH n AS (SELECT source, count(*)::DOUBLE AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
        r AS (SELECT source, (SELECT sum(n) FROM n) * w / (SELECT sum(w) FROM n) / n AS rate FROM n),
        k AS (SELECT source, j, exp(j * ln(rate) - rate - lgamma(j + 1)) AS p
              FROM r, range(0, 400) t(j) WHERE j <= ceil(rate + 12 * sqrt(rate) + 30)),
        cdf AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM k),
        d AS (SELECT *, (CAST('0x' || substr(md5('20|' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) + 0.5)
                        / 4503599627370496.0 AS u FROM documents),
        m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS n
              FROM d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c < d.u GROUP BY ALL)
        SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM m
    """,
    "op12_block_rotation": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        u AS (SELECT doc_id, t, s, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units FROM d),
        h AS (SELECT *, len(units) AS n,
                     CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(units) + 1) AS c1,
                     CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
                     CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 < 50 AS suffix_first,
                     t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM u),
        b AS (SELECT *, array_to_string(units[1:least(c1, c2)], '') AS p,
                     array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
                     array_to_string(units[greatest(c1, c2) + 1:], '') AS x FROM h)
        SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
               CASE WHEN NOT plain THEN length(p) END AS prefix_chars,
               CASE WHEN NOT plain THEN length(m) END AS middle_chars,
               sha256(CASE WHEN plain THEN t WHEN suffix_first THEN '<S>' || x || '<P>' || p || '<M>' || m
                           ELSE '<P>' || p || '<S>' || x || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM b
    """,
}

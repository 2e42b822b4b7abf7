"""A corpus cleaned and packed in five stages, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.llm import mixing, packing, pii, quality, simhash
from millrun.llm.common import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(docs).where("_quality.kept").drop("_quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash near-duplicates (4-word shingles, 4 bits)."""
    return simhash.keep_one_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values replaced; ``n_chars`` follows the text where a value changes length."""
    rows = pii.pseudonymise(docs, pii.session_key(spark))
    n_chars = F.when(F.col("_replaced") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).drop("_replaced")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to source weights that are flattened by a square root, in global random order."""
    return mixing.poisson_mix(docs).drop("_copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    pieces = packing.pack(docs, packing.byte_bpe_50k())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", pseudonyms),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has neither the fingerprints' hash nor a tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

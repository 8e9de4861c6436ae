"""Corpus pipeline: from the documents table to packed token sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; the result
of each is written to the shared folder and read again, so a lost executor costs one stage at
most. All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, language_id, packing, simhash, suffix_dedup
from panelforge.sources.staging import stage


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with n_chars of the new text and the columns of `like`."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*like.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; dictionaries come from the labelled rows."""
    fold = language_id.held_out(F.col("doc_id"))
    known = docs.where(F.col("doc_id").isNotNull() & ~fold)
    found = language_id.identify(docs, language_id.learn(known))
    return found.where("accepted").select(*docs.columns)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group."""
    return simhash.keep_one_per_group(docs).select(*docs.columns)


def deduplicate_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that an earlier document has; texts that are gone as a whole go.

    A null text comes out empty.
    """
    found = suffix_dedup.deduplicate(docs, decode=True)
    cut = found.withColumnRenamed("kept", "text")
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return _with_text(left, docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows; texts with no other word go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scan(docs, benchmark, cut=True)
    left = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return _with_text(left, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_deduplicate),
    ("suffix_array_dedup", deduplicate_strings),
    ("benchmark_decontamination", remove_benchmarks),
    ("packing", pack_sequences),
]

#: Compression, suffix arrays and tokenizers have no SQL. Tests compare each operator (language ID: by
#: accuracy) with brute force, not the stages as a whole.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

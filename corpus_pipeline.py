"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dedup
from threadspark.llm.common import salt_of, stored, table

# Near duplicates in the pipeline: five words, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_THRESHOLD = 5, 80
# Memoised parts of texts; fewer than in the query, as workers hold memory of earlier stages.
MEMO = 200_000
# Names of working columns that no input has.
OWN = ("_pipeline_first", "_pipeline_second")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters have no language and go; the others stay as they are."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    model = language_id.fit(docs.where(salt_of("doc_id", 4, 2, inside=False)), ranks)
    if not model.languages:  # nothing to learn from rejects nothing
        return docs
    found = language_id.predict(docs, model, OWN)
    return found.where(F.col(OWN[0]) != language_id.UNKNOWN).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the one of the largest id; n_chars follows the text."""
    kept = line_dedup.drop_lines(docs, names=OWN).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    found = near_dedup.near_duplicates(docs, words=NEAR_WORDS, threshold=NEAR_THRESHOLD)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    hits = decontaminate.with_hits(decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark")))
    gone = hits.where(F.col("n_hit") > 0).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    found = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, MEMO, whole=False)
    return found.select("doc_id", "lang", "source", "n_chars", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode),
]

# SQL cannot express the language model and the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

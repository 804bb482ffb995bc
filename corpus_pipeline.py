"""The corpus pipeline: documents through five operators, one after another.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of ``documents``. ``run`` writes every
stage to the shared folder and reads it back, so a lost executor costs no more
than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerflow.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules
from offerflow.llm.common import read, saved, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one has."""
    small_batches(spark)
    return line_dedup.remove_shared(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights."""
    small_batches(spark)
    return mixing.sampled(docs, read(spark, sf_dir, "embeddings"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded bytes."""
    small_batches(spark)
    return bpe.round_trip(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates),
          ("mixing", mix), ("byte_bpe", tokens)]

#: Viterbi decoding with learned weights and patience diff have no SQL form; tests/llm holds the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

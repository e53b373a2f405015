"""A corpus pipeline: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowsmith.llm import jaccard, packing, quality, substrings, toxicity
from rowsmith.llm.common import discard, settle
from rowsmith.llm.tokenizing import default_vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality.keep(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the machine learns from the labelled ones among docs."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.harmless(docs, machine)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: Jaccard similarity of 0.8 or more of five-word shingles."""
    return jaccard.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat across or within them."""
    return substrings.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token sequences."""
    return packing.pack(docs, default_vocabulary())


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_dedup", near_deduplicated),
    ("substring_dedup", without_repeats),
    ("packing", packed),
]

#: Estimates by expectation-maximisation, a fitted machine, components and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each is written to the shared folder and read again as the next one's documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

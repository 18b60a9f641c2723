"""From raw documents to mixed and sharded training text, in five stages.

Each stage takes all that the one before kept, and what it decides takes effect: rejected documents,
all but the first of each group of near copies, and documents with benchmark passages go; the mix
repeats or leaves out documents; the last stage puts every remaining row with all its columns into a shard and slot,
which also tell the copies of a document apart.

Edge cases are those of the operators; a stage that keeps nothing passes on an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontaminate, hilbert, jaccard, mixing, quality
from folio.llm.base import stage, unstage
from folio.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copied(docs)


def hilbert_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert.placed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("hilbert_sharding", hilbert_sharding),
]

#: SQL can't express the similarity join and the mix; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        if before is not None:
            unstage(before)  # all of it has been read
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

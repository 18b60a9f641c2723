"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontaminate, embedded, hilbert, jaccard, lines, mixing, passages, phrases, quality, suffix_tree, toxicity, urls, whitening
from folio.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_docs(spark, sf_dir))


def op2_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(_docs(spark, sf_dir), suffix_tree.WORDS)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(_docs(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_docs(spark, sf_dir))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.sharded(_docs(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_docs(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_docs(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded.scored(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_suffix_tree_score, op3_ngram_jaccard_join, op4_line_dedup, op5_hilbert_sharding, op6_substring_dedup, op7_decontamination, op8_url_filter, op9_source_mixing, op10_toxicity, op11_embedding_whitening, op12_quality_classifier, op13_phrase_mining)}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.judged_sql(),
    "op4_line_dedup": lines.digest_sql(),
    "op5_hilbert_sharding": hilbert.sharded_sql(),
    "op7_decontamination": decontaminate.digest_sql(),
    "op8_url_filter": urls.judged_sql(),
    "op13_phrase_mining": phrases.mined_sql(),
}

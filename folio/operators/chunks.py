"""Chunks of section text for review, and what a budget lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import is_blank, words

# Sections that a budget serves first, words for a token.
PRIORITY = {"introduction": 0, "conclusion": 1, "abstract": 2}
OTHER = 5
WORDS_PER_TOKEN = 0.75


def chunked(texts: DataFrame, max_words: int = 900, keep: tuple[str, ...] = ("doc_id", "section")) -> DataFrame:
    """keep, chunk_index, text and word_count of each chunk; texts: keep and text.

    A text within the limit is one chunk as it is, a longer one is cut by words joined with one space;
    blank texts have none."""
    w = texts.where(~is_blank(F.col("text"))).withColumn("_w", words(F.col("text"))).withColumn("_n", F.size("_w"))
    n = F.ceil(F.col("_n") / max_words).cast("int")
    w = w.select(*keep, "text", "_w", "_n", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    part = F.slice("_w", F.col("chunk_index") * max_words + 1, F.lit(max_words))
    whole = F.col("_n") <= max_words
    return w.select(*keep, "chunk_index", F.when(whole, F.col("text")).otherwise(F.array_join(part, " ")).alias("text"), F.size(part).alias("word_count"))


def estimated_tokens(word_count: Column) -> Column:
    return F.floor(word_count / F.lit(WORDS_PER_TOKEN)).cast("int")


def interleaved(chunks: DataFrame, section_at: str, by: str = "doc_id") -> DataFrame:
    """Chunks with turn: first chunks of all sections, then second ones (W7); section_at orders the sections."""
    return chunks.withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy("chunk_index", section_at)))


def within_budget(chunks: DataFrame, limit: int, by: str = "doc_id") -> DataFrame:
    """Chunks of each document that its token limit admits, first sections first.

    Whether a chunk fits depends on all that fitted before, so each document's costs, and nothing else
    of it, are folded in one group."""
    rank = F.lit(OTHER)
    for k, v in PRIORITY.items():
        rank = F.when(F.col("section") == k, v).otherwise(rank)
    cost = estimated_tokens(F.col("word_count"))
    turned = chunks.withColumn("cost", cost).withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy(rank, "chunk_index", "section")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("turns"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["cost"] <= limit
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["turns"], x["turn"])).otherwise(s["turns"]).alias("turns"))

    order = F.array_sort(F.collect_list(F.struct("turn", "cost")))
    kept = turned.groupBy(by).agg(F.aggregate(order, start, step, lambda s: s["turns"]).alias("turns")).select(by, F.explode("turns").alias("turn"))
    return turned.join(kept, [by, "turn"]).drop("cost")

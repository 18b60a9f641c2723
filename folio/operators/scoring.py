"""Scores: findings to deductions, categories and one figure from 0 to 100.

Two aggregates: the largest penalty of each criterion in a category, then their sum. Both combine on
the map side, so a document with a million findings sends one row for each criterion and task.
Penalties are kept as whole basis points (of a category, and of confidence) until the end; sums don't
depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.numbers import rounded
from folio.functions.text import strip
from folio.operators.rules import severity_rank

# Rules that describe one defect, and where categories count.
RULE_GROUPS = {"font.main": "font", "font.mixed": "font", "font.paragraph_consistency": "font", "font.name": "font", "references.missing": "structure.section.references"}
BUCKETS = {"formatting": "formatting", "structure": "structure", "references": "structure", "language": "language", "style": "style", "content": "content"}
SCORED = ("formatting", "structure", "language", "style", "content")
REVIEWED = ("language", "style", "content")
VERSION = "3"


def lookup(c: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def chosen(at: Column, values: list[Column]) -> Column:
    """The value at a place from 0; null beyond."""
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(at == k, v).otherwise(out)
    return out


def criterion(rule_id: Column, message: Column) -> Column:
    """What is charged once: the rule's group, the rule, or else the message without case."""
    return F.coalesce(lookup(rule_id, RULE_GROUPS), F.nullif(rule_id, F.lit("")), F.lower(strip(message)))


def summary(findings: DataFrame, *by: str) -> DataFrame:
    """Counts by severity (A5)."""
    n = lambda s, name: F.count_if(F.col("severity") == s).alias(name)
    return findings.groupBy(*by).agg(n("critical", "critical"), n("error", "errors"), n("warning", "warnings"), n("info", "info"), n("pass", "passed"))


def penalties(findings: DataFrame, presets: DataFrame) -> DataFrame:
    """doc_id, preset_id, bucket, criterion, fraction and label: the largest fraction of each, and the least message that has it."""
    p = presets.select(F.col("id").alias("preset_id"), "scoring_policy", "advisory_rules")
    f = findings.join(F.broadcast(p), "preset_id").where(~F.coalesce(F.array_contains("advisory_rules", F.col("rule_id")), F.lit(False)))
    base = F.when(F.col("severity") == "critical", F.col("scoring_policy.critical")).when(F.col("severity") == "error", F.col("scoring_policy.error")).when(F.col("severity") == "warning", F.col("scoring_policy.warning"))
    sure = F.when((F.col("source") == "ai") & F.col("confidence").isNotNull(), F.col("confidence")).otherwise(1.0)
    f = f.withColumn("bucket", lookup(F.col("category"), BUCKETS)).withColumn("fraction", base * sure).where(F.col("bucket").isNotNull() & (base > 0))
    f = f.withColumn("criterion", F.concat("source", F.lit(":"), criterion(F.col("rule_id"), F.col("message"))))
    g = f.groupBy("doc_id", "preset_id", "bucket", "criterion").agg(F.max("fraction").alias("fraction"), F.min(F.struct((-F.col("fraction")).alias("f"), "message")).alias("first"))
    # A penalty of no confidence stays as a deduction of nothing, without a label.
    return g.select("doc_id", "preset_id", "bucket", "criterion", "fraction", F.when(F.col("fraction") > 0, F.col("first.message")).alias("label"))


def category_scores(docs: DataFrame, findings: DataFrame, presets: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """One row for each document and category; docs: doc_id, preset_id; coverage: doc_id, category, coverage of reviewed ones.

    A document's penalties are few, one for each criterion. They are joined by doc_id alone, which tables bucketed by it serve without an exchange."""
    pen = penalties(findings, presets).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("preset_id", "bucket", "criterion", "fraction", "label"))).alias("all"))
    weights = presets.select(F.col("id").alias("preset_id"), F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"scoring.{c}").cast("double").alias("max_points")) for c in SCORED))).alias("w")).select("preset_id", "w.*")
    rows = docs.select("doc_id", "preset_id").join(pen, "doc_id", "left").join(F.broadcast(weights), "preset_id")
    own = F.filter("all", lambda x: (x["preset_id"] == F.col("preset_id")) & (x["bucket"] == F.col("category")))
    rows = rows.withColumn("each", F.transform(own, lambda x: F.struct(x["criterion"].alias("criterion"), x["fraction"].alias("fraction"), x["label"].alias("label")))).drop("all")
    if coverage is None:
        rows = rows.withColumn("coverage", F.when(F.col("category").isin(*REVIEWED), 0.0).otherwise(1.0))
    else:
        rows = rows.join(coverage.select("doc_id", "category", F.col("coverage").alias("_c")), ["doc_id", "category"], "left")
        rows = rows.withColumn("coverage", F.when(F.col("category").isin(*REVIEWED), F.coalesce("_c", F.lit(0.0))).otherwise(1.0)).drop("_c")
    rows = rows.withColumn("evaluated", F.col("coverage") > 0)
    each = F.coalesce("each", F.array().cast("array<struct<criterion:string,fraction:double,label:string>>"))
    lost = F.aggregate(each, F.lit(0.0), lambda s, x: s + x["fraction"])
    earned = F.when(F.col("evaluated"), F.col("max_points") * F.greatest(F.lit(0.0), 1 - lost)).otherwise(0.0)
    shown = F.when(F.col("evaluated"), each).otherwise(F.slice(each, 1, 0))
    deductions = F.map_from_entries(F.transform(shown, lambda x: F.struct(x["criterion"], F.bround(x["fraction"] * F.col("max_points"), 2))))
    labels = F.map_from_entries(F.transform(F.filter(shown, lambda x: x["label"].isNotNull()), lambda x: F.struct(x["criterion"], x["label"])))
    rows = rows.select("doc_id", "preset_id", "category", "max_points", "coverage", "evaluated", earned.alias("earned"), deductions.alias("deductions"), labels.alias("deduction_labels"))
    return rows.withColumn("earned_points", rounded(F.col("earned"))).drop("earned")


def totals(categories: DataFrame) -> DataFrame:
    """score (over 100 for what was evaluated), evaluated_max_score and provisional of each document."""
    on = F.when(F.col("evaluated"), F.col("max_points")).otherwise(0.0)
    points = F.when(F.col("evaluated"), F.col("earned_points")).otherwise(0.0)
    g = categories.groupBy("doc_id", "preset_id").agg(F.sum(F.round(points * 10).cast("long")).alias("tenths"), F.sum(on).alias("evaluated_max_score"), F.min("coverage").alias("least"))
    raw = F.coalesce(F.try_divide(F.col("tenths") / 10.0, F.col("evaluated_max_score")) * 100, F.lit(0.0))
    g = g.withColumn("score", rounded(raw))
    return g.select("doc_id", "preset_id", "score", F.lit(100.0).alias("max_score"), "evaluated_max_score", (F.col("least") < 1).alias("provisional"), F.lit(VERSION).alias("scoring_version"))


def results(docs: DataFrame, findings: DataFrame, presets: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """The nested result of each document: totals, summary, category scores and findings in order."""
    keys = ["doc_id", "preset_id"]
    cats = category_scores(docs, findings, presets, coverage)
    nested = cats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("category", "max_points", "earned_points", "evaluated", "coverage", F.map_entries("deductions").alias("deductions"), F.map_entries("deduction_labels").alias("deduction_labels")))).alias("category_scores"))
    seq = F.struct(severity_rank(F.col("severity")).alias("rank"), "rule_ord", "sub_ord", "category", "severity", "source", "rule_id", "location", "message", "expected", "actual", "suggestion", "original_text", "confidence")
    found = findings.groupBy(*keys).agg(F.array_sort(F.collect_list(seq)).alias("findings"))
    status = presets.select(F.col("id").alias("preset_id"), F.col("provenance.status").alias("preset_status"))
    return totals(cats).join(nested, keys).join(summary(findings, *keys), keys, "left").join(found, keys, "left").join(F.broadcast(status), "preset_id", "left")

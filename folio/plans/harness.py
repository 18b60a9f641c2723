"""Shapes the harness tables like decoded documents, so that the operators themselves can be queried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import schemas
from folio.functions.text import word_count
from folio.operators.rules import COLUMNS, Corpus
from folio.sources.presets import preset, preset_table

BLOCK = r"<(?:h1|p|li)[^>]*>[^<]*</(?:h1|p|li)>"
#: A preset for harness documents; 20 mm margins and 20 pages' worth of tolerance are arbitrary.
PRESET = {
    "id": "base", "name": "Base", "institution": "Harness", "work_type": "coursework",
    "margins": {"top_mm": 20, "bottom_mm": 20, "left_mm": 30, "right_mm": 10, "tolerance_mm": 1.5},
    "font": {"name": "Times New Roman", "size_pt": 14},
    "structure": {"required_sections": ["introduction", "main_body", "conclusion", "references"], "optional_sections": ["appendix"]},
    "advisory_rules": ["text.long"],
}


def presets(spark: SparkSession) -> DataFrame:
    return preset_table(spark, [preset(PRESET)])


def with_runs(p: DataFrame) -> DataFrame:
    """Fills what a decoded paragraph has besides doc_id, idx and text, where p lacks it."""
    usual = {"style_name": F.lit("Normal"), "outline_level": F.lit(None).cast("int"), "alignment": F.lit("justify"), "line_spacing": F.lit(1.5), "line_spacing_rule": F.lit("MULTIPLE"), "space_before_pt": F.lit(0.0), "space_after_pt": F.lit(0.0), "first_line_indent_cm": F.lit(1.25), "left_indent_cm": F.lit(0.0), "right_indent_cm": F.lit(0.0), "in_table": F.lit(False), "page_break_before": F.lit(False), "is_numbered": F.lit(False)}
    p = p.withColumns({k: v for k, v in usual.items() if k not in p.columns})
    if "runs" not in p.columns:
        run = F.struct(F.col("text").alias("text"), F.lit("Times New Roman").alias("font_name"), F.lit(14.0).alias("font_size_pt"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("underline"), F.lit(None).cast("string").alias("color_rgb"))
        p = p.withColumn("runs", F.array(run).cast(schemas.RUNS))
    return p


def paragraphs(docs: DataFrame) -> DataFrame:
    """Lines of documents as paragraphs."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("idx", "text"))


def blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of web pages as paragraphs."""
    each = F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(0))).alias("idx", "raw")
    p = pages.select(F.col("page_id").alias("doc_id"), each)
    text = F.regexp_replace("raw", r"<[^>]*>", "")
    return with_runs(p.select("doc_id", "idx", text.alias("text"), F.when(F.startswith("raw", F.lit("<h1")), 0).alias("outline_level"), F.startswith("raw", F.lit("<li")).alias("is_numbered")))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns as paragraphs; those of users are headings."""
    return with_runs(conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), "text", F.when(F.col("role") == "user", 0).alias("outline_level")))


def corpus(spark: SparkSession, p: DataFrame, ids: DataFrame | None = None, **changed) -> Corpus:
    """Paragraphs under one preset, whose parts may be changed; ids: the documents, where some have no paragraph."""
    table = preset_table(spark, [preset(PRESET | {k: PRESET.get(k, {}) | v for k, v in changed.items()})])
    own = (p if ids is None else ids).select("doc_id").distinct().select("doc_id", F.lit("base").alias("preset_id"), F.lit(False).alias("has_header"), F.lit(True).alias("has_footer"))
    pages = spark.createDataFrame([], f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {schemas.PAGES}")
    return Corpus(own, pages, with_runs(p), table)


def under_heading(p: DataFrame, heading: str) -> DataFrame:
    """Paragraphs (doc_id, idx, text) after a top heading."""
    top = p.select("doc_id").distinct().select("doc_id", F.lit(0).alias("idx"), F.lit(heading).alias("text"), F.lit(0).alias("outline_level"))
    return top.unionByName(p.select("doc_id", (F.col("idx") + 1).alias("idx"), "text", F.lit(None).cast("int").alias("outline_level")))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    """The same rows for SQL."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return f"[{', '.join(map(one, v))}]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


def text_findings(docs: DataFrame, least_words: int = 50, page_chars: int = 2200) -> DataFrame:
    """Three rules on plain texts: too few words (error), repeated lines (warning), more than one page (critical)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    twice = F.size(lines) - F.size(F.array_distinct(lines))
    chars = F.length(F.replace(text, F.lit("\n"), F.lit("")))

    def row(order: int, hit: Column, category: str, severity: str, rule: str, message: Column, actual: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.when(hit, F.struct(F.lit(order).alias("rule_ord"), F.lit(0).alias("sub_ord"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit("rule_engine").alias("source"), F.lit(rule).alias("rule_id"), F.lit("").alias("location"), message.alias("message"), none.alias("expected"), actual.cast("string").alias("actual"), none.alias("suggestion"), none.alias("original_text"), F.lit(None).cast("double").alias("confidence")))

    n = word_count(text)
    found = F.array_compact(
        F.array(
            row(0, n < least_words, "structure", "error", "text.short", F.lit("Too few words"), n),
            row(1, twice > 0, "formatting", "warning", "text.repeated", F.concat(twice.cast("string"), F.lit(" repeated lines")), twice),
            row(2, chars > page_chars, "content", "critical", "text.long", F.lit("Longer than a page"), chars),
        )
    )
    return docs.select("doc_id", F.lit("base").alias("preset_id"), F.explode(found).alias("f")).select("doc_id", "preset_id", "f.*").select(*COLUMNS)


def as_checks(orders: DataFrame) -> DataFrame:
    """Orders as checks: the status letter tells the state, the total price the score."""
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("document_id"), state.alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("started_at"), F.when(state == "completed", F.col("o_orderdate")).alias("completed_at"), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "sending").when(F.pmod("o_orderkey", F.lit(3)) == 1, "pending").otherwise("sent").alias("delivery_status"), F.lit(0).alias("attempts"), F.lit(0).alias("delivery_attempts"), F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.lit("{}")).alias("job_payload"), F.lit(None).cast("string").alias("error_detail"), (F.pmod("o_orderkey", F.lit(2)) == 0).alias("ai_available"))


def as_uploads(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("filename"))

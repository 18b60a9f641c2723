"""Derived views of decoded documents: headings, body text, sections, font use.

All windows and groups are by doc_id, so one shuffle of the paragraphs serves every view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import sections as S
from folio.functions.text import is_blank, strip

#: Styles whose paragraphs are no body text (lower-cased).
NOT_BODY = ("title", "subtitle", "caption", "toc 1", "toc 2")


def marked(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with is_empty, is_heading, and for headings raw, normal, level, section_key and numbering."""
    heading = F.coalesce(F.col("outline_level") < 9, F.lit(False)) & ~F.col("is_empty")
    p = paragraphs.withColumn("is_empty", is_blank(F.col("text"))).withColumn("is_heading", heading)
    only = lambda c: F.when(F.col("is_heading"), c)
    p = p.withColumn("raw", only(strip(F.col("text")))).withColumn("normal", only(S.normalized(F.col("text"))))
    number = F.coalesce(S.numbering(F.col("raw")), F.when(F.col("is_numbered"), F.lit("auto")))
    return p.withColumn("level", only(F.col("outline_level") + 1)).withColumn("section_key", only(S.section_key(F.col("normal")))).withColumn("numbering", only(number))


def placed(paragraphs: DataFrame) -> DataFrame:
    """marked() with the document's first heading and first references heading, is_body, and the section of each paragraph."""
    order = W.partitionBy("doc_id").orderBy("idx")
    doc = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # in this order too, so that one sort serves all
    p = marked(paragraphs)
    p = p.withColumn("first_heading", F.coalesce(F.min(F.when(F.col("is_heading"), F.col("idx"))).over(doc), F.lit(0)))
    p = p.withColumn("references_at", F.min(F.when(F.col("section_key") == "references", F.col("idx"))).over(doc))
    before = F.col("references_at").isNull() | (F.col("idx") < F.col("references_at"))
    listed = F.lower(F.coalesce("style_name", F.lit(""))).isin(*NOT_BODY)
    body = ~F.coalesce(F.col("outline_level") < 9, F.lit(False)) & ~F.col("is_empty") & ~F.col("in_table") & (F.col("idx") >= F.col("first_heading")) & ~F.col("is_numbered") & before & ~listed
    opens = F.when(F.col("is_heading") & (F.col("section_key").isNotNull() | (F.col("level") == 1)), F.coalesce("section_key", F.concat(F.lit("unnamed:"), F.col("idx").cast("string"))))
    section = F.coalesce(F.last(opens, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit("body"))
    return p.withColumn("is_body", body).withColumn("section", section)


def headings(placed_paragraphs: DataFrame) -> DataFrame:
    return placed_paragraphs.where("is_heading").select("doc_id", F.col("idx").alias("paragraph_index"), F.col("raw").alias("raw_text"), F.col("normal").alias("normalized_text"), "level", "section_key", "numbering", "runs", "first_line_indent_cm", "page_break_before")


def joined_text(idx: Column, text: Column) -> Column:
    """Texts in the order of idx, joined by line feeds."""
    rows = F.array_sort(F.collect_list(F.struct(idx.alias("i"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), "\n")


def section_texts(placed_paragraphs: DataFrame) -> DataFrame:
    """doc_id, section, first index and the section's text; parts of one key are joined."""
    rows = placed_paragraphs.where(~F.col("is_empty"))
    return rows.groupBy("doc_id", "section").agg(F.min("idx").alias("at"), joined_text(F.col("idx"), F.col("text")).alias("text"))


def full_text(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where(~is_blank(F.col("text"))).groupBy("doc_id").agg(joined_text(F.col("idx"), F.col("text")).alias("text"))


def font_of(runs: Column) -> Column:
    """(name, size) with most characters in an array of runs, each run counting at least one; the first of equals."""
    keys = F.array_distinct(F.transform(runs, lambda r: F.struct(r["font_name"].alias("name"), r["font_size_pt"].alias("size"))))

    def weight(k: Column) -> Column:
        own = F.filter(runs, lambda r: r["font_name"].eqNullSafe(k["name"]) & r["font_size_pt"].eqNullSafe(k["size"]))
        return F.aggregate(own, F.lit(0), lambda s, r: s + F.greatest(F.length(r["text"]), F.lit(1)))

    ranked = F.transform(keys, lambda k, i: F.struct(weight(k).alias("w"), (-i).alias("i"), k.alias("k")))
    return F.array_max(ranked)["k"]


def run_rows(placed_paragraphs: DataFrame) -> DataFrame:
    """One row for each run of body text that is not blank, with its place."""
    rows = placed_paragraphs.where("is_body").select("doc_id", "idx", F.posexplode("runs").alias("pos", "run"))
    return rows.where(~is_blank(F.col("run.text"))).select("doc_id", "idx", "pos", F.col("run.font_name").alias("name"), F.col("run.font_size_pt").alias("size"), F.length("run.text").alias("chars"))


def font_use(runs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Characters of each (name, size), their share in per cent to one digit, and the rank: most first, the first seen of equals."""
    use = runs.groupBy(by, "name", "size").agg(F.sum("chars").alias("chars"), F.min(F.struct("idx", "pos")).alias("seen"))
    share = F.bround(F.col("chars") * 100.0 / F.greatest(F.sum("chars").over(W.partitionBy(by)), F.lit(1)), 1)
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("chars"), "seen"))
    return use.select(by, "name", "size", "chars", share.alias("share"), rank.alias("rank"))


def fonts_used(runs: DataFrame) -> DataFrame:
    """doc_id and use: a document's fonts (rank, name, size, chars, share) as font_use() has them, in the order of their rank."""
    place = F.shiftleft(F.col("idx").cast("long"), 32) + F.col("pos")
    each = runs.groupBy("doc_id", "name", "size").agg(F.sum("chars").alias("chars"), F.min(place).alias("seen"))
    d = each.groupBy("doc_id").agg(F.sum("chars").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("chars")).alias("order"), "seen", "name", "size", "chars"))).alias("fonts"))
    share = lambda x: F.bround(x["chars"] * 100.0 / F.greatest(F.col("total"), F.lit(1)), 1)
    return d.select("doc_id", F.transform("fonts", lambda x, i: F.struct((i + 1).alias("rank"), x["name"].alias("name"), x["size"].alias("size"), x["chars"].alias("chars"), share(x).alias("share"))).alias("use"))


def style_chain(styles: DataFrame, most: int = 16) -> DataFrame:
    """Ancestors of each style: (style_id, depth, ancestor), itself at depth 0; cycles end where they return.

    Steps are joins of the style table with itself, so inheritance of all documents is resolved at once."""
    keys = ["doc_id", "style_id"]
    out = step = styles.select(*keys, F.lit(0).alias("depth"), F.col("style_id").alias("ancestor"), "based_on", F.array("style_id").alias("seen"))
    parents = styles.select(F.col("doc_id").alias("_d"), F.col("style_id").alias("_s"), F.col("based_on").alias("_b"))
    for _ in range(most):
        step = step.join(parents, (F.col("doc_id") == F.col("_d")) & (F.col("based_on") == F.col("_s")))
        step = step.where(~F.array_contains("seen", F.col("_s"))).select(*keys, (F.col("depth") + 1).alias("depth"), F.col("_s").alias("ancestor"), F.col("_b").alias("based_on"), F.array_append("seen", F.col("_s")).alias("seen"))
        out = out.unionByName(step)
    return out.select(*keys, "depth", "ancestor")


def inherited(chain: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """The value nearest in the chain that is not null, for each style; explicit zero and false count."""
    v = values.select(F.col("doc_id").alias("_d"), F.col("style_id").alias("_s"), F.col(value).alias("_v"))
    both = chain.join(v, (F.col("doc_id") == F.col("_d")) & (F.col("ancestor") == F.col("_s")))
    return both.groupBy("doc_id", "style_id").agg(F.expr("min_by(_v, depth) FILTER (WHERE _v IS NOT NULL)").alias(value))

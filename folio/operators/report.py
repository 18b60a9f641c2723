"""What people see of a result: localised texts, report rows, messages.

Message catalogues are small tables (key, lang, template) that the caller provides; they are broadcast
after their size is checked. Rendering to a page format is left to whoever reads the rows."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from folio.functions.text import is_blank, lines, strip
from folio.operators.rules import severity_rank
from folio.schemas import SECTION_KEYS

LANGS, DEFAULT_LANG = ("ru", "kk", "en"), "ru"
MOST_MESSAGES = 100_000
MOST_ERRORS, MOST_ADVICE = 30, 20
# Marks of severities, and reasons that may be told.
MARKS = {"critical": "\U0001f534", "error": "\U0001f7e0", "warning": "\U0001f7e1", "info": "\U0001f535", "pass": "\U0001f7e2"}
REASONS = ("budget", "timeout", "provider", "invalid_response", "disabled", "empty_text")


def normal_lang(c: Column) -> Column:
    c = F.lower(F.coalesce(c, F.lit(DEFAULT_LANG)))
    return F.when(c.isin(*LANGS), c).otherwise(DEFAULT_LANG)


def catalogue(messages: DataFrame) -> DataFrame:
    """key and its templates by language; of a key and language given twice (seq) the later counts."""
    last = messages.groupBy("key", "lang").agg(F.max(F.struct("seq", "template"))["template"].alias("template"), F.min("seq").alias("seq"))
    return last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("lang", "template"))).alias("by_lang"), F.min(F.struct("seq", "template"))["template"].alias("first"))


def localised(rows: DataFrame, messages: DataFrame, key: str, lang: Column, out: str, args: str | None = None) -> DataFrame:
    """The template of each row's key: in its language, in the default language, the first one, or else the key itself.

    args: a map column whose entries fill {name} places; if one is missing the template stays as it is."""
    if messages.limit(MOST_MESSAGES + 1).count() > MOST_MESSAGES:
        raise ValueError(f"at most {MOST_MESSAGES} messages can be broadcast")
    c = catalogue(messages).withColumnRenamed("key", "_key")
    both = rows.join(F.broadcast(c), rows[key] == c["_key"], "left")
    text = F.coalesce(F.try_element_at("by_lang", F.lower(F.coalesce(lang, F.lit(DEFAULT_LANG)))), F.try_element_at("by_lang", F.lit(DEFAULT_LANG)), "first", F.col(key))
    if args:
        places = F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1))
        known = F.forall(places, lambda p: F.map_contains_key(F.col(args), p))
        filled = F.aggregate(F.map_entries(F.col(args)), text, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
        text = F.when(known & F.col(args).isNotNull(), filled).otherwise(text)
    return both.withColumn(out, text).drop("_key", "by_lang", "first")


def section_label(key: Column, text: Column, names: dict[str, str], paragraph: str = "Paragraph {n}") -> Column:
    """A section's name; an unnamed one by its first line, or by its paragraph counted from 1."""
    known = F.create_map(*(F.lit(x) for k in SECTION_KEYS for x in (k, names.get(k, k))))
    title = strip(F.get(lines(text), F.lit(0)))
    at = F.nullif(F.regexp_extract(key, r"(\d+)", 1), F.lit(""))
    named = F.when(~is_blank(text) & (title != "") & (F.length(title) <= 180), title).otherwise(F.coalesce(F.replace(F.lit(paragraph), F.lit("{n}"), (at.cast("int") + 1).cast("string")), F.lit(names.get("main_body", "main_body"))))
    return F.coalesce(F.try_element_at(known, key), F.when(F.startswith(key, F.lit("unnamed")), named), F.lit(names.get("main_body", "main_body")))


def display_location(c: Column, names: dict[str, str], paragraph: str = "Paragraph {n}", section: str = "Section {n}") -> Column:
    """A location in words: unnamed places counted from 1, sections and section keys by name."""
    bits = F.split(c, r"(?=\bunnamed:?\s*\d+\b)")

    def named(x: Column) -> Column:
        at = F.nullif(F.regexp_extract(x, r"^unnamed:?\s*(\d+)\b", 1), F.lit(""))
        return F.when(at.isNotNull(), F.concat(F.replace(F.lit(paragraph), F.lit("{n}"), (at.cast("long") + 1).cast("string")), F.regexp_replace(x, r"^unnamed:?\s*\d+\b", ""))).otherwise(x)

    out = F.array_join(F.transform(bits, named), "")
    quoted = lambda s: s.replace("\\", r"\\").replace("$", r"\$")
    out = F.regexp_replace(out, r"\b(body|main_body)\b", quoted(names.get("main_body", "main_body")))
    out = F.regexp_replace(out, r"\bSection\s+(\d+)", quoted(section).replace("{n}", "$1"))
    for k in SECTION_KEYS:
        out = F.regexp_replace(out, rf"\b{k}\b", quoted(names.get(k, k)))
    return out


def score_over_100(score: Column, most: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(score, most) * 100, 1), F.lit(0.0))


def score_note(provisional: Column, reviewed: Column, reasons: Column) -> Column:
    """Message keys of the note on a score: complete, or provisional with each known reason once."""
    why = F.transform(F.array_distinct(F.filter(reasons, lambda r: r.isin(*REASONS))), lambda r: F.concat(F.lit("ai.reason."), r))
    return F.when(provisional | ~reviewed, F.concat(F.array(F.lit("score.provisional")), why)).otherwise(F.array(F.lit("score.complete")))


def category_percentage(earned: Column, most: Column) -> Column:
    """The share of its points that a category earned, in per cent; all of it where there are none to earn."""
    return F.when(most == 0, 100.0).otherwise(F.bround(earned / most * 100, 1))


def category_value(earned: Column, most: Column, evaluated: Column, coverage: Column) -> Column:
    plain = lambda c: F.regexp_replace(F.round(c, 4).cast("string"), r"\.0$", "")
    part = F.when(coverage < 1, F.concat(F.lit(" · "), F.bround(coverage * 100, 0).cast("int").cast("string"), F.lit("%"))).otherwise("")
    return F.when(~evaluated, "not evaluated").otherwise(F.concat(plain(earned), F.lit("/"), plain(most), part))


def mark(severity: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv)), severity)


def finding_line(location: Column) -> Column:
    """A finding as lines of text (P26): mark and message, place, expected and actual, advice, confidence."""
    more = lambda c, t: F.when(c, t)
    both = F.col("expected").isNotNull() & (F.col("expected") != "") & F.col("actual").isNotNull() & (F.col("actual") != "")
    return F.concat_ws(
        "\n",
        F.concat(mark(F.col("severity")), F.lit(" "), F.col("message")),
        more(F.coalesce(location, F.lit("")) != "", F.concat(F.lit("   "), location)),
        more(both, F.concat(F.lit("   expected "), F.col("expected"), F.lit(", found "), F.col("actual"))),
        more(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("   "), F.col("suggestion"))),
        more(F.col("confidence").isNotNull(), F.concat(F.lit("   confidence "), F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%"))),
    )


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings by report section, in order: formatting, then structure with references, then text; passes are left out."""
    part = F.when(F.col("category") == "formatting", 1).when(F.col("category").isin("structure", "references"), 2).when(F.col("category").isin("language", "style", "content"), 3)
    w = W.partitionBy("doc_id", "part").orderBy(severity_rank(F.col("severity")), "rule_ord", "sub_ord")
    return findings.where("severity <> 'pass'").withColumn("part", part).where("part IS NOT NULL").withColumn("row", F.row_number().over(w))


def listed(findings: DataFrame, which: Column, most: int, line: Column) -> DataFrame:
    """doc_id, text and left_out: the first lines of the findings that fit, and how many more there are."""
    w = W.partitionBy("doc_id").orderBy(severity_rank(F.col("severity")), "rule_ord", "sub_ord")
    rows = findings.where(which).withColumn("row", F.row_number().over(w)).withColumn("line", line)
    shown = F.array_sort(F.collect_list(F.when(F.col("row") <= most, F.struct("row", "line"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(shown, lambda x: x["line"]), "\n\n").alias("text"), F.greatest(F.count("*") - most, F.lit(0)).alias("left_out"))


def errors_message(findings: DataFrame) -> DataFrame:
    return listed(findings, F.col("severity").isin("critical", "error"), MOST_ERRORS, finding_line(F.col("location")))


def advice_message(findings: DataFrame) -> DataFrame:
    return listed(findings, F.coalesce("suggestion", F.lit("")) != "", MOST_ADVICE, F.concat_ws("\n", F.concat(F.lit("• "), F.col("suggestion")), F.when(F.col("location") != "", F.concat(F.lit("  ("), F.col("location"), F.lit(")")))))


def summary_message(results: DataFrame) -> DataFrame:
    """doc_id and the short message on a result: score, counts, notes as message keys."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    counts = [F.concat(F.lit(f"{c}: "), n(c)) for c in ("critical", "errors", "warnings", "passed")]
    note = F.array_join(score_note(F.col("provisional"), ~F.col("provisional"), F.array().cast("array<string>")), "\n")
    origin = F.when(F.coalesce("preset_status", F.lit("")) != "department_verified", "pdf.unverified")
    score = F.concat(F.lit("score: "), score_over_100(F.col("score"), F.col("max_score")).cast("string"), F.lit("/100"))
    return results.select("doc_id", F.concat_ws("\n", score, *counts, note, origin).alias("text"))


def results_message(categories: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id and a line for each category in the order of scoring, then the total."""
    from folio.operators.scoring import SCORED

    place = F.array_position(F.array(*map(F.lit, SCORED)), F.col("category"))
    line = F.concat("category", F.lit(": "), category_value(F.col("earned_points"), F.col("max_points"), F.col("evaluated"), F.col("coverage")))
    each = categories.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    total = F.concat(F.lit("total: "), score_over_100(F.col("score"), F.col("max_score")).cast("string"), F.lit("/100"))
    return each.join(totals, "doc_id").select("doc_id", F.concat_ws("\n", "lines", total).alias("text"))


def print_text(c: Column | str, glyphs: list[tuple[int, int]] | None = None) -> Column:
    """Composed characters, line ends as spaces, controls and variation selectors dropped, markup escaped (P20).

    glyphs: the intervals of code points that the fonts show (fonts.shown_by); others become [U+XXXX]."""
    lows, highs = ([x[k] for x in glyphs or []] for k in (0, 1))

    def shown(c: str) -> str:
        at = bisect_right(lows, ord(c)) - 1
        return c if glyphs is None or at >= 0 and ord(c) <= highs[at] else f"[U+{ord(c):04X}]"

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        kept = (" " if c in "\n\r\t" else "" if unicodedata.category(c) in ("Cc", "Cf") or c in "\ufe0e\ufe0f" else shown(c) for c in unicodedata.normalize("NFC", t))
        return "".join(kept).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    @pandas_udf(StringType())
    def each(s: pd.Series) -> pd.Series:
        return s.map(one)

    return each(c)


@pandas_udf(StringType())
def compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def display_name(c: Column, most: int = 120, suffix_most: int = 16) -> Column:
    """A file name that is safe to show: unsafe runs become _, the stem is cut so that the suffix stays."""
    safe = F.regexp_replace(compatible(c), r'[\x00-\x1f\x7f/\\:*?"<>|]+', "_")
    suffix = F.regexp_extract(safe, r"[^.](\.[^.]+)$", 1)
    suffix = F.when(F.length(suffix) > suffix_most, "").otherwise(suffix)
    stem = F.left(safe, F.length(safe) - F.length(suffix))
    return F.concat(F.left(stem, F.lit(most) - F.length(suffix)), suffix)

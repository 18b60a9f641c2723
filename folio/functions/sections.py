"""Headings: which section they name, and their numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import collapse, once, strip, u

# Section keys in order of precedence, and the patterns that name them in Russian, Kazakh and English.
SECTION_PATTERNS: dict[str, tuple[str, ...]] = {
    "introduction": (r"введение", r"кіріспе", r"^introduction$"),
    "theoretical_part": (r"теоретическ\w*\s+част", r"глава\s*1\b", r"теоретическ\w*\s+обзор", r"теориялық\s+бөлім", r"әдебиеттерге\s+шолу", r"theoretical\s+part", r"literature\s+review", r"^chapter\s*1\b"),
    "practical_part": (r"практическ\w*\s+част", r"глава\s*2\b", r"экспериментальн\w*\s+част", r"практикалық\s+бөлім", r"тәжірибелік\s+бөлім", r"practical\s+part", r"experimental\s+part", r"^chapter\s*2\b"),
    "main_body": (r"основн\w*\s+част", r"негізгі\s+бөлім", r"^main\s+(part|body)$", r"^body$"),
    "conclusion": (r"заключение", r"выводы", r"қорытынды", r"^conclusion(s)?$"),
    "references": (r"список\s+(использованн\w*\s+)?(литератур\w*|источник\w*)", r"библиограф", r"пайдаланылған\s+әдебиеттер", r"әдебиеттер\s+тізімі", r"^references$", r"^bibliography$", r"^list\s+of\s+references$"),
    "appendix": (r"приложени", r"қосымша", r"^appendi(x|ces)$"),
    "abstract": (r"^аннотаци", r"^реферат\b", r"^аңдатпа", r"^түйін\b", r"^abstract$"),
    "content_table": (r"^содержание$", r"^оглавление$", r"^мазмұны$", r"^contents$", r"^table\s+of\s+contents$"),
}
# Forms of numbers, citations and entries, sections that go without a number, and names of heading styles.
NUMBER_PREFIX = r"^\s*(\d+(\.\d+)*\.?|[IVXLC]+\.)\s*"
CITATION = r"\[\s*\d+(\s*[,\-]\s*\d+)*\s*\]"
ENTRY_PREFIX = r"^\s*\d+[.\)]\s*"
REFERENCES_LINE = r"(?i)^(список|references|bibliography|әдебиеттер)\s"
#: Sections that are by custom not numbered.
UNNUMBERED = ("introduction", "conclusion", "references", "abstract", "appendix", "content_table")
#: Displayed names of built-in heading styles: English, Russian, Kazakh with and without its own letters.
HEADING_STYLES = (r"^heading\s*0*([1-9])$", r"^заголовок\s*0*([1-9])$", r"^тақырып\s*0*([1-9])$", r"^такырып\s*0*([1-9])$")


def normalized(c: Column) -> Column:
    return F.lower(collapse(c))


def section_key(normal: Column) -> Column:
    """The first key, in order, one of whose patterns is found in a normalized heading without its number; else null."""

    def named(bare: Column) -> Column:
        out = F.lit(None).cast("string")
        for key, patterns in reversed(SECTION_PATTERNS.items()):
            out = F.when(bare.rlike(u("|".join(f"(?:{p})" for p in patterns))), key).otherwise(out)
        return out

    return once(strip(F.regexp_replace(normal, u(NUMBER_PREFIX), "")), named)


def numbering(raw: Column) -> Column:
    """The number before a heading's text, without dots at its end; else null."""
    return F.nullif(F.rtrim(F.regexp_extract(raw, u(NUMBER_PREFIX), 1), F.lit(".")), F.lit(""))


def style_level(style_id: Column, style_name: Column) -> Column:
    """Outline level from 0 that a style's id, or else its displayed name, tells; else null."""
    level = lambda c, p: F.expr("null").cast("int") if c is None else F.try_to_number(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit("9")).cast("int") - 1
    name = F.lower(strip(style_name))
    return F.coalesce(level(F.replace(style_id, F.lit(" "), F.lit("")), r"(?i)^heading0*([1-9])$"), *(level(name, u(p)) for p in HEADING_STYLES))

"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import sections as S
from folio.functions.numbers import page_estimate
from folio.functions.text import is_blank, lines, sample_list, split_message, strip, word_count
from folio.operators import chunks, jobs, report, review, rules, scoring, views
from folio.plans import harness as H
from folio.session import table
from folio.sources import docx, relational, shared, uploads
from folio.streaming import checks as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_P = "SELECT doc_id, pos - 1 AS idx, ls[pos] AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(generate_series(1, len(ls))) AS t(pos)"
_BLANK = r"NOT regexp_matches(text, '[^\s\x0b\x1c-\x1f]')"


# Paragraphs and pages


@query(f"SELECT doc_id, idx::INT AS idx, length(text)::INT AS chars, {_BLANK} AS is_empty FROM ({_P})")
def q_paragraph_explode(spark, d):
    return H.paragraphs(docs(spark, d)).select("doc_id", "idx", F.length("text").alias("chars"), is_blank(F.col("text")).alias("is_empty"))


@query(f"SELECT doc_id, count(*) AS n_lines, sum(length(text))::BIGINT AS chars, md5(coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (NOT ({_BLANK})), '')) AS text_md5 FROM ({_P}) GROUP BY doc_id")
def q_line_stats(spark, d):
    p = H.paragraphs(docs(spark, d))
    counts = p.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars"))
    return counts.join(views.full_text(p), "doc_id", "left").select("doc_id", "n_lines", "chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


_PAGES = f"SELECT doc_id, greatest(1, round_even(sum(length(text)) / 2200.0, 0))::INT AS pages FROM ({_P}) GROUP BY doc_id"


@query(_PAGES)
def q_page_estimate(spark, d):
    p = H.paragraphs(docs(spark, d))
    return p.groupBy("doc_id").agg(page_estimate(F.sum(F.length("text"))).alias("pages"))


@query(f"SELECT doc_id, pages, 'too_many_pages' AS error_code FROM ({_PAGES}) WHERE pages > 3")
def q_page_limit_reject(spark, d):
    return q_page_estimate(spark, d).withColumn("error_code", docx.page_limit(F.col("pages"), 3)).where("error_code IS NOT NULL")


# Fonts; sources stand for font names and languages for documents

_USE = """SELECT lang, source AS name, sum(length(text))::BIGINT AS chars, min(doc_id) AS seen FROM documents WHERE regexp_matches(text, '\\S') GROUP BY lang, source"""
_RANKED = f"SELECT lang, name, chars, round_even((chars * 100.0 / sum(chars) OVER (PARTITION BY lang))::DOUBLE, 1) AS share, row_number() OVER (PARTITION BY lang ORDER BY chars DESC, seen)::INT AS rank FROM ({_USE})"


def _use(spark, d) -> DataFrame:
    runs = docs(spark, d).where(~is_blank(F.col("text"))).select("lang", F.col("source").alias("name"), F.lit(None).cast("double").alias("size"), F.length("text").alias("chars"), F.col("doc_id").alias("idx"), F.lit(0).alias("pos"))
    return views.font_use(runs, "lang")


@query(_RANKED)
def q_char_usage_breakdown(spark, d):
    return _use(spark, d).select("lang", "name", "chars", "share", "rank")


@query(f"SELECT lang, name, chars FROM ({_RANKED}) WHERE rank = 1")
def q_dominant_source(spark, d):
    return _use(spark, d).where("rank = 1").select("lang", "name", "chars")


@query(f"""WITH r AS ({_RANKED}), o AS (SELECT lang, round_even(100.0 - coalesce(sum(share) FILTER (name = 'src3'), 0), 1) AS away, max(name) FILTER (rank = 1) AS main FROM r GROUP BY lang)
SELECT lang AS doc_id, 'font.main' AS rule_id, CASE WHEN main = 'src3' THEN 'pass' ELSE 'error' END AS severity FROM o UNION ALL SELECT lang, 'font.mixed', 'warning' FROM o WHERE away > 94.5""")
def q_foreign_share_rule(spark, d):
    run = F.struct(F.col("text").alias("text"), F.col("source").alias("font_name"), F.lit(14.0).alias("font_size_pt"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("underline"), F.lit(None).cast("string").alias("color_rgb"))
    p = docs(spark, d).where(~is_blank(F.col("text"))).select(F.col("lang").alias("doc_id"), F.col("doc_id").cast("int").alias("idx"), "text", F.array(run).alias("runs"))
    return rules.font_rules(H.corpus(spark, p, font={"name": "src3", "max_foreign_font_share_pct": 94.5})).select("doc_id", "rule_id", "severity")


# Web pages as documents

_BLOCKS = rf"""SELECT page_id AS doc_id, pos - 1 AS idx, regexp_replace(b[pos], '<[^>]*>', '', 'g') AS text, b[pos] AS raw FROM (SELECT page_id, regexp_extract_all(html, '{H.BLOCK}') AS b FROM pages), unnest(generate_series(1, len(b))) AS t(pos)"""
_TEXT = r"regexp_matches(text, '\S')"


@query(f"SELECT doc_id, idx::INT AS idx, text FROM (SELECT *, min(CASE WHEN starts_with(raw, '<h1') AND {_TEXT} THEN idx END) OVER (PARTITION BY doc_id) AS first FROM ({_BLOCKS})) WHERE starts_with(raw, '<p') AND {_TEXT} AND idx >= coalesce(first, 0)")
def q_body_filter(spark, d):
    return views.placed(H.blocks(table(spark, d, "pages"))).where("is_body").select("doc_id", "idx", "text")


@query(rf"SELECT doc_id, idx::INT AS paragraph_index, trim(text) AS raw_text, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS normalized_text, 1 AS level FROM ({_BLOCKS}) WHERE starts_with(raw, '<h1') AND {_TEXT}")
def q_heading_blocks(spark, d):
    return views.headings(views.placed(H.blocks(table(spark, d, "pages")))).select("doc_id", "paragraph_index", "raw_text", "normalized_text", "level")


@query(f"SELECT p.page_id AS doc_id, CASE WHEN count(b.doc_id) = 0 THEN 'headings.none_found' ELSE 'headings.found' END AS rule_id, CASE WHEN count(b.doc_id) = 0 THEN 'critical' ELSE 'pass' END AS severity FROM pages p LEFT JOIN (SELECT * FROM ({_BLOCKS}) WHERE starts_with(raw, '<h1') AND {_TEXT}) b ON p.page_id = b.doc_id GROUP BY p.page_id")
def q_heading_presence(spark, d):
    pages = table(spark, d, "pages")
    found = rules.heading_rules(H.corpus(spark, H.blocks(pages), pages.select(F.col("page_id").alias("doc_id"))))
    return found.where("rule_id IN ('headings.found', 'headings.none_found')").select("doc_id", "rule_id", "severity")


# Numbers and levels; orders stand for documents, line numbers for heading numbers

_NUMBERS = "SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem"


def _numbers(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("number")).distinct().withColumn("paragraph_index", F.col("number"))


@query(f"SELECT doc_id, before, n AS number FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM ({_NUMBERS})) WHERE n <> before + 1")
def q_numbering_seq(spark, d):
    return rules.number_jumps(_numbers(spark, d)).select("doc_id", "before", "number")


@query(f"SELECT doc_id, before, n AS level FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM ({_NUMBERS})) WHERE n - before > 1")
def q_level_jump(spark, d):
    return rules.level_jumps(_numbers(spark, d).withColumnRenamed("number", "level")).select("doc_id", "before", "level")


@query(f"""WITH j AS (SELECT doc_id, before, n FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM ({_NUMBERS})) WHERE n <> before + 1)
SELECT doc_id, 'numbering.sequence' AS rule_id, before || ' -> ' || n AS actual FROM j
UNION ALL SELECT DISTINCT doc_id, 'numbering.ok', NULL FROM ({_NUMBERS}) WHERE doc_id NOT IN (SELECT doc_id FROM j)""")
def q_numbering_ok(spark, d):
    """Lines as top headings with their number before the title."""
    p = _numbers(spark, d).select("doc_id", F.col("number").alias("idx"), F.concat(F.col("number").cast("string"), F.lit(" Part")).alias("text"), F.lit(0).alias("outline_level"))
    return rules.numbering_rules(H.corpus(spark, p)).select("doc_id", "rule_id", "actual")


# Body formats; order lines stand for paragraphs, their quantities for what is off

_LINE = "SELECT l_orderkey AS doc_id, l_linenumber AS idx, min(l_quantity)::INT AS q, min(l_returnflag) AS f FROM lineitem GROUP BY ALL"
_FIRST10 = "array_to_string(list_transform(places[1:10], lambda i: (i + 1)::VARCHAR), ', ')"
_AT = f"CASE WHEN len(places) > 0 THEN 'Paragraphs ' || {_FIRST10} || CASE WHEN len(places) > 10 THEN ' (+' || (len(places) - 10) || ')' ELSE '' END ELSE '' END"


def _format_sql(test: str, rule: str, severity: str, only_bad: bool = False) -> str:
    return f"SELECT doc_id, '{rule}' AS rule_id, CASE WHEN len(places) > 0 THEN '{severity}' ELSE 'pass' END AS severity, {_AT} AS location FROM (SELECT doc_id, coalesce(list(idx ORDER BY idx) FILTER ({test}), []) AS places FROM ({_LINE}) GROUP BY doc_id)" + (" WHERE len(places) > 0" if only_bad else "")


@query(" UNION ALL ".join((_format_sql("q % 13 = 0", "font.paragraph_consistency", "warning", True), _format_sql("q % 5 = 0", "paragraph.line_spacing", "error"), _format_sql("q % 7 = 0", "paragraph.first_line_indent", "error"), _format_sql("f = 'R'", "paragraph.alignment", "warning"), _format_sql("q % 11 = 0", "paragraph.side_indent", "warning", True))))
def q_body_rules(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx")).agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("f"))
    off = lambda k, bad, good: F.when(F.col("q") % k == 0, bad).otherwise(good)
    run = F.struct(F.lit("words").alias("text"), off(13, "Arial", "Times New Roman").alias("font_name"), F.lit(14.0).alias("font_size_pt"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("underline"), F.lit(None).cast("string").alias("color_rgb"))
    p = p.select("doc_id", "idx", F.lit("words").alias("text"), off(5, 1.0, 1.5).alias("line_spacing"), off(7, 0.0, 1.25).alias("first_line_indent_cm"), off(11, 1.0, 0.0).alias("left_indent_cm"), F.when(F.col("f") == "R", "left").otherwise("justify").alias("alignment"), F.array(run).alias("runs"))
    return rules.body_rules(H.corpus(spark, p)).select("doc_id", "rule_id", "severity", "location")


# Style inheritance, with a cycle and explicit zeros

_STYLED = "s AS (SELECT p_partkey // 10 AS doc_id, p_partkey::VARCHAR AS style_id, CASE WHEN p_partkey % 10 = 0 THEN CASE WHEN p_size % 2 = 0 THEN p_partkey + 9 END ELSE p_partkey - 1 END::VARCHAR AS based_on, CASE WHEN p_size % 4 = 0 THEN p_size - 4 END::DOUBLE AS size FROM part)"


@query(f"""WITH RECURSIVE {_STYLED},
c AS (SELECT doc_id, style_id, 0 AS depth, style_id AS ancestor, based_on, [style_id] AS seen FROM s
  UNION ALL SELECT c.doc_id, c.style_id, depth + 1, s.style_id, s.based_on, list_append(seen, s.style_id) FROM c JOIN s ON c.doc_id = s.doc_id AND c.based_on = s.style_id WHERE NOT list_contains(seen, s.style_id))
SELECT c.doc_id, c.style_id, count(*) AS ancestors, arg_min(s.size, depth) FILTER (s.size IS NOT NULL)::DOUBLE AS size FROM c JOIN s ON c.doc_id = s.doc_id AND c.ancestor = s.style_id GROUP BY c.doc_id, c.style_id""")
def q_style_chain(spark, d):
    """Parts as styles, ten to a document, each based on the one before; half of the chains close to a ring, some lead out of the table."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    based = F.when(k % 10 == 0, F.when(F.col("p_size") % 2 == 0, k + 9)).otherwise(k - 1)
    s = p.select(F.call_function("div", k, F.lit(10)).alias("doc_id"), k.cast("string").alias("style_id"), based.cast("string").alias("based_on"), F.when(F.col("p_size") % 4 == 0, F.col("p_size") - 4).cast("double").alias("size"))
    chain = views.style_chain(s)
    n = chain.groupBy("doc_id", "style_id").agg(F.count("*").alias("ancestors"))
    return n.join(views.inherited(chain, s, "size"), ["doc_id", "style_id"])


_STYLE_IDS = ("'Heading' || p_size", "'heading 0' || p_size", "'Custom'", "NULL", "'Title'")
_STYLE_NAMES = ("'x'", "'Заголовок ' || p_size", "'Тақырып 0' || p_size", "'такырып' || p_size", "'Heading ' || p_size || 'a'", "' HEADING ' || p_size || ' '")
_NAMED = f"SELECT p_partkey, CASE p_partkey % 5 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(_STYLE_IDS))} END AS style_id, CASE p_partkey % 6 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(_STYLE_NAMES))} END AS style_name FROM (SELECT p_partkey, (p_size % 12)::VARCHAR AS p_size FROM part)"


@query(f"""SELECT p_partkey, coalesce(nullif(regexp_extract(replace(style_id, ' ', ''), '(?i)^heading0*([1-9])$', 1), ''),
  nullif(regexp_extract(lower(trim(style_name)), '^(?:heading|заголовок|тақырып|такырып)\\s*0*([1-9])$', 1), ''))::INT - 1 AS level FROM ({_NAMED})""")
def q_style_level(spark, d):
    """Styles named after parts."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 12).cast("string").alias("p_size"))
    pick = lambda each: scoring.chosen(F.col("p_partkey") % len(each), [F.expr(x) for x in each])
    return p.select("p_partkey", S.style_level(pick(_STYLE_IDS), pick(_STYLE_NAMES)).alias("level"))


# Sections; a user's turn opens one

_TURNS = r"SELECT conv_id AS doc_id, turn AS idx, text, CASE WHEN role = 'user' AND regexp_matches(text, '\S') THEN 'unnamed:' || turn END AS opens FROM conversations"
_ASSIGNED = f"SELECT doc_id, idx, text, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 'body') AS section FROM ({_TURNS})"


@query(f"SELECT doc_id, idx::INT AS idx, section FROM ({_ASSIGNED})")
def q_section_assign(spark, d):
    return views.placed(H.turns(table(spark, d, "conversations"))).select("doc_id", "idx", "section")


@query(f"SELECT doc_id, section, min(idx)::INT AS at, md5(string_agg(text, chr(10) ORDER BY idx)) AS text_md5 FROM ({_ASSIGNED}) WHERE regexp_matches(text, '\\S') GROUP BY doc_id, section")
def q_section_text(spark, d):
    return views.section_texts(views.placed(H.turns(table(spark, d, "conversations")))).select("doc_id", "section", "at", F.md5("text").alias("text_md5"))


HEADINGS = ("Введение", "1 Теоретическая часть", "Глава 1 Обзор", "Глава 1а", "2. Практическая  часть", "Кіріспе", "Қорытынды", "Выводы", "Список использованных источников", "References", "Пайдаланылған әдебиеттер", "I. Introduction", "Introduction", "Содержание", "Приложение А", "Реферат", "Рефераты", "2020 год", "Основная часть", "Conclusions", "Chapter 2", "Body", "Random heading")
_TITLED = f"SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_size || '. ' ELSE '' END || [{', '.join(f"'{t}'" for t in HEADINGS)}][p_partkey % {len(HEADINGS)} + 1] AS t FROM part"


def _sql_pattern(p: str) -> str:
    """Classes spelled out, and word ends after a letter or digit, as DuckDB's expressions need it."""
    return p.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")


_KEYS = " ".join(f"WHEN regexp_matches(bare, '{'|'.join(f'(?:{_sql_pattern(p)})' for p in ps)}') THEN '{k}'" for k, ps in S.SECTION_PATTERNS.items())
_PREFIX = S.NUMBER_PREFIX


@query(f"""SELECT id, CASE {_KEYS} END AS section_key, nullif(rtrim(regexp_extract(t, '{_PREFIX}', 1), '.'), '') AS numbering
FROM (SELECT id, t, trim(regexp_replace(lower(regexp_replace(trim(t), '\\s+', ' ', 'g')), '{_PREFIX}', '')) AS bare FROM ({_TITLED}))""")
def q_section_key_match(spark, d):
    """Parts as headings, some numbered."""
    size, title = F.col("p_size"), F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("p_partkey") % len(HEADINGS) + 1).cast("int"))
    h = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit(". "))).otherwise(""), title).alias("t"))
    return h.select("id", S.section_key(S.normalized(F.col("t"))).alias("section_key"), S.numbering(strip(F.col("t"))).alias("numbering"))


_NAMES = ("[Content_Types].xml", "word/document.xml", "word/styles.xml", "word/media/a.png", "word/../x", "c:/x", "/etc/x")
_ARCHIVES = f"""SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber <= 2 AND l_partkey % 8 > 0 THEN [{", ".join(f"'{n}'" for n in _NAMES[:2])}][l_linenumber] WHEN l_partkey % 11 < 5 THEN [{", ".join(f"'{n}'" for n in _NAMES[2:])}][l_partkey % 11 + 1] ELSE 'word/' || l_linenumber || '.xml' END AS name,
  l_suppkey::BIGINT * CASE WHEN l_partkey % 7 = 0 THEN 5000000 ELSE 100 END AS size, l_suppkey::BIGINT * CASE WHEN l_partkey % 13 = 0 THEN 0 WHEN l_partkey % 7 = 0 THEN 4000000 ELSE 40 END AS packed, CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 8 END AS flags FROM lineitem"""


@query(f"""SELECT doc_id, CASE WHEN count(*) > 2000 THEN 'too many parts' WHEN sum(size) > 100 * 1048576 THEN 'archive too large'
  WHEN bool_or(starts_with(replace(name, chr(92), '/'), '/') OR contains(name, ':') OR list_contains(string_split(replace(name, chr(92), '/'), '/'), '..') OR flags & 1 = 1) THEN 'unsafe or encrypted part'
  WHEN bool_or(size > 32 * 1048576) THEN 'part too large' WHEN bool_or(size > greatest(1, packed)::BIGINT * 200) THEN 'compressed too much' WHEN count(DISTINCT name) <> count(*) THEN 'part twice'
  WHEN NOT bool_or(name = '[Content_Types].xml') AND NOT bool_or(name = 'word/document.xml') THEN 'missing parts: [Content_Types].xml, word/document.xml'
  WHEN NOT bool_or(name = '[Content_Types].xml') THEN 'missing parts: [Content_Types].xml' WHEN NOT bool_or(name = 'word/document.xml') THEN 'missing parts: word/document.xml' END AS reason
FROM ({_ARCHIVES}) GROUP BY doc_id""")
def q_container_reasons(spark, d):
    """Orders as archives, their lines as parts."""
    n, k, size = F.col("l_linenumber").cast("int"), F.col("l_partkey"), F.col("l_suppkey").cast("long")
    names = lambda each, at: F.element_at(F.array(*map(F.lit, each)), at.cast("int"))
    name = F.when((n <= 2) & (k % 8 > 0), F.try_element_at(F.array(*map(F.lit, _NAMES[:2])), n)).when(k % 11 < 5, names(_NAMES[2:], F.least(k % 11, F.lit(4)) + 1)).otherwise(F.concat(F.lit("word/"), n.cast("string"), F.lit(".xml")))
    parts = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), name.alias("name"), (size * F.when(k % 7 == 0, 5_000_000).otherwise(100)).alias("file_size"),
        (size * F.when(k % 13 == 0, 0).when(k % 7 == 0, 4_000_000).otherwise(40)).alias("compress_size"), F.when(k % 29 == 0, 1).otherwise(8).alias("flag_bits"),
    )
    return uploads.container_reasons(parts)


# Words, references, citations

_LINES = r"regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e]')"


@query(r"SELECT doc_id, 'structure.min_words.introduction' AS rule_id, 'warning' AS severity, '>= 250' AS expected, n::VARCHAR AS actual FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents) WHERE n < 250")
def q_min_words(spark, d):
    """Documents as introductions."""
    found = rules.completeness_rules(H.corpus(spark, H.under_heading(H.paragraphs(docs(spark, d)), "Introduction")))
    return found.where("rule_id LIKE 'structure.%'").select("doc_id", "rule_id", "severity", "expected", "actual")


_ENTRIES = r"""SELECT doc_id, list_filter(list_filter(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> trim(string_split(coalesce(text, ''), chr(10))[1], ' ' || chr(9) || chr(13))),
  lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: regexp_matches(x, '^\s*\d+[.\)]\s*') OR length(x) > 15), lambda x: NOT regexp_matches(x, '(?i)^(список|references|bibliography|әдебиеттер)\s')) AS e FROM documents"""


def _entries(spark, d) -> DataFrame:
    return docs(spark, d).select("doc_id", rules.reference_entries(F.col("text"), F.get(lines(F.col("text")), F.lit(0))).alias("e"))


@query(f"SELECT doc_id, len(e)::INT AS n, len(list_filter(e, lambda x: length(x) < 30))::INT AS n_short FROM ({_ENTRIES})")
def q_ref_entries(spark, d):
    return _entries(spark, d).select("doc_id", F.size("e").alias("n"), F.size(F.filter("e", lambda x: F.length(x) < 30)).alias("n_short"))


@query(rf"SELECT doc_id, (len(k) - len(list_distinct(k)))::INT AS n FROM (SELECT doc_id, list_transform(e, lambda x: trim(regexp_replace(regexp_replace(lower(x), '^\s*\d+[.\)]\s*', ''), '\s+', ' ', 'g'))) AS k FROM ({_ENTRIES})) WHERE len(k) > len(list_distinct(k))")
def q_ref_duplicates(spark, d):
    return _entries(spark, d).select("doc_id", rules.duplicate_entries(F.col("e")).alias("n")).where("n > 0")


@query(rf"""WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, '') || repeat(' as shown [' || doc_id || '], [2, 3] or [4-6], not [a]', (doc_id % 3)::INT), '{S.CITATION}')) AS n FROM documents)
SELECT doc_id, 'references.missing' AS rule_id, 'critical' AS severity, 'No references section' AS message FROM c
UNION ALL SELECT doc_id, 'references.in_text_citations', CASE WHEN n = 0 THEN 'warning' ELSE 'info' END, CASE WHEN n = 0 THEN 'No citations in the text' ELSE n || ' citations' END FROM c""")
def q_citation_count(spark, d):
    """Documents that cite by their id, under one heading."""
    cited = F.concat(F.lit(" as shown ["), F.col("doc_id").cast("string"), F.lit("], [2, 3] or [4-6], not [a]"))
    p = docs(spark, d).select("doc_id", F.lit(0).alias("idx"), F.concat(F.coalesce("text", F.lit("")), F.repeat(cited, (F.col("doc_id") % 3).cast("int"))).alias("text"))
    return rules.reference_rules(H.corpus(spark, H.under_heading(p, "Introduction"))).select("doc_id", "rule_id", "severity", "message")


_LISTED = r"""SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND x <> 'References'), lambda x: x),
  lambda x: (regexp_matches(x, '^\s*\d+[.\)]\s*') OR length(x) > 15) AND NOT regexp_matches(x, '(?i)^(список|references|bibliography|әдебиеттер)\s')) AS e FROM documents"""


@query(rf"""WITH l AS (SELECT doc_id, len(e) AS n, len(e) - len(list_distinct(list_transform(e, lambda x: trim(regexp_replace(regexp_replace(lower(x), '^\s*\d+[.\)]\s*', ''), '\s+', ' ', 'g'))))) AS twice, len(list_filter(e, lambda x: length(x) < 15)) AS short FROM ({_LISTED}))
SELECT doc_id, CASE WHEN n < 15 THEN 'references.min_count' ELSE 'references.count' END AS rule_id, CASE WHEN n < 15 THEN 'error' ELSE 'info' END AS severity, CASE WHEN n < 15 THEN 'Too few sources' ELSE n || ' sources' END AS message FROM l
UNION ALL SELECT doc_id, 'references.duplicates', 'warning', twice || ' repeated sources' FROM l WHERE twice > 0
UNION ALL SELECT doc_id, 'references.suspicious_entries', 'warning', short || ' very short sources' FROM l WHERE short > 0
UNION ALL SELECT doc_id, 'references.in_text_citations', 'warning', 'No citations in the text' FROM l""")
def q_reference_rules(spark, d):
    """Documents as lists of references."""
    found = rules.reference_rules(H.corpus(spark, H.under_heading(H.paragraphs(docs(spark, d)), "References")))
    return found.select("doc_id", "rule_id", "severity", "message")


# Margins; parts stand for pages


@query("""SELECT doc_id, 'margins.' || side || '_margin' AS rule_id, CASE WHEN abs(actual - expected) <= 1.5 THEN 'pass' ELSE 'error' END AS severity, 'Section 1: ' || side || ' margin' AS location
FROM (SELECT p_partkey AS doc_id, unnest(['left', 'right', 'top', 'bottom']) AS side, unnest([p_size, p_size - 20, p_size - 10, p_size - 10]) AS actual, unnest([30, 10, 20, 20]) AS expected FROM part)""")
def q_margin_unpivot(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size").cast("double")
    pages = p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("section_no"), F.lit(210.0).alias("page_width_mm"), F.lit(297.0).alias("page_height_mm"), F.lit("portrait").alias("orientation"), size.alias("margin_left_mm"), (size - 20).alias("margin_right_mm"), (size - 10).alias("margin_top_mm"), (size - 10).alias("margin_bottom_mm"))
    own = p.select(F.col("p_partkey").alias("doc_id"), F.lit("base").alias("preset_id"))
    found = rules.page_rules(rules.Corpus(own, pages, pages, H.presets(spark)))
    return found.where("rule_id like 'margins.%'").select("doc_id", "rule_id", "severity", "location")


@query(f"""SELECT doc_id, array_to_string(list_transform(places[1:10], lambda i: (i + 1)::VARCHAR), ', ') || CASE WHEN len(places) > 10 THEN ' (+' || (len(places) - 10) || ')' ELSE '' END AS location
FROM (SELECT doc_id, list(idx ORDER BY idx) AS places FROM ({_P}) WHERE length(text) < 40 GROUP BY doc_id)""")
def q_sample_list(spark, d):
    p = H.paragraphs(docs(spark, d)).where(F.length("text") < 40)
    return p.groupBy("doc_id").agg(F.array_sort(F.collect_list("idx")).alias("at")).select("doc_id", sample_list(F.col("at")).alias("location"))


# Findings and scores

_RULES = r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n_words, length(replace(coalesce(text, ''), chr(10), '')) AS chars, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents"""
_FOUND = f"""SELECT doc_id, 0 AS ord, 'structure' AS category, 'error' AS severity, 'text.short' AS rule_id, 'Too few words' AS message FROM ({_RULES}) WHERE n_words < 50
UNION ALL SELECT doc_id, 1, 'formatting', 'warning', 'text.repeated', (len(ls) - len(list_distinct(ls))) || ' repeated lines' FROM ({_RULES}) WHERE len(ls) > len(list_distinct(ls))
UNION ALL SELECT doc_id, 2, 'content', 'critical', 'text.long', 'Longer than a page' FROM ({_RULES}) WHERE chars > 2200"""
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END"


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}, ord)::INT AS seq, severity, rule_id, message FROM ({_FOUND})")
def q_findings_union(spark, d):
    return rules.ordered(H.text_findings(docs(spark, d))).select("doc_id", "seq", "severity", "rule_id", "message")


@query(f"SELECT doc_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'pass') AS passed FROM ({_FOUND}) GROUP BY doc_id")
def q_summary(spark, d):
    return scoring.summary(H.text_findings(docs(spark, d)), "doc_id")


@query(f"SELECT doc_id, rule_id, CASE WHEN rule_id = 'text.long' THEN 'info' ELSE severity END AS severity FROM ({_FOUND})")
def q_advisory(spark, d):
    return rules.advised(H.text_findings(docs(spark, d)), H.presets(spark)).select("doc_id", "rule_id", "severity")


_POINTS = f"SELECT d.doc_id, 20 * (10000 - 1500 * count(f.rule_id) FILTER (f.rule_id = 'text.short')) AS structure, 30 * (10000 - 500 * count(f.rule_id) FILTER (f.rule_id = 'text.repeated')) AS formatting FROM documents d LEFT JOIN ({_FOUND}) f USING (doc_id) GROUP BY d.doc_id"


def _scored(spark, d, coverage=None) -> DataFrame:
    own = docs(spark, d).select("doc_id", F.lit("base").alias("preset_id"))
    return scoring.category_scores(own, H.text_findings(docs(spark, d)), H.presets(spark), coverage)


@query(f"SELECT doc_id, round((structure + formatting) / 10000.0 / 50 * 100, 1)::DOUBLE AS score, 50.0::DOUBLE AS evaluated_max_score, true AS provisional FROM ({_POINTS})")
def q_score_two_level(spark, d):
    return scoring.totals(_scored(spark, d)).select("doc_id", "score", "evaluated_max_score", "provisional")


@query(f"""SELECT doc_id, round((structure + formatting + coalesce(extra, 0)) / 10000.0 / CASE WHEN extra IS NULL THEN 50 ELSE 75 END * 100, 1)::DOUBLE AS score, CASE WHEN extra IS NULL THEN 50 ELSE 75 END::DOUBLE AS evaluated_max_score
FROM ({_POINTS}) LEFT JOIN (SELECT doc_id, max(250000) AS extra FROM labels WHERE quality = 1 GROUP BY doc_id) USING (doc_id)""")
def q_score_normalised(spark, d):
    cover = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("content").alias("category"), F.lit(1.0).alias("coverage")).distinct()
    return scoring.totals(_scored(spark, d, cover)).select("doc_id", "score", "evaluated_max_score")


@query(f"SELECT doc_id, category, 'rule_engine:' || rule_id AS criterion, CASE rule_id WHEN 'text.short' THEN 3.0 ELSE 1.5 END::DOUBLE AS points, message AS label FROM ({_FOUND}) WHERE rule_id <> 'text.long'")
def q_deduction_labels(spark, d):
    c = _scored(spark, d).select("doc_id", "category", F.explode("deductions").alias("criterion", "points"), "deduction_labels")
    return c.select("doc_id", "category", "criterion", "points", F.try_element_at("deduction_labels", F.col("criterion")).alias("label"))


@query("""SELECT doc_id, 'ai:poor quality' AS criterion, CASE WHEN bool_or(toxic = 1) THEN 1500 ELSE 750 END::BIGINT AS basis_points FROM labels WHERE quality = 0 GROUP BY doc_id""")
def q_ai_confidence_penalty(spark, d):
    text = F.lit(None).cast("string")
    sure = F.when(F.col("toxic") == 1, 1.0).otherwise(0.5)
    f = table(spark, d, "labels").where("quality = 0").select("doc_id", F.lit("base").alias("preset_id"), F.lit("content").alias("category"), F.lit("error").alias("severity"), F.lit("ai").alias("source"), text.alias("rule_id"), F.lit(" Poor quality").alias("message"), sure.alias("confidence"))
    return scoring.penalties(f, H.presets(spark)).select("doc_id", "criterion", F.round(F.col("fraction") * 10000).cast("long").alias("basis_points"))


# Review: turns of users are chunks, an assistant's next turn is the answer

_ASKED = r"SELECT conv_id AS doc_id, len(regexp_extract_all(text, '\S+')) AS w, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant', false) AS ok, role FROM conversations"


@query(f"SELECT doc_id, c.category, (sum(CASE WHEN ok AND (c.category <> 'style' OR w > 20) THEN w ELSE 0 END)::DOUBLE / sum(w)) AS coverage FROM ({_ASKED}) CROSS JOIN (SELECT unnest(['language', 'style', 'content']) AS category) c WHERE role = 'user' AND w > 0 GROUP BY doc_id, c.category")
def q_ai_coverage(spark, d):
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations").withColumn("next", F.lead("role").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    n = word_count(F.col("text"))
    every, some = F.array(F.lit("language"), F.lit("style"), F.lit("content")), F.array(F.lit("language"), F.lit("content"))
    done = F.when(F.coalesce(F.col("next") == "assistant", F.lit(False)), F.when(n > 20, every).otherwise(some))
    return review.coverage(c.select(F.col("conv_id").alias("doc_id"), n.alias("word_count"), done.alias("evaluated_categories")).where("word_count > 0"))


_CHUNKS = r"""SELECT doc_id, i AS chunk_index, CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(w[i * 50 + 1:i * 50 + 50], ' ') END AS text, len(w[i * 50 + 1:i * 50 + 50]) AS word_count, source
FROM (SELECT doc_id, text, source, regexp_extract_all(text, '\S+') AS w FROM documents), unnest(generate_series(0, (len(w) + 49) // 50 - 1)) AS t(i) WHERE len(w) > 0"""


def _chunks(spark, d) -> DataFrame:
    return chunks.chunked(docs(spark, d).select("doc_id", "source", "text"), 50, ("doc_id", "source"))


@query(f"SELECT doc_id, chunk_index::INT AS chunk_index, word_count::INT AS word_count, md5(text) AS text_md5 FROM ({_CHUNKS})")
def q_chunk_words(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk_index", "word_count", F.md5("text").alias("text_md5"))


@query(f"SELECT source, doc_id, chunk_index::INT AS chunk_index, row_number() OVER (PARTITION BY source ORDER BY chunk_index, doc_id)::INT AS turn FROM ({_CHUNKS})")
def q_chunk_interleave(spark, d):
    return chunks.interleaved(_chunks(spark, d), "doc_id", "source").select("source", "doc_id", "chunk_index", "turn")


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS turn, floor(word_count / 0.75)::BIGINT AS cost FROM ({_CHUNKS})),
f AS (SELECT doc_id, turn, chunk_index, cost <= 150 AS kept, CASE WHEN cost <= 150 THEN cost ELSE 0 END AS used FROM c WHERE turn = 1
  UNION ALL SELECT c.doc_id, c.turn, c.chunk_index, used + cost <= 150, CASE WHEN used + cost <= 150 THEN used + cost ELSE used END FROM f JOIN c ON c.doc_id = f.doc_id AND c.turn = f.turn + 1)
SELECT doc_id, chunk_index::INT AS chunk_index FROM f WHERE kept""")
def q_budget_fold(spark, d):
    return chunks.within_budget(_chunks(spark, d).withColumn("section", F.lit("body")), 150).select("doc_id", "chunk_index")


ANSWERS = [
    (1, '{"errors": [], "evaluated_categories": ["language", "style"]}'),
    (2, '```json\n{"errors": [{"category": "Grammar", "severity": "FATAL", "explanation": "x", "original_text": "q"}], "evaluated_categories": ["content"]}\n```'),
    (3, '{"errors": []}'),
    (4, '{"errors": [], "evaluated_categories": ["language", "language"]}'),
    (5, '{"errors": [], "evaluated_categories": ["language"], "more": 1}'),
    (6, "not json"),
    (7, '{"errors": [{"category": "style", "severity": "error", "explanation": "y", "confidence": 1.5}], "evaluated_categories": ["style"]}'),
    (8, '{"errors": [{"category": " STYLE ", "severity": "error", "explanation": "y", "confidence": 0.25}], "evaluated_categories": ["style"]}'),
]


@query(f"""WITH a AS (SELECT id, CASE WHEN starts_with(t, '```') THEN trim(replace(replace(t, '```json', ''), '```', ''), chr(10)) ELSE t END AS j FROM (SELECT event_id AS id, replace(t, 'explanation": "', 'explanation": "' || event_type) AS t FROM events JOIN {H.sql_values(ANSWERS, "k, t")} ON k = event_id % 8 + 1)),
v AS (SELECT id, j FROM a WHERE json_valid(j)),
k AS (SELECT id, j, list_sort(json_keys(j)) AS keys, json_extract_string(j, '$.evaluated_categories[*]') AS done, json_extract(j, '$.errors[*]') AS errors FROM v),
ok AS (SELECT * FROM k WHERE keys = ['errors', 'evaluated_categories'] AND len(done) > 0 AND len(list_distinct(done)) = len(done) AND len(list_filter(errors, lambda e: coalesce(json_extract_string(e, '$.confidence')::DOUBLE, 0.5) NOT BETWEEN 0 AND 1)) = 0)
SELECT a.id, ok.id IS NOT NULL AS is_valid, len(ok.errors)::INT AS n_errors,
  CASE WHEN lower(trim(json_extract_string(ok.errors[1], '$.category'))) IN ('language', 'style', 'content', 'structure') THEN lower(trim(json_extract_string(ok.errors[1], '$.category'))) WHEN len(ok.errors) > 0 THEN 'content' END AS category,
  CASE WHEN len(ok.errors) > 0 THEN coalesce(json_extract_string(ok.errors[1], '$.confidence')::DOUBLE, 0.5) END AS confidence FROM a LEFT JOIN ok USING (id)""")
def q_ai_response_parse(spark, d):
    """One answer to each event, of eight kinds."""
    answer = F.element_at(F.array(*(F.lit(t) for _, t in ANSWERS)), (F.col("event_id") % 8 + 1).cast("int"))
    told = F.replace(answer, F.lit('explanation": "'), F.concat(F.lit('explanation": "'), F.col("event_type")))
    p = review.parsed(table(spark, d, "events").select(F.col("event_id").alias("id"), told.alias("answer")))
    e = F.get("errors", F.lit(0))
    return p.select("id", "is_valid", F.when(F.col("is_valid"), F.size("errors")).alias("n_errors"), e["category"].alias("category"), e["confidence"].alias("confidence"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, len(json_keys(props))::INT AS n_keys FROM events")
def q_event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("props")).alias("n_keys"))


# Jobs; customers are users, orders are checks, order lines are findings


@query("SELECT o_custkey AS user_id, o_orderkey AS check_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 10")
def q_user_history_top10(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("check_id"), "o_orderdate")
    return jobs.latest_per(o, "user_id", [F.desc("o_orderdate"), F.desc("check_id")]).select("user_id", "check_id", "rank")


@query("SELECT o_orderkey AS check_id, o_orderpriority AS filename FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def q_history_of_owner(spark, d):
    o = table(spark, d, "orders")
    return jobs.history(H.as_checks(o), H.as_uploads(o), F.col("user_id") == 7).select("check_id", "filename")


@query("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def q_owner_semi(spark, d):
    owners = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return jobs.owned(H.as_uploads(table(spark, d, "orders")), owners, "user_id", "c_custkey").select("id", "user_id")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_orphan_anti(spark, d):
    return jobs.orphans(H.as_uploads(table(spark, d, "orders")), table(spark, d, "lineitem"), "id", "l_orderkey").select("id")


_NOW = "TIMESTAMP '1998-08-01 12:00:00'"


@query(f"SELECT o_custkey AS user_id, count(*) FILTER (o_orderdate >= date_trunc('day', {_NOW})) AS today, count(*) FILTER (o_orderstatus <> 'F') AS active FROM orders GROUP BY o_custkey")
def q_active_quota(spark, d):
    o = table(spark, d, "orders")
    return jobs.counts(H.as_checks(o), H.as_uploads(o), F.lit("1998-08-01 12:00:00").cast("timestamp"))


_BUSY = "(h.done IS NULL OR h.done > ts)"
_TODAY = "date_trunc('day', h.ts) = date_trunc('day', ts)"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts::TIMESTAMP AS ts, CASE WHEN event_id % 3 > 0 THEN ts::TIMESTAMP + INTERVAL 6 HOUR END AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::STRUCT(ts TIMESTAMP, done TIMESTAMP)[] AS held, false AS ok FROM e
  UNION ALL SELECT user_id, n, event_id, CASE WHEN ok THEN list_append(held, {{'ts': ts, 'done': done}}) ELSE held END, ok
  FROM (SELECT *, len(list_filter(held, lambda h: {_BUSY})) < 2 AND len(list_filter(held, lambda h: {_TODAY})) < 3 AS ok
    FROM (SELECT s.user_id, e.n, e.event_id::BIGINT AS event_id, e.ts, e.done, list_filter(s.held, lambda h: {_BUSY.replace(" ts", " e.ts")} OR {_TODAY.replace(", ts)", ", e.ts)")}) AS held FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
SELECT event_id AS request_id, user_id, ok AS is_admitted FROM s WHERE n > 0""")
def q_admission(spark, d):
    """Folded in the order of events."""
    e = table(spark, d, "events").select(F.col("event_id").alias("request_id"), "user_id", "ts", F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("ts") + F.make_dt_interval(hours=F.lit(6))).alias("done_at"))
    return jobs.admitted(e, jobs.Limits(per_day=3, active=2)).select("request_id", "user_id", "is_admitted")


def _last_of_users(checks: DataFrame) -> DataFrame:
    return checks.groupBy((F.col("user_id") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("SELECT o_custkey % 10 AS bucket, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY ALL")
def q_relational(spark, d):
    """Checks written to a database that the session carries, and read again by ranges of the key; conditions reach the database.

    In one JVM it is a Derby in memory, through JDBC; executors can't reach that one, so on a cluster it is a file that all share."""
    rows = H.as_checks(table(spark, d, "orders")).join(H.as_uploads(table(spark, d, "orders")).select("id", "user_id"), "id").select("id", "user_id", "status", F.col("score").cast("double").alias("score"))
    if not shared.one_jvm(spark):
        file = shared.database(spark)
        shared.created(rows, file, "checks", "id")
        shared.save(rows, file, "checks")
        return _last_of_users(shared.load(spark, file, "checks", "id", "id bigint, user_id bigint", "status = 'completed' AND score > 1000", rows=2000))
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    db = relational.Database(f"jdbc:derby:memory:{uuid.uuid4().hex};create=true")
    relational.created(rows, db, "checks", "id", compared=("status",))
    relational.save(rows, db, "checks")
    kept = relational.load(spark, db, "checks", "id", rows=2000).where((F.col("status") == "completed") & (F.col("score") > 1000))
    return _last_of_users(kept)


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS completed, round(avg(o_totalprice) FILTER (o_orderstatus = 'F' AND o_orderkey % 2 = 0), 1) AS mean_score, (SELECT count(*) FROM customer) AS users FROM orders")
def q_admin_stats(spark, d):
    return jobs.statistics(H.as_checks(table(spark, d, "orders")), table(spark, d, "customer"))


@query("SELECT o_orderkey AS check_id FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderkey % 3 = 1)) ORDER BY 1 LIMIT 100")
def q_dispatch_topk(spark, d):
    return jobs.dispatchable(H.as_checks(table(spark, d, "orders")))


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderdate < {_NOW} - INTERVAL 960 SECOND THEN 'pending' ELSE 'running' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus = 'F' AND o_orderdate < {_NOW} - INTERVAL 960 SECOND THEN 'pending' ELSE 'sending' END WHEN o_orderkey % 3 = 1 THEN 'pending' ELSE 'sent' END AS delivery_status FROM orders""")
def q_stale_recovery(spark, d):
    return jobs.recovered(H.as_checks(table(spark, d, "orders")), F.lit("1998-08-01 12:00:00").cast("timestamp")).select("id", "status", "delivery_status")


_CUT = "TIMESTAMP '1996-06-01 00:00:00'"


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderdate < {_CUT} - INTERVAL 24 HOUR THEN 'failed' ELSE 'pending' END ELSE 'running' END AS status FROM orders
WHERE NOT coalesce(o_orderstatus = 'F' AND o_orderdate < {_CUT} - INTERVAL 30 DAY AND o_orderkey % 3 <> 0, false)""")
def q_retention(spark, d):
    now = F.lit("1996-06-01 00:00:00").cast("timestamp")
    return jobs.retained(jobs.expired(H.as_checks(table(spark, d, "orders")), now), now).select("id", "status")


_KINDS = {"signup": "submit", "view": "claim", "error": "error", "purchase": "complete", "click": "send"}


_STEP = {
    "status": "CASE WHEN kind = 'submit' AND status = 'new' THEN 'pending' WHEN kind = 'claim' AND status = 'pending' THEN 'running' WHEN kind = 'complete' AND status IN ('running', 'pending') THEN 'completed' WHEN kind = 'error' AND status = 'running' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END",
    "attempts": "CASE WHEN kind = 'submit' AND status = 'new' THEN 0 WHEN kind = 'claim' AND status = 'pending' THEN attempts + 1 ELSE attempts END",
    "delivery": "CASE WHEN kind = 'complete' AND status IN ('running', 'pending') THEN 'pending' WHEN kind = 'send' AND status = 'completed' AND delivery = 'pending' THEN 'sending' ELSE delivery END",
    "delivery_attempts": "CASE WHEN kind = 'send' AND status = 'completed' AND delivery = 'pending' THEN delivery_attempts + 1 ELSE delivery_attempts END",
}


@query(f"""WITH RECURSIVE k AS (SELECT user_id AS check_id, ts, coalesce(CASE {" ".join(f"WHEN event_type = '{a}' THEN '{b}'" for a, b in _KINDS.items())} END, '') AS kind FROM events),
e AS (SELECT check_id, kind, row_number() OVER (PARTITION BY check_id ORDER BY ts, kind) AS n FROM k),
s AS (SELECT DISTINCT check_id, 0::BIGINT AS n, 'new' AS status, 0 AS attempts, 'none' AS delivery, 0 AS delivery_attempts FROM e
  UNION ALL SELECT s.check_id, e.n, {", ".join(_STEP.values())} FROM s JOIN e ON e.check_id = s.check_id AND e.n = s.n + 1)
SELECT check_id, {", ".join(f"arg_max({c}, n) AS {c}" for c in _STEP)} FROM s GROUP BY check_id""")
def q_state_machine(spark, d):
    """The streaming state machine over a table of events."""
    e = table(spark, d, "events")
    return stream.states_batch(e.select(F.col("user_id").alias("check_id"), scoring.lookup(F.col("event_type"), _KINDS).alias("kind"), "ts"))


@query("SELECT DISTINCT user_id AS check_id, 'check:' || user_id AS job_id FROM events")
def q_dedup_jobs(spark, d):
    return jobs.queued(table(spark, d, "events").select(F.col("user_id").alias("check_id"))).select("check_id", "job_id")


@query("""SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"status":"' || CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END || '","findings":[' ||
  coalesce(string_agg('{"category":"' || l_returnflag || '","severity":"' || l_linestatus || '","rule_id":"' || l_partkey || '","message":"' || l_suppkey || '"}', ',' ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey::VARCHAR, l_suppkey::VARCHAR) FILTER (l_orderkey IS NOT NULL), '') || ']}' AS json
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def q_check_json(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("check_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("severity"), F.col("l_partkey").cast("string").alias("rule_id"), F.col("l_suppkey").cast("string").alias("message"))
    return jobs.check_json(H.as_checks(table(spark, d, "orders")).withColumn("score", F.lit(None).cast("double")), found)


# Papers: order lines as headings with a paragraph each

_TITLES = ("Introduction", "1 Part", "2 Part", "Conclusion", "References")
_PAPER = f"""l AS (SELECT l_orderkey AS doc_id, l_linenumber::INT AS n, min(l_partkey) % 5 AS k, (min(l_suppkey) % 3)::INT + 1 AS lvl, min(l_quantity)::INT AS q, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
p AS (SELECT doc_id, 2 * n AS idx, true AS head, lvl, q, f, [{", ".join(f"'{t}'" for t in _TITLES)}][k + 1] AS text, CASE k WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS words FROM l
  UNION ALL SELECT doc_id, 2 * n + 1, false, NULL, q, f, NULL, q + 1 FROM l),
h AS (SELECT *, CASE text WHEN 'Introduction' THEN 'introduction' WHEN 'Conclusion' THEN 'conclusion' WHEN 'References' THEN 'references' END AS key, CASE WHEN text LIKE '% Part' THEN text[1]::INT END AS num FROM p)"""


def _papers(spark, d, **changed) -> rules.Corpus:
    # Dealt by document before lines become paragraphs: the grouping and all windows and groups by doc_id after it need no exchange.
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").repartition("l_orderkey")
    li = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("n"))
    li = li.agg((F.min("l_partkey") % 5).alias("k"), (F.min("l_suppkey") % 3).cast("int").alias("level"), F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("f"))
    body = F.concat(F.repeat(F.lit("word "), F.col("q")), (2 * F.col("n") + 1).cast("string"))
    run = lambda text, bold: F.array(F.struct(text.alias("text"), F.lit("Times New Roman").alias("font_name"), F.lit(14.0).alias("font_size_pt"), bold.alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("underline"), F.lit(None).cast("string").alias("color_rgb")))
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("k") + 1).cast("int"))
    none = F.lit(None)
    each = F.explode(
        F.array(
            F.struct((2 * F.col("n")).alias("idx"), title.alias("text"), F.col("level").alias("outline_level"), F.lit(1.5).alias("line_spacing"), (F.col("q") % 4 == 0).alias("page_break_before"), run(title, F.col("f") == "R").alias("runs")),
            F.struct((2 * F.col("n") + 1).alias("idx"), body.alias("text"), none.cast("int").alias("outline_level"), F.when(F.col("q") % 5 == 0, 1.0).otherwise(1.5).alias("line_spacing"), F.lit(False).alias("page_break_before"), run(body, F.lit(False)).alias("runs")),
        )
    ).alias("p")
    return H.corpus(spark, li.select("doc_id", each).select("doc_id", "p.*"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")), **changed)


@query(f"""WITH {_PAPER}, o AS (SELECT *, lag(lvl, 1, 0) OVER w AS above, row_number() OVER (PARTITION BY doc_id, key ORDER BY idx) AS nth FROM h WHERE head WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
j AS (SELECT doc_id, idx, num, lag(num) OVER (PARTITION BY doc_id ORDER BY idx) AS last FROM h WHERE head AND lvl = 1 AND num IS NOT NULL)
SELECT doc_id, count(*)::INT AS n_headings, coalesce(string_agg(key || '@' || idx, ' ' ORDER BY idx) FILTER (key IS NOT NULL AND nth = 1), '') AS sections,
  coalesce(string_agg(above || '->' || lvl || '@' || idx, ' ' ORDER BY idx) FILTER (lvl - above > 1), '') AS deeper,
  coalesce((SELECT string_agg(last || '->' || num || '@' || idx, ' ' ORDER BY idx) FROM j WHERE j.doc_id = o.doc_id AND num <> last + 1), '') AS jumps FROM o GROUP BY doc_id""")
def q_structure_report(spark, d):
    r = rules.structure_report(_papers(spark, d))
    shown = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat(x["before"].cast("string"), F.lit("->"), x["now"].cast("string"), F.lit("@"), x["at"].cast("string"))), " ")
    sections = F.array_join(F.transform("sections", lambda x: F.concat(x["section_key"], F.lit("@"), x["at"].cast("string"))), " ")
    return r.select("doc_id", F.size("headings").alias("n_headings"), sections.alias("sections"), shown("deeper").alias("deeper"), shown("jumps").alias("jumps"))


@query(f"""WITH {_PAPER} SELECT doc_id, 'headings.top_level_format' AS rule_id, text AS location FROM h WHERE head AND lvl = 1
UNION ALL SELECT doc_id, 'headings.max_level', array_to_string(list('«' || text || '»' ORDER BY idx)[1:5], ', ') FROM h WHERE head AND lvl > 2 GROUP BY doc_id
UNION ALL SELECT doc_id, 'headings.found', '' FROM h WHERE head GROUP BY doc_id""")
def q_heading_rules(spark, d):
    """No title is in capitals, and two levels are allowed."""
    found = rules.heading_rules(_papers(spark, d, headings={"require_top_level_heading_format": True, "max_level": 2}))
    return found.select("doc_id", "rule_id", "location")


@query(f"""WITH {_PAPER} SELECT doc_id, 'headings.page_break' AS rule_id, text AS location, idx + 10 AS at FROM h WHERE head AND lvl = 1 AND q % 4 <> 0 UNION ALL SELECT doc_id, 'headings.bold', text, idx + 536870912 FROM h WHERE head AND f = 'R'""")
def q_heading_breaks(spark, d):
    c = _papers(spark, d, headings={"require_page_break_before_top_level": True}, font={"allow_headings_bold": False, "name": "Times New Roman", "size_pt": 14})
    return rules.completeness_rules(c).where("rule_id LIKE 'headings.%'").select("doc_id", "rule_id", "location", F.col("sub_ord").alias("at"))


@query(f"""WITH {_PAPER}, a AS (SELECT *, min(idx) FILTER (key = 'introduction') OVER d AS intro, min(idx) FILTER (key = 'conclusion') OVER d AS concl, min(idx) FILTER (key = 'references') OVER d AS refs,
    last_value(CASE WHEN head AND (key IS NOT NULL OR lvl = 1) THEN coalesce(key, 'unnamed') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS section FROM h WINDOW d AS (PARTITION BY doc_id)),
w AS (SELECT doc_id, section, sum(words) - arg_min(words, idx) AS n FROM a WHERE section IN ('introduction', 'conclusion') GROUP BY ALL),
jumps AS (SELECT doc_id FROM (SELECT doc_id, num, lag(num) OVER (PARTITION BY doc_id ORDER BY idx) AS last FROM h WHERE head AND lvl = 1 AND num IS NOT NULL) WHERE num <> last + 1),
deeper AS (SELECT doc_id FROM (SELECT doc_id, lvl, lag(lvl, 1, 0) OVER (PARTITION BY doc_id ORDER BY idx) AS above FROM h WHERE head) WHERE lvl - above > 1),
s AS (SELECT doc_id, (max(intro) IS NULL)::INT + (max(concl) IS NULL)::INT + (max(refs) IS NULL)::INT + (NOT bool_or(head AND lvl = 1 AND num IS NOT NULL AND (intro IS NULL OR idx > intro) AND (coalesce(concl, refs) IS NULL OR idx < coalesce(concl, refs))))::INT AS missing, max(refs) IS NOT NULL AS listed,
    bool_or(NOT head AND (refs IS NULL OR idx < refs)) AS has_body, coalesce(bool_or(NOT head AND (refs IS NULL OR idx < refs) AND q % 5 = 0), false) AS spaced FROM a GROUP BY doc_id),
t AS (SELECT s.doc_id, (missing + (NOT listed)::INT)::BIGINT AS critical, 30 * (10000 - CASE WHEN spaced THEN 1500 ELSE 0 END - CASE WHEN has_body THEN 0 ELSE 500 END) AS formatting,
    20 * greatest(0, 10000 - 3500 * missing - CASE WHEN listed THEN 1500 ELSE 0 END - 500 - 500 * (s.doc_id IN (SELECT doc_id FROM jumps))::INT - 500 * (s.doc_id IN (SELECT doc_id FROM deeper))::INT
      - 500 * (SELECT count(*) FROM w WHERE w.doc_id = s.doc_id AND n < CASE section WHEN 'introduction' THEN 250 ELSE 200 END)) AS structure FROM s)
SELECT doc_id, critical, round((formatting + structure) / 10000.0 / 50 * 100, 1)::DOUBLE AS score FROM t""")
def q_compliance(spark, d):
    """All families of rules over stored papers, and what they cost."""
    c = _papers(spark, d)
    kept = c.stored()
    found = rules.stored_findings(kept)
    scores = scoring.totals(scoring.category_scores(kept.docs, found, kept.presets)).select("doc_id", "score")
    return scoring.summary(found, "doc_id").select("doc_id", "critical").join(scores, "doc_id")


@query("""SELECT doc_id, rule_id, severity, actual FROM (SELECT p_partkey AS doc_id, 200 + p_size AS w, CASE WHEN p_size % 2 = 0 THEN 297 ELSE 301 END AS h, p_size % 7 = 0 AS wide FROM part), LATERAL (
  SELECT 'page.size' AS rule_id, CASE WHEN abs(least(w, h) - 210) <= 3 AND abs(greatest(w, h) - 297) <= 3 THEN 'pass' ELSE 'error' END AS severity, w || 'x' || h AS actual
  UNION ALL SELECT 'page.orientation', CASE WHEN wide THEN 'error' ELSE 'pass' END, CASE WHEN wide THEN 'landscape' ELSE 'portrait' END)""")
def q_page_rules(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    mm = F.lit(20.0)
    pages = p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("section_no"), (size + 200.0).alias("page_width_mm"), F.when(size % 2 == 0, 297.0).otherwise(301.0).alias("page_height_mm"), F.when(size % 7 == 0, "landscape").otherwise("portrait").alias("orientation"), *(mm.alias(f"margin_{s}_mm") for s in ("left", "right", "top", "bottom")))
    own = p.select(F.col("p_partkey").alias("doc_id"), F.lit("base").alias("preset_id"))
    return rules.page_rules(rules.Corpus(own, pages, pages, H.presets(spark))).where("rule_id LIKE 'page.%'").select("doc_id", "rule_id", "severity", "actual")


@query("SELECT p_partkey AS doc_id, 'info' AS severity, CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN 'Header or footer present' ELSE 'No header or footer' END AS message FROM part")
def q_header_rules(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("base").alias("preset_id"), (F.col("p_size") % 2 == 0).alias("has_header"), (F.col("p_size") % 3 == 0).alias("has_footer"))
    return rules.header_rules(rules.Corpus(own, own, own, H.presets(spark))).select("doc_id", "severity", "message")


_MAIN = "head AND lvl = 1 AND num IS NOT NULL AND (intro IS NULL OR idx > intro) AND (coalesce(concl, refs) IS NULL OR idx < coalesce(concl, refs))"
_PLACED = f"""{_PAPER}, a AS (SELECT *, min(idx) FILTER (key = 'introduction') OVER d AS intro, min(idx) FILTER (key = 'conclusion') OVER d AS concl, min(idx) FILTER (key = 'references') OVER d AS refs FROM h WINDOW d AS (PARTITION BY doc_id))"""


@query(f"""WITH {_PLACED}, s AS (SELECT doc_id, max(intro) IS NOT NULL AS introduction, bool_or({_MAIN}) AS main_body, max(concl) IS NOT NULL AS conclusion, max(refs) IS NOT NULL AS "references" FROM a GROUP BY doc_id)
SELECT doc_id, 'structure.section.' || key AS rule_id, CASE WHEN there THEN 'pass' ELSE 'critical' END AS severity FROM s UNPIVOT (there FOR key IN (introduction, main_body, conclusion, "references"))
UNION ALL SELECT doc_id, 'structure.optional.appendix', 'info' FROM s""")
def q_required_sections(spark, d):
    return rules.structure_rules(_papers(spark, d)).select("doc_id", "rule_id", "severity")


@query(f"WITH {_PLACED} SELECT DISTINCT doc_id FROM a WHERE {_MAIN}")
def q_main_body_inference(spark, d):
    return rules.main_bodies(views.headings(_papers(spark, d).placed))


# Changes of job tables

_HIT = "o_orderkey % 5 = 0"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END"
_SENDING = "CASE o_orderkey % 3 WHEN 0 THEN 'sending' WHEN 1 THEN 'pending' ELSE 'sent' END"


def _orders(spark, d) -> DataFrame:
    return H.as_checks(table(spark, d, "orders"))


def _fifth(spark, d, **columns) -> DataFrame:
    """Every fifth check, as news about it."""
    o = table(spark, d, "orders").where(_HIT)
    return o.select(F.col("o_orderkey").alias("check_id"), *(v.alias(k) for k, v in columns.items()))


@query(f"SELECT id, CASE WHEN hit AND status = 'pending' THEN 'running' ELSE status END AS status, CASE WHEN hit AND status = 'pending' THEN 1 ELSE 0 END AS attempts FROM (SELECT o_orderkey AS id, {_HIT} AS hit, {_STATUS} AS status FROM orders)")
def q_claimed(spark, d):
    return jobs.claimed(_orders(spark, d), _fifth(spark, d), F.lit("1998-08-01 12:00:00").cast("timestamp")).select("id", "status", "attempts")


@query(f"SELECT id, CASE WHEN hit AND status <> 'completed' THEN 'completed' ELSE status END AS status, CASE WHEN hit AND status <> 'completed' THEN 77.5 ELSE o_totalprice::DOUBLE END::DOUBLE AS score FROM (SELECT o_orderkey AS id, o_totalprice, {_HIT} AS hit, {_STATUS} AS status FROM orders)")
def q_completed(spark, d):
    done = jobs.completed(_orders(spark, d).withColumns({"score": F.col("score").cast("double"), "result_snapshot": F.lit(None).cast("string")}), _fifth(spark, d, score=F.lit(77.5), snapshot=F.lit("{}")), F.lit("1998-08-01 12:00:00").cast("timestamp"))
    return done.select("id", "status", "score")


@query(f"SELECT id, CASE WHEN hit AND status <> 'completed' THEN 'failed' ELSE status END AS status, CASE WHEN hit AND status <> 'completed' THEN repeat('x', 500) END AS error_detail FROM (SELECT o_orderkey AS id, {_HIT} AS hit, {_STATUS} AS status FROM orders)")
def q_failed(spark, d):
    return jobs.failed(_orders(spark, d), _fifth(spark, d, detail=F.repeat(F.lit("x"), 700)), F.lit("1998-08-01 12:00:00").cast("timestamp")).select("id", "status", "error_detail")


@query(f"SELECT id, CASE WHEN hit AND status = 'running' THEN CASE WHEN id % 2 = 0 THEN 'failed' ELSE 'pending' END ELSE status END AS status FROM (SELECT o_orderkey AS id, {_HIT} AS hit, {_STATUS} AS status FROM orders)")
def q_retried(spark, d):
    errors = _fifth(spark, d, detail=F.lit("x"), is_domain=F.col("o_orderkey") % 2 == 0)
    return jobs.retried(_orders(spark, d), errors, F.lit("1998-08-01 12:00:00").cast("timestamp")).select("id", "status")


@query(f"SELECT id, CASE WHEN hit AND status = 'completed' AND sent <> 'sent' THEN CASE WHEN id % 2 = 0 THEN 'sent' ELSE 'pending' END ELSE sent END AS delivery_status, CASE WHEN hit AND status = 'completed' AND sent <> 'sent' THEN 1 ELSE 0 END AS delivery_attempts FROM (SELECT o_orderkey AS id, {_HIT} AS hit, {_STATUS} AS status, {_SENDING} AS sent FROM orders)")
def q_delivered(spark, d):
    return jobs.delivered(_orders(spark, d), _fifth(spark, d, ok=F.col("o_orderkey") % 2 == 0)).select("id", "delivery_status", "delivery_attempts")


@query(f"SELECT o_orderkey AS id FROM orders WHERE NOT (o_custkey = 7 AND {_STATUS} = 'completed' AND {_SENDING} <> 'sending')")
def q_without_history(spark, d):
    return jobs.without_history(_orders(spark, d), H.as_uploads(table(spark, d, "orders")), F.col("user_id") == 7).select("id")


@query("""SELECT o_orderkey AS id, 'pending' AS status FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 4 = 3 UNION ALL SELECT o_orderkey, 'running' FROM orders WHERE o_orderkey % 4 <> 3""")
def q_created(spark, d):
    """Some checks are there, and all orders ask for one."""
    there = _orders(spark, d).where("id % 4 <> 3").withColumn("status", F.lit("running"))
    return jobs.created(there, _orders(spark, d).select("id", "document_id"), F.lit("1998-08-01 12:00:00").cast("timestamp")).select("id", "status")


@query("SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderkey = 7")
def q_looked_up(spark, d):
    return jobs.looked_up(_orders(spark, d), "id", 7).select("id", "score")


@query("SELECT c_custkey AS user_id, CASE WHEN c_nationkey % 3 = 0 THEN 'kk' WHEN c_nationkey % 3 = 1 THEN 'en' ELSE 'ru' END AS language FROM customer")
def q_language_set(spark, d):
    c = table(spark, d, "customer")
    wish = F.when(F.col("c_nationkey") % 3 == 0, "kk").when(F.col("c_nationkey") % 3 == 1, "en").otherwise("xx")
    users = c.select(F.col("c_custkey").alias("user_id"), F.lit("ru").alias("language"))
    return jobs.told(users, c.select(F.col("c_custkey").alias("user_id"), wish.alias("language")), "user_id", "language", report.LANGS)


@query("""SELECT c_custkey AS telegram_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'old' END AS username, CASE WHEN c_custkey % 2 = 0 AND c_custkey IN (2, 4) THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_custkey % 3 = 0 THEN 'kk' END AS language
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def q_upserted(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("telegram_id"), "c_name")
    users = c.where("telegram_id % 3 = 0").select("telegram_id", F.lit("old").alias("username"), F.lit("old").alias("full_name"), F.lit("user").alias("role"), F.lit("kk").alias("language"))
    seen = c.where("telegram_id % 2 = 0").select("telegram_id", F.col("c_name").alias("username"), F.col("c_name").alias("full_name"))
    return jobs.upserted(users, seen, [2, 4]).select("telegram_id", "username", "role", "language")


_STAGED = {"signup": "structure", "view": "formatting", "click": "text", "purchase": "ai", "error": "none"}


@query(f"""SELECT user_id AS check_id, max(step)::INT AS step, ['structure', 'formatting', 'text', 'ai', 'report'][max(step)] AS stage
FROM (SELECT user_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS step FROM events) WHERE step IS NOT NULL GROUP BY user_id""")
def q_progress(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("check_id"), scoring.lookup(F.col("event_type"), _STAGED).alias("stage"))
    return jobs.progress(e).select("check_id", "step", "stage")


@query("SELECT 'orders' AS table_name, list(c ORDER BY c) AS missing FROM (SELECT unnest(['o_orderkey', 'lost', 'o_totalprice', 'also_lost']) AS c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE orders))")
def q_missing_columns(spark, d):
    wanted = H.values(spark, [("orders", c) for c in ("o_orderkey", "lost", "o_totalprice", "also_lost")] + [("nation", "n_name")], "table_name string, column_name string")
    return jobs.missing_columns(wanted, jobs.columns_of({t: table(spark, d, t) for t in ("orders", "nation")}))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 50.5 ELSE o_totalprice::DOUBLE END::DOUBLE AS score, CASE WHEN o_orderkey % 2 = 0 THEN '3' ELSE 'legacy' END AS version, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END::INT AS findings FROM orders WHERE {_HIT}")
def q_restored(spark, d):
    """Even checks have a snapshot, odd ones are rebuilt from their rows."""
    c = _orders(spark, d).where("id % 5 = 0").withColumns({"score": F.col("score").cast("double"), "result_snapshot": F.when(F.col("id") % 2 == 0, F.lit('{"score": 50.5, "scoring_version": "3", "findings": []}'))})
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("check_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("message"))
    out = jobs.restored(c, "struct<score:double,scoring_version:string,findings:array<struct<message:string>>>", found)
    return out.select("id", F.col("result.score").alias("score"), F.col("result.scoring_version").alias("version"), F.coalesce(F.size("result.findings"), F.lit(0)).alias("findings"))


# Reports


@query(f"SELECT doc_id, part::INT AS part, row_number() OVER (PARTITION BY doc_id, part ORDER BY {_RANK}, ord)::INT AS row, rule_id FROM (SELECT *, CASE category WHEN 'formatting' THEN 1 WHEN 'structure' THEN 2 ELSE 3 END AS part FROM ({_FOUND}))")
def q_report_rows(spark, d):
    return report.report_rows(H.text_findings(docs(spark, d))).select("doc_id", "part", "row", "rule_id")


@query(f"SELECT doc_id, string_agg(CASE severity WHEN 'critical' THEN '{report.MARKS['critical']}' ELSE '{report.MARKS['error']}' END || ' ' || message, chr(10) || chr(10) ORDER BY {_RANK}, ord) AS text, 0::BIGINT AS left_out FROM ({_FOUND}) WHERE severity IN ('critical', 'error') GROUP BY doc_id")
def q_errors_message(spark, d):
    return report.errors_message(H.text_findings(docs(spark, d)))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, CASE WHEN l_tax = 0 THEN 100.0 ELSE round_even(least(l_discount, l_tax) / l_tax * 100, 1) END::DOUBLE AS pct FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem)")
def q_category_percentage(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("e"), F.col("l_tax").cast("double").alias("m"))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), report.category_percentage(F.least("e", "m"), F.col("m")).alias("pct"))


MESSAGES = [(1, "hello", "ru", "Привет, {name}"), (2, "hello", "en", "Hello, {name}"), (3, "bye", "ru", "Пока"), (4, "only", "kk", "Сәлем"), (5, "twice", "ru", "старое"), (6, "twice", "ru", "новое")]
_ASKED = "SELECT c_custkey AS id, ['hello', 'bye', 'only', 'none', 'twice'][c_nationkey % 5 + 1] AS key, CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'kk' WHEN 2 THEN 'RU' END AS lang, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name FROM customer"


@query(f"""WITH m AS (SELECT * FROM {H.sql_values(MESSAGES, "seq, key, lang, t")}), a AS ({_ASKED}),
l AS (SELECT key, lang, arg_max(t, seq) AS t FROM m GROUP BY key, lang), f AS (SELECT key, arg_min(t, seq) AS t FROM m GROUP BY key)
SELECT id, CASE WHEN name IS NULL THEN x ELSE replace(x, '{{name}}', name) END AS text FROM (SELECT a.id, a.name, coalesce(l1.t, l2.t, f.t, a.key) AS x FROM a
  LEFT JOIN l l1 ON l1.key = a.key AND l1.lang = lower(coalesce(a.lang, 'ru')) LEFT JOIN l l2 ON l2.key = a.key AND l2.lang = 'ru' LEFT JOIN f ON f.key = a.key)""")
def q_i18n_lookup(spark, d):
    m = H.values(spark, MESSAGES, "seq int, key string, lang string, template string")
    k = F.col("c_custkey")
    key = F.element_at(F.array(*map(F.lit, ("hello", "bye", "only", "none", "twice"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    a = table(spark, d, "customer").select(k.alias("id"), key.alias("key"), F.when(k % 4 == 0, "en").when(k % 4 == 1, "kk").when(k % 4 == 2, "RU").alias("lang"), F.when(k % 3 > 0, F.col("c_name")).alias("name"))
    args = F.when(F.col("name").isNotNull(), F.create_map(F.lit("name"), "name")).otherwise(F.create_map().cast("map<string,string>"))
    return report.localised(a.withColumn("args", args), m, "key", F.col("lang"), "text", "args").select("id", "text")


_PLACE = ("'unnamed:' || l_suppkey", "'Section ' || l_suppkey || ': left margin'", "'body'", "'unnamed ' || l_suppkey || ', introduction'", "'main_body and conclusion'", "'plain ' || l_suppkey")
_SHOWN = ("'Paragraph ' || (l_suppkey + 1)", "'Section ' || l_suppkey || ': left margin'", "'Main body'", "'Paragraph ' || (l_suppkey + 1) || ', Introduction'", "'Main body and Conclusion'", "'plain ' || l_suppkey")


@query(f"SELECT l_orderkey AS id, l_linenumber AS line, CASE l_partkey % 6 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(_SHOWN))} END AS place FROM lineitem")
def q_display_location(spark, d):
    """Order lines as findings at six kinds of places."""
    names = {"main_body": "Main body", "introduction": "Introduction", "conclusion": "Conclusion"}
    place = scoring.chosen(F.col("l_partkey") % 6, [F.expr(x) for x in _PLACE])
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), report.display_location(place, names).alias("place"))


@query("SELECT doc_id, len(parts)::INT AS n, length(parts[1])::INT AS first, length(parts[-1])::INT AS last FROM (SELECT doc_id, list_transform(generate_series(0, (length(text) + 3499) // 3500 - 1), lambda i: substr(text, i * 3500 + 1, 3500)) AS parts FROM documents WHERE text <> '')")
def q_split_message(spark, d):
    p = docs(spark, d).where("text <> ''").select("doc_id", split_message(F.col("text")).alias("parts"))
    return p.select("doc_id", F.size("parts").alias("n"), F.length(F.element_at("parts", 1)).alias("first"), F.length(F.element_at("parts", -1)).alias("last"))

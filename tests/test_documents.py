import io
import zipfile

import pandas as pd
import pytest
from docs import SHAPES, docx, heading, para, section
from pyspark.sql import functions as F

from folio.operators import rules, scoring
from folio.settings import Settings
from folio.sources import docx as D
from folio.sources import presets as P
from folio.sources import uploads

PRESET = {
    "id": "p", "name": "n", "institution": "i", "work_type": "coursework",
    "margins": {"top_mm": 20, "bottom_mm": 20, "left_mm": 30, "right_mm": 10}, "font": {"name": "Times New Roman", "size_pt": 14},
    "structure": {"required_sections": ["introduction", "theoretical_part", "practical_part", "conclusion", "references"]}, "references": {"min_sources": 10},
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    for name, content in SHAPES.items():
        (folder / name).write_bytes(content)
    (folder / "broken.docx").write_bytes(b"PK\x03\x04 no zip")
    d = D.read_docx(spark, str(folder)).withColumn("doc_id", F.col("filename")).cache()
    docs = d.where("error_code IS NULL").select("doc_id", F.lit("p").alias("preset_id"), "has_header", "has_footer")
    return d, rules.Corpus(docs, D.pages(d), D.paragraphs(d), P.preset_table(spark, [P.preset(PRESET)]))


@pytest.fixture(scope="module")
def found(corpus):
    return rules.evaluated(corpus[1]).cache()


def by(found, doc, rule):
    return [(r.severity, r.expected, r.actual) for r in found.where((F.col("doc_id") == doc) & (F.col("rule_id") == rule)).collect()]


def test_decoding(corpus):
    d = {r.doc_id: r for r in corpus[0].collect()}
    assert d["broken.docx"].error_code == "corrupted_document" and len(d) == 7
    page = d["correct.docx"].pages[0]
    assert (page.margin_left_mm, page.margin_top_mm, page.orientation) == (30.0, 20.0, "portrait")
    p = d["correct.docx"].paragraphs
    assert p[0].outline_level == 0 and p[1].runs[0].font_size_pt == 14 and p[1].line_spacing == 1.5
    assert p[0].runs[0].font_size_pt == 11  # from the defaults


@pytest.mark.parametrize(
    "doc,rule,severity",
    [
        ("correct.docx", "font.main", "pass"), ("correct.docx", "margins.left_margin", "pass"), ("correct.docx", "paragraph.line_spacing", "pass"), ("correct.docx", "paragraph.first_line_indent", "pass"),
        ("correct.docx", "structure.section.references", "pass"), ("correct.docx", "references.count", "info"), ("correct.docx", "numbering.ok", "pass"), ("correct.docx", "headings.found", "pass"),
        ("wrong_font.docx", "font.main", "error"), ("wrong_font.docx", "font.paragraph_consistency", "warning"), ("wrong_margins.docx", "margins.left_margin", "error"), ("wrong_spacing.docx", "paragraph.line_spacing", "error"),
        ("missing_sections.docx", "structure.section.practical_part", "critical"), ("missing_sections.docx", "references.missing", "critical"), ("mixed_formatting.docx", "font.paragraph_consistency", "warning"), ("mixed_formatting.docx", "font.mixed", "warning"),
        ("correct.docx", "references.in_text_citations", "warning"),
    ],
)
def test_rules(found, doc, rule, severity):
    assert [s for s, _, _ in by(found, doc, rule)] == [severity]


def test_rules_not_raised(found):
    for rule in ("font.mixed", "font.paragraph_consistency", "references.missing", "numbering.sequence", "structure.min_words.introduction"):
        assert not by(found, "correct.docx", rule)
    assert by(found, "wrong_font.docx", "font.main")[0][1] == "Times New Roman, 14 pt"


def test_order_and_scores(corpus, found):
    seq = rules.ordered(found).where("doc_id = 'wrong_font.docx'").orderBy("seq").collect()
    ranks = [("critical", "error", "warning", "info", "pass").index(r.severity) for r in seq]
    assert ranks == sorted(ranks)
    score = {r.doc_id: r for r in scoring.totals(scoring.category_scores(corpus[1].docs, found, corpus[1].presets)).collect()}
    assert score["correct.docx"].score > score["wrong_font.docx"].score > 0
    assert score["correct.docx"].score > score["missing_sections.docx"].score
    assert score["correct.docx"].evaluated_max_score == 50 and score["correct.docx"].provisional


def decode(content):
    return D.decoded(content)


def test_inheritance_through_a_cycle_of_styles():
    p = decode(docx(heading("Глава", "Chapter") + para("t")))["paragraphs"][0]
    assert p["outline_level"] == 0 and p["first_line_indent_cm"] == 0.71 and p["runs"][0]["font_name"] == "Georgia"


def test_explicit_zero_and_hanging():
    p = decode(docx(para("a", indent=0) + '<w:p><w:pPr><w:ind w:hanging="567"/></w:pPr><w:r><w:t>b</w:t></w:r></w:p>'))["paragraphs"]
    assert p[0]["first_line_indent_cm"] is None and p[1]["first_line_indent_cm"] == -1.0


@pytest.mark.parametrize("line,rule,kind,value", [(240, "auto", "MULTIPLE", 1.0), (360, "auto", "MULTIPLE", 1.5), (600, "exact", "EXACTLY", 30.0), (0, "auto", "SINGLE", 1.0)])
def test_line_spacing(line, rule, kind, value):
    p = decode(docx(para("a", line=line, rule=rule)))["paragraphs"][0]
    assert (p["line_spacing"], p["line_spacing_rule"]) == (value, kind)


def test_tables_breaks_and_sections():
    table = f'<w:tbl><w:tr><w:tc>{para("cell")}</w:tc></w:tr></w:tbl>'
    broken = '<w:p><w:r><w:t>x</w:t><w:br w:type="page"/></w:r></w:p>'
    first = f"<w:p><w:pPr>{section()}</w:pPr><w:r><w:t>s</w:t></w:r></w:p>"
    d = decode(docx(table + broken + para("after") + first, section(left=50)))
    assert [p["in_table"] for p in d["paragraphs"]] == [True, False, False, False] and d["table_count"] == 1
    assert [p["page_break_before"] for p in d["paragraphs"]] == [False, False, True, False]
    assert [p["margin_left_mm"] for p in d["pages"]] == [29.99, 50.0] or [round(p["margin_left_mm"]) for p in d["pages"]] == [30, 50]


@pytest.mark.parametrize(
    "content,reason",
    [
        (b"nonsense", "can't be opened"),
        (docx(para("a"), drop=("word/document.xml",)), "missing parts"),
        (docx(para("a"), extra={"../x": "y"}), "unsafe"),
        (docx(para("a"), extra={"word/bomb.xml": "0" * 5_000_000}), "compressed too much"),
        (docx(para("a"), extra={"word/dtd.xml": "<!DOCTYPE x>"}), "document type"),
        (docx(""), "no text"),
        (docx('<w:p><w:pPr><w:pStyle w:val="X"/></w:pPr><w:r><w:t>a</w:t></w:r></w:p>', styles=f'<w:styles xmlns:w="{D.WORD[1:-1]}"><w:style w:type="paragraph" w:styleId="X"><w:pPr><w:outlineLvl/></w:pPr></w:style></w:styles>'), "can't be read"),
    ],
)
def test_rejections(content, reason):
    with pytest.raises(D.Rejected, match=reason):
        decode(content)


def test_duplicate_parts_and_admission(spark):
    out = io.BytesIO()
    with pytest.warns(UserWarning), zipfile.ZipFile(out, "w") as z:
        for _ in range(2):
            z.writestr("word/document.xml", "x")
    with pytest.raises(D.Rejected, match="part twice"):
        decode(out.getvalue())
    u = spark.createDataFrame([("a", "x.docx", None), ("b", "x.PDF", None), ("c", "x.DOCX", "text/plain"), ("d", "x.docx", "")], "doc_id string, filename string, mime string")
    parts = spark.createDataFrame([("d", "word/document.xml", 1, 1, 0)], D.schemas.PARTS.join(["doc_id string, ", ""]))
    got = {r.doc_id: r.error_code for r in uploads.admitted(u, parts).collect()}
    assert got == {"a": None, "b": "unsupported_format", "c": "unsupported_format", "d": "corrupted_document"}


def test_presets(spark, tmp_path):
    import yaml

    (tmp_path / "a.yaml").write_text(yaml.safe_dump(PRESET))
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(PRESET | {"scoring": {"formatting": 90}}))
    (tmp_path / "c.yaml").write_text(": : :")
    (tmp_path / "d.yaml").write_text(yaml.safe_dump(PRESET | {"name": "later"}))
    got = P.load_presets(str(tmp_path))
    assert [p["name"] for p in got] == ["later"] and P.read_presets(spark, f"file://{tmp_path}") == got
    for bad in ({"margins": {"top_mm": -1}}, {"structure": {"required_sections": ["x"]}}, {"headings": {"max_level": 10}}, {"scoring_policy": {"warning": 0.5}}, {"provenance": {"status": "department_verified"}}, {"work_type": "novel"}):
        with pytest.raises((ValueError, TypeError)):
            P.preset(PRESET | bad)


def test_registry_lookups(spark):
    t = P.preset_table(spark, [P.preset(PRESET), P.preset(PRESET | {"id": "q", "institution": "a"}), P.preset(PRESET | {"id": "r", "is_active": False})])
    assert P.active(t).count() == 2 and P.by_id(t, "p").count() == 1
    assert [r[0] for r in P.institutions(t).collect()] == ["a", "i"] and P.of_institution(t, "a").first().id == "q"
    with pytest.raises(KeyError):
        P.by_id(t, "r")


def test_preview(spark, tmp_path):
    import yaml

    from folio.preview import checked

    for d in ("docs", "presets"):
        (tmp_path / d).mkdir()
    (tmp_path / "presets" / "p.yaml").write_text(yaml.safe_dump(PRESET))
    (tmp_path / "docs" / "a.docx").write_bytes(SHAPES["correct.docx"])
    (tmp_path / "docs" / "b.docx").write_bytes(b"no")
    got = {r.filename: r for r in checked(spark, str(tmp_path / "docs"), str(tmp_path / "presets"), "p").collect()}
    assert got["a.docx"].score > 80 and got["a.docx"].preset_status == "unverified" and got["b.docx"].error_code == "corrupted_document" and got["b.docx"].score is None


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.docx").write_bytes(SHAPES["correct.docx" if folder == "a" else "wrong_font.docx"])
    got = D.read_docx(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in got}) == 2 and {r.filename for r in got} == {"x.docx"}


def test_page_limit(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(docx(para("word " * 2000)))
    got = D.read_docx(spark, str(tmp_path), D.Limits(pages=3)).first()
    assert (got.error_code, got.reason) == ("too_many_pages", "5 pages") and D.read_docx(spark, str(tmp_path)).first().error_code is None
    assert D.Limits.of(Settings(max_pages=7, max_archive_parts=9)) == D.Limits(parts=9, pages=7)


def test_container_rules_agree(spark):
    """The decoder's rules and those over a table of parts are the same."""
    PARTS = (
        [(1, "[Content_Types].xml", 100, 50, 0), (1, "word/document.xml", 9000, 1000, 0), (2, "[Content_Types].xml", 100, 50, 0), (3, "../evil", 10, 10, 0), (3, "word/document.xml", 10, 10, 0)]
        + [(4, "word/document.xml", 5_000_000, 100, 0), (4, "[Content_Types].xml", 1, 1, 0), (5, "[Content_Types].xml", 1, 1, 1), (5, "word/document.xml", 1, 1, 0), (6, "word/document.xml", 1, 1, 0), (6, "word/document.xml", 1, 1, 0)]
        + [(7, "big", 40 << 20, 30 << 20, 0), (8, "a", 60 << 20, 50 << 20, 0), (8, "b", 60 << 20, 50 << 20, 0)]
    )
    names = ["doc_id", "name", "file_size", "compress_size", "flag_bits"]
    parts = pd.DataFrame(PARTS, columns=names)
    want = {r.doc_id: r.reason for r in uploads.container_reasons(spark.createDataFrame(PARTS, names)).collect()}
    assert {i: D.container_reason(g, D.Limits()) for i, g in parts.groupby("doc_id")} == want


def test_document_type_is_seen_by_the_parser():
    seen = lambda text: D.declares_type(io.BytesIO(text))
    assert seen(b'<?xml version="1.0"?>\n<!DOCTYPE x []><x/>') and seen('<!DOCTYPE x><x/>'.encode("utf-16"))
    assert not seen(b"<x>&lt;!DOCTYPE</x>") and not seen(b"<x><![CDATA[<!DOCTYPE]]></x>") and not seen(b"<!-- <!DOCTYPE --><x/>") and not seen(b"no xml")


def test_stored_corpus_is_decoded_and_shuffled_once(spark, corpus, found):
    c = corpus[1].stored(4)
    again = rules.evaluated(c)
    plan = again._sc._jvm.PythonSQLUtils.explainString(again._jdf.queryExecution(), "formatted")
    assert "MapInPandas" not in plan and plan.count("hashpartitioning(doc_id") <= 2
    assert sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))
    c.dropped()
    assert not spark.catalog.tableExists(c.tables[0])


def test_rules_run_once_for_counts_and_scores(spark, sf_dir, corpus, found):
    """What is counted and scored is read from written findings; nothing after them goes back to the paragraphs."""
    from folio.plans import catalogue

    rows = lambda df: sorted(map(tuple, df.select(*rules.JUDGED).collect()), key=repr)
    assert rows(rules.stored_findings(corpus[1])) == rows(found)
    df = catalogue.q_compliance(spark, sf_dir)
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "_findings" in text and "_placed" not in text


def explained(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_papers_are_dealt_and_findings_exchanged_once(spark, sf_dir):
    """Lines are exchanged before they become paragraphs, paragraphs are sorted once, and scores and counts read bucketed findings without an exchange."""
    from folio.plans import catalogue

    text = explained(catalogue._papers(spark, sf_dir).placed)
    tree = text[: text.index("(1)")]
    assert tree.count("Exchange") == 1 and tree.count("Window") == 3 and tree.count("Sort (") <= 2  # one sort of lines, one of paragraphs
    text = explained(catalogue.q_compliance(spark, sf_dir))
    assert "hashpartitioning" not in text and "_findings" in text


def test_columns_of_findings_that_nobody_reads_are_not_made(corpus):
    """Counts and scores need no places or values of findings; these are made in the row of a finding, so they go when unread."""
    whole, judged = explained(rules.body_rules(corpus[1])), explained(rules.body_rules(corpus[1]).select(*rules.JUDGED))
    assert "collect_list" in whole and "collect_list" not in judged


def test_a_value_used_several_times_is_computed_once(spark):
    from folio.functions.text import lines

    df = spark.range(3).select(F.when(F.col("id") > 0, F.repeat(F.lit("a\n"), F.col("id").cast("int"))).alias("t")).select(lines(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [[], ["a"], ["a", "a"]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1

"""Table schemas of decoded documents and of what is found in them."""

from __future__ import annotations

from pyspark.sql import types as T

RUNS = "array<struct<text:string,font_name:string,font_size_pt:double,bold:boolean,italic:boolean,underline:boolean,color_rgb:string>>"
PARAGRAPHS = f"idx int, text string, style_name string, outline_level int, alignment string, line_spacing double, line_spacing_rule string, space_before_pt double, space_after_pt double, first_line_indent_cm double, left_indent_cm double, right_indent_cm double, in_table boolean, page_break_before boolean, is_numbered boolean, runs {RUNS}"
PAGES = "section_no int, page_width_mm double, page_height_mm double, orientation string, margin_top_mm double, margin_bottom_mm double, margin_left_mm double, margin_right_mm double, header_distance_mm double, footer_distance_mm double"
CELLS = "table int, parent int, row int, col int, row_span int, col_span int, text string"
PARTS = "name string, file_size bigint, compress_size bigint, flag_bits int"


def array_of(columns: str) -> str:
    """The DDL of an array of structs from the DDL of its columns."""
    import re

    parts = re.split(r", (?=\w+ )", columns)
    return "array<struct<" + ",".join(p.replace(" ", ":", 1) for p in parts) + ">>"


DECODED = f"doc_id string, path string, filename string, error_code string, reason string, has_header boolean, has_footer boolean, table_count int, image_count int, estimated_page_count int, fonts array<string>, pages {array_of(PAGES)}, paragraphs {array_of(PARAGRAPHS)}, cells {array_of(CELLS)}, parts {array_of(PARTS)}"

FINDINGS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("preset_id", T.StringType()),
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("sub_ord", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("actual", T.StringType()),
        T.StructField("suggestion", T.StringType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# Closed domains.
SEVERITIES = ("critical", "error", "warning", "info", "pass")
CATEGORIES = ("formatting", "structure", "language", "style", "content", "references", "system")
SECTION_KEYS = ("introduction", "theoretical_part", "practical_part", "main_body", "conclusion", "references", "appendix", "abstract", "content_table")

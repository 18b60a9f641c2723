"""Word documents built with the standard library."""

import io
import zipfile
from xml.sax.saxutils import escape

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f"""<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:basedOn w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="Heading3"><w:name w:val="heading 3"/><w:basedOn w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="Chapter"><w:name w:val="Chapter"/><w:basedOn w:val="Base"/></w:style>
<w:style w:type="paragraph" w:styleId="Base"><w:name w:val="Base"/><w:basedOn w:val="Chapter"/><w:pPr><w:outlineLvl w:val="0"/><w:ind w:firstLine="400"/></w:pPr><w:rPr><w:rFonts w:ascii="Georgia"/></w:rPr></w:style>
</w:styles>"""


def run(text, font="Times New Roman", size=14, bold=False):
    return f'<w:r><w:rPr><w:rFonts w:ascii="{font}"/>{"<w:b/>" if bold else ""}<w:sz w:val="{int(size * 2)}"/></w:rPr><w:t>{escape(text)}</w:t></w:r>'


def para(text, font="Times New Roman", size=14, line=360, rule="auto", indent=709, jc="both", style="Normal", extra=""):
    spacing = f'<w:spacing w:line="{line}" w:lineRule="{rule}"/>' if line else ""
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{extra}{spacing}<w:ind w:firstLine="{indent}"/><w:jc w:val="{jc}"/></w:pPr>{run(text, font, size)}</w:p>'


def heading(text, style="Heading1"):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{escape(text)}</w:t></w:r></w:p>'


def section(top=20, bottom=20, left=30, right=10):
    tw = lambda mm: round(mm * 1440 / 25.4)
    return f'<w:sectPr><w:pgSz w:w="{tw(210)}" w:h="{tw(297)}"/><w:pgMar w:top="{tw(top)}" w:bottom="{tw(bottom)}" w:left="{tw(left)}" w:right="{tw(right)}" w:header="708" w:footer="708"/></w:sectPr>'


def docx(body, sect=None, styles=STYLES, extra=None, drop=()):
    parts = {"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {NS}><w:body>{body}{section() if sect is None else sect}</w:body></w:document>", "word/styles.xml": styles} | (extra or {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            if name not in drop:
                z.writestr(name, content)
    return out.getvalue()


CHAPTERS = ("Введение", "1 Теоретическая часть", "2 Практическая часть", "Заключение")


def paper(font="Times New Roman", size=14, line=360, sect=None, chapters=CHAPTERS, sources=15, fonts=None):
    fonts = fonts or [(font, size)]
    body = ""
    for i, title in enumerate(chapters):
        name, pt = fonts[i % len(fonts)]
        body += heading(title) + para(f"Текст раздела {i}. " + "слово " * 300, name, pt, line)
    if sources:
        body += heading("Список использованной литературы")
        body += "".join(para(f"{k}. Автор {k}. Название источника номер {k}.") for k in range(1, sources + 1))
    return docx(body, sect)


SHAPES = {
    "correct.docx": paper(),
    "wrong_font.docx": paper("Arial", 12),
    "wrong_margins.docx": paper(sect=section(10, 10, 15, 15)),
    "wrong_spacing.docx": paper(line=240),
    "missing_sections.docx": paper(chapters=CHAPTERS[:2] + CHAPTERS[3:], sources=0),
    "mixed_formatting.docx": paper(fonts=[("Times New Roman", 14), ("Arial", 12), ("Calibri", 11)]),
}

"""Documents as a data source, table cells, archive integrity."""

import io
import json
import random
import shutil
import zipfile

import pytest
from docs import SHAPES, docx, para
from pyspark.sql import functions as F

from folio.sources import docx as D
from folio.sources import word


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    word.register(spark)
    f = tmp_path_factory.mktemp("word")
    (f / "deep" / "er").mkdir(parents=True)
    for i, (name, content) in enumerate(SHAPES.items()):
        (f / ("deep/er" if i % 2 else ".") / name).write_bytes(content)
    (f / "BROKEN.DOCX").write_bytes(b"PK\x03\x04 no zip")
    (f / "long.docx").write_bytes(docx(para("word " * 2000)))
    (f / ".half.docx").write_bytes(b"x")
    (f / "_temporary").mkdir()
    (f / "_temporary" / "x.docx").write_bytes(b"x")
    (f / "note.txt").write_text("x")
    return f


def rows(df):
    return sorted(map(repr, df.collect()))


def whole(spark, folder, **limits):
    """What decode gives for the same files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(str(folder))
    files = files.where(~F.col("path").rlike(r"/[._][^/]*(/|$)")).select("path", "content")
    return D.decode(files, D.Limits(**limits))


@pytest.mark.parametrize("uri", ["{}", "file:{}", "file://{}"])
def test_source_gives_the_rows_of_decode(spark, folder, uri):
    got = spark.read.format("word").load(uri.format(folder))
    assert got.count() == len(SHAPES) + 2 and rows(got) == rows(whole(spark, folder))


def test_options_are_limits(spark, folder):
    got = spark.read.format("word").option("pages", 3).option("per_page", 2200).load(str(folder))
    assert rows(got) == rows(whole(spark, folder, pages=3))
    assert got.where("filename = 'long.docx'").first().error_code == "too_many_pages"


def test_partitions_go_by_bytes(spark, folder):
    read = lambda n: spark.read.format("word").option("partitionBytes", n).load(str(folder))
    assert read(1).rdd.getNumPartitions() == len(SHAPES) + 2 and read(1 << 30).rdd.getNumPartitions() == 1
    assert rows(read(1)) == rows(read(1 << 30))
    files = [word.File(str(i), s) for i, s in enumerate((5, 5, 900_000, 1, 1))]
    groups = word.packed(files, 2 * word.OPEN_BYTES + 10)
    assert [f for g in groups for f in g.files] == files and [len(g.files) for g in groups] == [2, 1, 2]
    assert word.packed([], 5) == []


def test_filters_prune_files(spark, folder):
    reader = word.WordReader({"path": str(folder)})
    equal = word.EqualTo(("filename",), "correct.docx")
    other = word.EqualTo(("error_code",), "x")
    assert list(reader.pushFilters([equal, other])) == [other]
    assert [f.path.rsplit("/", 1)[1] for p in reader.partitions() for f in p.files] == ["correct.docx"]
    reader = word.WordReader({"path": str(folder)})
    assert list(reader.pushFilters([word.In(("path",), ("no",)), word.StringStartsWith(("path",), "file:/")])) == []
    assert [p.files for p in reader.partitions()] == [()]
    one = spark.read.format("word").option("partitionBytes", 1).load(str(folder)).where("filename = 'correct.docx'")
    assert one.rdd.getNumPartitions() == 1 and [r.filename for r in one.collect()] == ["correct.docx"]


def stream(spark, folder, tmp, out, name="cp", **options):
    s = spark.readStream.format("word").option("log", str(tmp / "log")).options(**options).load(str(folder))
    return s.writeStream.foreachBatch(out).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()


def test_stream_gives_each_file_once_over_restarts(spark, folder, tmp_path):
    inbox = tmp_path / "inbox"
    shutil.copytree(folder, inbox)
    seen: list[tuple[int, str]] = []

    def keep(df, batch):
        seen.extend((batch, repr(r)) for r in df.collect())

    def fail(df, batch):
        raise RuntimeError("killed")

    for _ in range(5):
        assert stream(spark, inbox, tmp_path, keep, maxFilesPerTrigger=3).awaitTermination(120)
    assert sorted(r for _, r in seen) == rows(whole(spark, inbox)) and len({b for b, _ in seen}) == 3
    before = len(seen)
    (inbox / "later.docx").write_bytes(SHAPES["correct.docx"])
    (inbox / "latest.docx").write_bytes(SHAPES["wrong_font.docx"])
    with pytest.raises(Exception, match="killed"):
        stream(spark, inbox, tmp_path, fail).awaitTermination(120)
    (inbox / "last.docx").write_bytes(SHAPES["wrong_font.docx"])  # comes after the batch that failed was planned
    for _ in range(3):
        assert stream(spark, inbox, tmp_path, keep).awaitTermination(120)
    assert len(seen) == before + 3 and sorted(r for _, r in seen) == rows(whole(spark, inbox))
    entries = [json.loads(p.read_text()) for p in sorted((tmp_path / "log").glob("*.json"))]
    names = [path for e in entries for path, _ in e]
    assert len(names) == len(set(names)) == len(seen)


def test_an_entry_that_spark_did_not_see_is_read_once(spark, folder, tmp_path):
    log = word.Log(str(tmp_path / "log"))
    log.add(word.Folder(str(folder)).documents()[:2])  # written, then the driver died
    seen = []
    assert stream(spark, folder, tmp_path, lambda df, _: seen.extend(map(repr, df.collect()))).awaitTermination(120)
    assert sorted(seen) == rows(whole(spark, folder))


# archives


def test_every_part_is_held_against_its_checksum(spark, tmp_path):
    whole_file = docx(para("a"), extra={"word/media/a.bin": bytes(range(256)) * 400, "docProps/thumbnail.jpeg": b"x" * 50})
    assert D.decoded(whole_file)["paragraphs"][0]["text"] == "a"
    for name in ("word/media/a.bin", "word/document.xml", "docProps/thumbnail.jpeg"):
        with zipfile.ZipFile(io.BytesIO(whole_file)) as z:
            info = z.getinfo(name)
            at = info.header_offset + 30 + len(name) + info.compress_size // 2
        broken = bytearray(whole_file)
        broken[at] ^= 0x55
        with pytest.raises(D.Rejected) as e:
            D.decoded(bytes(broken))
        assert e.value.code == "corrupted_document"
    short = whole_file[: len(whole_file) // 2]
    with pytest.raises(D.Rejected, match="can't be opened"):
        D.decoded(short)


# tables


def cell(text, width=1, merge=None, inner=""):
    props = (f'<w:gridSpan w:val="{width}"/>' if width > 1 else "") + {None: "", "restart": '<w:vMerge w:val="restart"/>', "continue": "<w:vMerge/>"}[merge]
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{inner}<w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


def drawn(rng, height, width):
    """A random grid of rectangles: which cell covers each place, and its XML."""
    owner = [[None] * width for _ in range(height)]
    n = 0
    for r in range(height):
        for c in range(width):
            if owner[r][c] is None:
                wide = 1
                while c + wide < width and owner[r][c + wide] is None and rng.random() < 0.4:
                    wide += 1
                tall = 1
                while r + tall < height and all(owner[r + tall][c + k] is None for k in range(wide)) and rng.random() < 0.4:
                    tall += 1
                for i in range(tall):
                    for k in range(wide):
                        owner[r + i][c + k] = (n, r, c, tall, wide)
                n += 1
    xml = ""
    for r in range(height):
        xml += "<w:tr>"
        for c in range(width):
            k, top, left, tall, wide = owner[r][c]
            if c == left:
                xml += cell(f"c{k}", wide, None if tall == 1 else "restart" if r == top else "continue")
        xml += "</w:tr>"
    return owner, f"<w:tbl>{xml}</w:tbl>"


def test_cells_by_brute_force(spark, tmp_path):
    rng = random.Random(4)
    grids = [drawn(rng, rng.randrange(1, 7), rng.randrange(1, 6)) for _ in range(12)]
    (tmp_path / "t.docx").write_bytes(docx(para("a") + "".join(x for _, x in grids)))
    cells = D.cells(D.read_docx(spark, str(tmp_path)))
    got = {(r.table, r.row, r.col): r for r in cells.collect()}
    want = {(t, top, left): (f"c{k}", tall, wide) for t, (owner, _) in enumerate(grids) for line in owner for k, top, left, tall, wide in line}
    assert {k: (r.text, r.row_span, r.col_span) for k, r in got.items()} == want and {r.parent for r in got.values()} == {None}
    places = {(r.table, r.row, r.col): r.text for r in D.grid(cells).collect()}
    assert places == {(t, r, c): f"c{owner[r][c][0]}" for t, (owner, _) in enumerate(grids) for r in range(len(owner)) for c in range(len(owner[0]))}


def test_nested_tables_and_odd_rows():
    inner = f"<w:tbl><w:tr>{cell('in')}{cell('ner')}</w:tr></w:tbl>"
    shifted = f'<w:tr><w:trPr><w:gridBefore w:val="1"/></w:trPr>{cell("late", merge="continue")}</w:tr>'
    d = D.decoded(docx(f"<w:tbl><w:tr>{cell('a', inner=inner)}{cell('b', merge='restart')}</w:tr>{shifted}<w:tr>{cell('x', 2, 'continue')}</w:tr></w:tbl><w:tbl><w:tr>{cell('z')}</w:tr></w:tbl>"))
    got = [(c["table"], c["parent"], c["row"], c["col"], c["row_span"], c["col_span"], c["text"]) for c in d["cells"]]
    assert got == [(0, None, 0, 0, 1, 1, "a"), (1, 0, 0, 0, 1, 1, "in"), (1, 0, 0, 1, 1, 1, "ner"), (0, None, 0, 1, 2, 1, "b"), (0, None, 2, 0, 1, 2, "x"), (2, None, 0, 0, 1, 1, "z")]
    assert d["table_count"] == 2 and D.decoded(docx(para("a")))["cells"] == []

"""Character maps of fonts and the marks of what they can't show; stages told by a running stream."""

import json
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import jobs, report
from folio.sources import fonts
from folio.streaming import checks as C
from folio.streaming import progress


def font(maps):
    """A font file with nothing but a character map; maps: (platform, encoding) and the table's bytes."""
    head = 4 + 8 * len(maps)
    cmap, at = struct.pack(">HH", 0, len(maps)), head
    for (platform, encoding), table in maps:
        cmap += struct.pack(">HHI", platform, encoding, at)
        at += len(table)
    cmap += b"".join(t for _, t in maps)
    return struct.pack(">IHHHH", 0x00010000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap


def format4(segments, glyphs=None):
    """segments: (low, high, delta); glyphs: for segments by table, glyph numbers."""
    segments = [*segments, (0xFFFF, 0xFFFF, 1)]
    n, glyphs = len(segments), glyphs or {}
    ranges, array = [], []
    for i in range(n):
        if i in glyphs:
            ranges.append(2 * (n - i + len(array)))
            array += glyphs[i]
        else:
            ranges.append(0)
    pack = lambda xs: struct.pack(f">{len(xs)}H", *(x & 0xFFFF for x in xs))
    body = pack([s[1] for s in segments]) + b"\0\0" + pack([s[0] for s in segments]) + pack([s[2] for s in segments]) + pack(ranges) + pack(array)
    return struct.pack(">HHHHHHH", 4, 14 + len(body), 0, 2 * n, 0, 0, 0) + body


def format12(groups):
    return struct.pack(">HHIII", 12, 0, 16 + 12 * len(groups), 0, len(groups)) + b"".join(struct.pack(">III", *g) for g in groups)


def test_maps_are_read():
    assert fonts.intervals(font([((3, 1), format4([(32, 126, -31), (0x400, 0x45F, 5)]))])) == [(32, 126), (0x400, 0x45F)]
    by_table = format4([(65, 70, 0), (71, 75, 10)], {0: [3, 0, 4, 5, 0, 6]})
    assert fonts.intervals(font([((0, 3), by_table)])) == [(65, 65), (67, 68), (70, 75)]
    wide = format12([(32, 40, 0), (0x1F600, 0x1F64F, 90), (50, 60, 7), (61, 61, 9)])
    assert fonts.intervals(font([((3, 1), format4([(32, 126, -31)])), ((3, 10), wide)])) == [(33, 40), (50, 61), (0x1F600, 0x1F64F)]
    for bad in (b"", b"nothing", font([((1, 0), b"\0\0")]), font([((3, 1), b"\0\x06")])):
        with pytest.raises(ValueError):
            fonts.intervals(bad)


def test_common_intervals_by_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([(x, x + rng.randrange(4)) for x in rng.sample(range(60), 8)] for _ in range(2))
        sets = [{p for low, high in i for p in range(low, high + 1)} for i in (a, b)]
        got = fonts.common(fonts.joined(a), fonts.joined(b))
        assert {p for low, high in got for p in range(low, high + 1)} == sets[0] & sets[1]
        assert fonts.joined(got) == got


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("fonts")
    latin, cyrillic = (32, 126, 1), (0x400, 0x4FF, 200)
    (f / "regular.ttf").write_bytes(font([((3, 10), format12([latin, cyrillic, (0x1F600, 0x1F600, 900)]))]))
    (f / "bold.ttf").write_bytes(font([((3, 10), format12([latin, cyrillic]))]))
    (f / "latin.otf").write_bytes(font([((3, 1), format4([(32, 126, -31)]))]))
    (f / "broken.ttf").write_bytes(b"no")
    return f


def test_what_fonts_lack_is_marked(spark, folder):
    table = fonts.coverage(spark, str(folder)).withColumn("font", F.element_at(F.split("font", "/"), -1)).cache()
    assert {r.font for r in table.select("font").distinct().collect()} == {"regular.ttf", "bold.ttf", "latin.otf"}
    both = fonts.shown_by(table, "regular.ttf", "bold.ttf")
    assert both == [(32, 126), (0x400, 0x4FF)]
    with pytest.raises(ValueError, match="lack"):
        fonts.shown_by(table, "latin.otf")
    texts = spark.createDataFrame([("a<b> Қазақ é́x",), ("😀\n漢​️",), (None,), ("",)], "t string")
    got = [r.t for r in texts.select(report.print_text("t", both).alias("t")).collect()]
    assert got == ["a&lt;b&gt; Қазақ [U+00E9][U+0301]x", "[U+1F600] [U+6F22]", None, ""]
    assert [r.t for r in texts.select(report.print_text("t").alias("t")).collect()][1] == "😀 漢"
    lost = {(r.font, chr(r.code)): r.n for r in fonts.unshown(texts, "t", table).where("font <> 'latin.otf'").collect()}
    assert lost.keys() == {(f, c) for f in ("regular.ttf", "bold.ttf") for c in "é́\n漢​️"} | {("bold.ttf", "😀")} and set(lost.values()) == {1}


def test_stages_of_a_running_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    listener = progress.StageListener(spark, f"file://{tmp_path}/events")
    spark.streams.addListener(listener)
    try:
        for name, ids in (("a", (1, 2, 3)), ("b", (4,))):
            (tmp_path / "in" / name).write_text("\n".join(json.dumps({"check_id": i}) for i in ids))
            s = C.inbox(spark, str(tmp_path / "in"), "check_id long")
            s = progress.at_stage(progress.at_stage(s, "structure").where("check_id <> 2"), "formatting")
            assert C.dispatched(progress.at_stage(s.where("check_id > 3"), "report"), lambda df, _: df.count(), str(tmp_path / "cp"), None).awaitTermination(120)
        for _ in range(50):
            if len(listener.files.names()) == 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = {r.check_id: (r.stage, r.message_key) for r in jobs.progress(progress.events(spark, f"{tmp_path}/events")).collect()}
    assert got == {"1": ("formatting", "progress.formatting"), "2": ("structure", "progress.structure"), "3": ("formatting", "progress.formatting"), "4": ("report", "progress.report")}
    with pytest.raises(ValueError):
        progress.at_stage(s, "lunch")

"""Which characters a font can show, as intervals of code points read from its character map."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COVERAGE = "font string, low int, high int"
# Fixed value: letters without which a font is of no use here.
NEEDED = "ӘәҒғҚқҢңӨөҰұҮүҺһІіЁёРусскийҚазақEnglish"
#: Tables of the character map that hold Unicode, best first: (platform, encoding).
_UNICODE = ((3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0))


def joined(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals without overlap and gap, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(points):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def common(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What two fonts both show."""
    out, i, k = [], 0, 0
    while i < len(a) and k < len(b):
        low, high = max(a[i][0], b[k][0]), min(a[i][1], b[k][1])
        if low <= high:
            out.append((low, high))
        if a[i][1] < b[k][1]:
            i += 1
        else:
            k += 1
    return out


def _segments(table: bytes) -> Iterator[tuple[int, int]]:
    """Format 4: segments of the basic plane; a code whose glyph is 0 is not shown."""
    n = struct.unpack_from(">H", table, 6)[0] // 2
    ends, starts, deltas, ranges = (struct.unpack_from(f">{n}H", table, at) for at in (14, 16 + 2 * n, 16 + 4 * n, 16 + 6 * n))
    for i, (low, high, delta, offset) in enumerate(zip(starts, ends, deltas, ranges, strict=True)):
        for code in range(low, min(high, 0xFFFE) + 1):
            if offset:
                at = 16 + 6 * n + 2 * i + offset + 2 * (code - low)
                glyph = struct.unpack_from(">H", table, at)[0] if at + 2 <= len(table) else 0
                glyph = (glyph + delta) & 0xFFFF if glyph else 0
            else:
                glyph = (code + delta) & 0xFFFF
            if glyph:
                yield code, code


def _groups(table: bytes) -> Iterator[tuple[int, int]]:
    """Format 12: groups of consecutive codes and glyphs; only a group's first glyph can be 0."""
    for i in range(struct.unpack_from(">I", table, 12)[0]):
        low, high, glyph = struct.unpack_from(">III", table, 16 + 12 * i)
        if low + (glyph == 0) <= min(high, 0x10FFFF):
            yield low + (glyph == 0), min(high, 0x10FFFF)


def intervals(font: bytes) -> list[tuple[int, int]]:
    """The code points that a TrueType or OpenType font shows; ValueError if it has no Unicode map that can be read."""
    try:
        tables = {font[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">II", font, 20 + 16 * i) for i in range(struct.unpack_from(">H", font, 4)[0])}
        at, size = tables[b"cmap"]
        cmap = font[at : at + size]
        maps = {struct.unpack_from(">HH", cmap, 4 + 8 * i): struct.unpack_from(">I", cmap, 8 + 8 * i)[0] for i in range(struct.unpack_from(">H", cmap, 2)[0])}
        for key in _UNICODE:
            if key in maps:
                kind = struct.unpack_from(">H", cmap, maps[key])[0]
                if kind in (4, 12):
                    return joined(list((_segments if kind == 4 else _groups)(cmap[maps[key] :])))
    except (KeyError, struct.error) as e:
        raise ValueError("the font can't be read") from e
    raise ValueError("the font has no Unicode map")


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """font (the path), low and high of each interval of the fonts below path; what is no font is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = intervals(bytes(content))
                except ValueError:
                    continue
                yield pd.DataFrame({"font": name, "low": [a for a, _ in rows], "high": [b for _, b in rows]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ttf,otf,TTF,OTF}").load(path)
    return files.select("path", "content").mapInPandas(run, COVERAGE)


def shown_by(covered: DataFrame, *fonts: str) -> list[tuple[int, int]]:
    """What all these fonts show (a text may stand in bold), from a table of coverage; ValueError where that lacks a needed letter."""
    rows = covered.where(F.col("font").isin(*fonts)).collect()  # some thousand intervals a font
    out: list[tuple[int, int]] | None = None
    for f in fonts:
        own = joined([(r["low"], r["high"]) for r in rows if r["font"] == f])
        out = own if out is None else common(out, own)
    if lost := sorted(c for c in set(NEEDED) if not any(a <= ord(c) <= b for a, b in out or [])):
        raise ValueError(f"the fonts lack {''.join(lost)}")
    return out or []


def unshown(texts: DataFrame, column: str, covered: DataFrame) -> DataFrame:
    """font, code and n: the code points of a column that a font does not show, and how often they occur.

    Each text's characters are counted before anything is joined, so at most all code points of Unicode meet the intervals of the fonts."""
    points = texts.select(F.explode(F.split(F.col(column), "")).alias("c")).where("c <> ''").groupBy(F.ascii("c").alias("code")).agg(F.count("*").alias("n"))
    fonts = covered.select("font").distinct()
    held = points.join(F.broadcast(covered), F.col("code").between(F.col("low"), F.col("high"))).select("font", "code")
    return points.join(F.broadcast(fonts), F.lit(True)).join(held, ["font", "code"], "left_anti").select("font", "code", "n")

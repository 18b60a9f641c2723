"""Benchmark decontamination by Wu-Manber search for windows of words.

Every window of 10 consecutive words of a benchmark item is a pattern (a shorter item is one pattern
of its own length). Symbols are words; blocks are pairs of words. A shift table tells how far the
scan may jump from a block, so nine of ten positions are never looked at; a block that ends patterns
leads to the bucket of those patterns, and the words themselves are compared.

The patterns are sent to all tasks in groups of items whose texts stay under GROUP_BYTES together;
a larger benchmark is searched group after group over all documents, without any shuffle.

Edge cases: null and empty texts have no words; items without words have no patterns; null item ids
are skipped; items with equal windows are all reported; repeated rows are judged each."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import tokens
from folio.llm.base import LOWER, UPPER

WINDOW = 10
#: Bytes of benchmark text that one search holds in memory.
GROUP_BYTES = 8 << 20


def split_words(text: str | None) -> list[bytes]:
    for _, _, data, offsets in tokens.pieces(pa.array([text or ""])):
        w = tokens.words(data, offsets, tokens.ALNUM)
        return [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    return []


class Patterns:
    """Shift tables and buckets of word patterns, one set for each pattern length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = split_words(text)
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                owners[tuple(w[i : i + size])].add(item)
        self.tables: list[tuple[int, int, dict, dict]] = []
        for size in sorted({len(p) for p in owners}):
            block = min(2, size)
            shift: dict[tuple[bytes, ...], int] = {}
            bucket: dict[tuple[bytes, ...], list] = defaultdict(list)
            for p, own in owners.items():
                if len(p) == size:
                    for i in range(size - block + 1):
                        at = p[i : i + block]
                        shift[at] = min(shift.get(at, size), size - block - i)
                    bucket[p[size - block :]].append((p, tuple(sorted(own))))
            self.tables.append((size, block, shift, dict(bucket)))

    def coded(self) -> list[tuple[int, int, dict[int, int], dict[int, list]]]:
        """The tables with blocks as hashes, as documents give them."""

        def code(block: tuple[bytes, ...]) -> int:
            data = np.frombuffer(b"".join(block), np.uint8)
            ends = np.cumsum([len(x) for x in block])
            h = tokens.Words(data, ends - [len(x) for x in block], ends, np.array([0, len(block)])).hashes()
            return int(pair(h)[-1] if len(block) == 2 else h[0])

        return [(size, block, {code(b): s for b, s in shift.items()}, {code(b): p for b, p in bucket.items()}) for size, block, shift, bucket in self.tables]


def pair(hashes):
    """The hash of each word with the word before it; the first has none."""
    out = hashes.copy()
    with np.errstate(over="ignore"):
        out[1:] += hashes[:-1] * tokens.powers(2)[1]
    return out


def search(hashes: list[int], pairs: list[int], first: int, last: int, table: tuple, word) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(position, items) of each pattern that lies in the words from first up to last."""
    size, block, shift, bucket = table
    codes, far = (pairs if block == 2 else hashes), size - block + 1
    at = first + size - 1
    get = shift.get
    while at < last:
        jump = get(codes[at], far)
        if jump:
            at += jump
            continue
        begin = at - size + 1
        for pattern, items in bucket.get(codes[at], ()):
            if all(word(begin + i) == w for i, w in enumerate(pattern)):
                yield begin, items
        at += 1


def scan(tables: list[tuple], keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits, items = [], [], []
            before = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for start, _, data, offsets in tokens.pieces(batch.column("text")):
                w = tokens.words(data, offsets, tokens.ALNUM)
                h = w.hashes()
                pairs, hl = pair(h).tolist(), h.tolist()
                word = lambda i, w=w: w.data[w.start[i] : w.end[i]].tobytes()
                first = w.first.tolist()
                for d in range(len(first) - 1):
                    a, b = first[d], first[d + 1]
                    found, names = set(before[0][start + d]), set(before[1][start + d])
                    for table in tables:
                        for at, own in search(hl, pairs, a, b, table, word):
                            found.update(range(at - a, at - a + table[0]))
                            names.update(own)
                    counts.append(b - a)
                    hits.append(sorted(found))
                    items.append(sorted(names))
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            if keep_text:
                columns["text"] = batch.column("text")
            yield pa.RecordBatch.from_pydict(columns)

    return run


def item_groups(benchmark: DataFrame, limit: int = GROUP_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in groups of bounded size, taken by the driver one after another."""
    b = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    for g in range(n):
        # Items go to groups by hash; twice the needed number of groups keeps each under the limit.
        yield [tuple(r) for r in b.where(F.pmod(F.xxhash64("item"), F.lit(n)) == g).toLocalIterator()]


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, hits (positions of words inside occurrences) and items (ids as strings)."""
    df = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    key = df.schema["doc_id"].dataType.simpleString()
    groups = item_groups(benchmark, group_bytes)
    group = next(groups)
    while group is not None:
        after = next(groups, None)
        last = after is None
        tables = Patterns(group, window).coded()
        df = df.mapInArrow(scan(tables, not last), f"doc_id {key}, n_words long, hits array<int>, items array<string>" + ("" if last else ", text string"))
        group = after
    return df


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurrence of a benchmark window; columns as before, no shuffle."""

    def kept(tables: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for _, _, data, offsets in tokens.pieces(batch.column("text")):
                    w = tokens.words(data, offsets, tokens.ALNUM)
                    h = w.hashes()
                    pairs, hl, first = pair(h).tolist(), h.tolist(), w.first.tolist()
                    word = lambda i, w=w: w.data[w.start[i] : w.end[i]].tobytes()
                    for a, b in zip(first, first[1:], strict=False):
                        ok.append(not any(next(search(hl, pairs, a, b, table, word), None) for table in tables))
                yield batch.filter(pa.array(ok, pa.bool_()))

        return run

    for group in item_groups(benchmark):
        docs = docs.mapInArrow(kept(Patterns(group, window).coded()), docs.schema)
    return docs


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = searched(docs, benchmark)
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def digest_sql(docs: str = "documents", benchmark: str = "benchmark") -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = lambda c: f"translate(coalesce({c}, ''), '{UPPER}', '{LOWER}')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower("text")}, '{word}') AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all({lower("text")}, '{word}') AS w FROM {benchmark} WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
      FROM b, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS t(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM p),
o AS (SELECT doc_id, i, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS g FROM d, s, unnest(generate_series(1, len(w) - s.size + 1)) AS t(i)),
h AS (SELECT doc_id, i, o.size, item_id FROM o JOIN p ON o.size = p.size AND o.g = p.g),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM h), unnest(generate_series(0, size - 1)) AS t(k) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

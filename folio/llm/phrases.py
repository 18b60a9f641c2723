"""Collocations from count tries.

A text is lower-cased (A-Z), cut into pieces and these into words. Each task grows a count trie of limited
depth over its texts, language at the root, and writes its nodes sorted by path. Ranges of paths, cut by
Spark's sampling, go to one task each, which merges the sorted runs of all shards by adding counts. The
trie grows level by level: a node of one more word is only counted where both the words before its
last and the words after its first may be frequent, as a filter of fixed size over the level above says
(which can err only by letting more through). Counts that reach LEAST are thus exact.

A walk over the frequent nodes in the order of their paths gives each node the counts of its left parts: its ancestors,
which stand before it. A range that begins below an ancestor is handed the ancestor's count. Suffix links give the
right parts: the node of all words but the first, which has its own right parts already. Scores are quotients of whole
numbers in decimal arithmetic.

Edge cases: null texts and texts without words have no phrases; null lang counts as `und`, together with rows that
say so; repeated rows count each; ties are ranked by count and then by phrase; a language without candidates
has no rows; an empty table gives no rows; other columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm import tokens
from folio.llm.base import LOWER, UPPER, shuffle_parts, stage, unstage

#: Words of the longest phrases, the least count of a candidate, phrases reported for each language.
LONGEST, LEAST, TOP = 3, 10, 2000
#: A candidate goes if a longer one holds it with at least so many hundredths of its count.
INSIDE = 50
SCALE = 1_000_000
UNKNOWN = "und"
#: Bits of the filter: 16 MB, sent to all tasks whatever the corpus.
FILTER_BITS = 1 << 27
#: Bytes of words that a task's trie may hold before its nodes are written.
HELD = 16 << 20
#: Bytes that end a piece and bytes that part words: fixed values.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORDS = ~ENDS
WORDS[[9, 32]] = False
NODE = "lang string, path array<string>, n long"


class Held:
    """Words of some texts as numbers into one table of distinct words, with what follows them."""

    def __init__(self) -> None:
        self.runs: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> None:
        w = tokens.words(data, offsets, WORDS)
        if not len(w.start):
            return
        size = w.end - w.start
        at = np.r_[0, np.cumsum(size)]
        inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
        text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(w.data[inside + np.repeat(w.start, size)])])
        owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        ended = np.r_[0, np.cumsum(ENDS[w.data])]
        joined = np.zeros(len(size), bool)  # the next word is of the same piece
        joined[:-1] = (owner[1:] == owner[:-1]) & (ended[w.start[1:]] == ended[w.end[:-1]])
        self.runs.append((text.dictionary_encode(), lang[owner], joined))
        self.size += int(at[-1]) + 8 * len(size)

    def flushed(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words in byte order, and for each word its place there, its language and whether the next belongs to its piece."""
        words = pa.chunked_array([d for d, _, _ in self.runs]).unify_dictionaries()
        names = words.chunk(0).dictionary
        order = np.asarray(pc.sort_indices(names))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[np.concatenate([np.asarray(c.indices) for c in words.chunks]).astype(np.int64)]
        out = names.take(pa.array(order)), code, np.concatenate([x for _, x, _ in self.runs]), np.concatenate([x for _, _, x in self.runs])
        self.runs, self.size = [], 0
        return out


def gram_hashes(seed: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of some words one after another in their language."""
    with np.errstate(over="ignore"):
        h = seed.copy()
        for x in hashes:
            h = tokens.mixed(h * np.uint64(0x9E3779B97F4A7C15) + x)
    return h


def byte_hashes(a: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some binaries."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    out = np.zeros(len(a), np.uint64)
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    if len(full):
        inside = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
        with np.errstate(over="ignore"):
            spread = (data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)) * tokens.powers(int(size.max()))[inside]
            out[full] = np.add.reduceat(spread, (offsets[:-1] - offsets[0])[full])
    return tokens.mixed(out + size.astype(np.uint64))


def passes(seen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(FILTER_BITS)).astype(np.int64)
    return (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def nodes(held: Held, langs: list[str], depth: int, seen: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Sorted nodes of the trie with depth words; where seen is given, only those whose parts may be frequent."""
    names, code, lang, joined = held.flushed()
    k = len(code)
    at = np.arange(k)
    for step in range(depth - 1):  # positions where depth words follow in one piece
        at = at[at + step < k - 1]
        at = at[joined[at + step]]
    if seen is not None and len(at):
        word, tongue = byte_hashes(names), byte_hashes(pa.array([x.encode() for x in langs], pa.binary()))
        part = lambda low: gram_hashes(tongue[lang[at]], [word[code[at + i]] for i in range(low, low + depth - 1)])
        at = at[passes(seen, part(0)) & passes(seen, part(1))]
    if not len(at):
        return
    # Level by level: a node is its parent's number and a word, in the order of paths.
    level, owner = np.unique(lang[at], return_inverse=True)
    paths: list[np.ndarray] = []
    for i in range(depth):
        key, owner, n = np.unique(owner * np.int64(len(names)) + code[at + i], return_inverse=True, return_counts=True)
        parent = key // len(names)
        level, paths = level[parent], [p[parent] for p in paths] + [key % len(names)]
    flat = np.stack(paths, axis=1)
    for low in range(0, len(n), 100_000):
        cut = flat[low : low + 100_000]
        text = names.take(pa.array(cut.ravel())).view(pa.string())
        path = pa.ListArray.from_arrays(pa.array(np.arange(len(cut) + 1, dtype=np.int32) * depth), text)
        yield pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(level[low : low + 100_000])), path, pa.array(n[low : low + 100_000].astype(np.int64))], ["lang", "path", "n"])


def shard_task(depths: tuple[int, ...], shared=None):
    """The sorted nodes of a shard's trie, with the given numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared and np.frombuffer(shared.value, np.uint8)
        langs: dict[str, int] = {}
        held = Held()

        def written() -> Iterator[pa.RecordBatch]:
            runs = held.runs
            for depth in depths:
                held.runs = list(runs)
                yield from nodes(held, list(langs), depth, seen)
            held.runs, held.size = [], 0

        for batch in batches:
            own = batch.column("lang").to_pylist()
            lang = np.array([langs.setdefault(x, len(langs)) for x in own], np.int64)
            for low, high, data, offsets in tokens.pieces(batch.column("text")):
                held.add(data, offsets, lang[low:high])
                if held.size > HELD:
                    yield from written()
        if held.runs:
            yield from written()

    return run


def merged(docs: DataFrame, depths: tuple[int, ...], least: int, shared=None) -> DataFrame:
    """Frequent nodes of all shards' tries: ranges of paths merge the sorted runs of all shards."""
    runs = stage(docs.mapInArrow(shard_task(depths, shared), NODE), "phrase-runs")
    ranges = runs.repartitionByRange(shuffle_parts(docs.sparkSession), "lang", "path").sortWithinPartitions("lang", "path")
    out = stage(ranges.groupBy("lang", "path").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrase-nodes")
    unstage(runs)
    return out


def hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter position of each node."""
    for batch in batches:
        path = batch.column("path")
        depth = len(path[0]) if len(path) else 0
        word = byte_hashes(path.flatten().cast(pa.binary())).reshape(-1, depth) if depth else np.zeros((0, 1), np.uint64)
        h = gram_hashes(byte_hashes(batch.column("lang").cast(pa.binary())), list(word.T)) if depth else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(FILTER_BITS)).astype(np.int64))], ["bit"])


def frequent_filter(level: DataFrame) -> bytes:
    """A bit for each node of one level: at most FILTER_BITS / 8 bytes come to the driver, in pieces of one aggregate row each."""
    bits = level.select("lang", "path").mapInArrow(hash_task, "bit long")
    piece = 1 << 15
    rows = bits.groupBy(F.floor(F.col("bit") / piece).alias("piece")).agg(F.bitmap_construct_agg((F.col("bit") % piece)).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.toArrow().to_pylist():
        out[r["piece"] * (piece // 8) : (r["piece"] + 1) * (piece // 8)] = r["bits"]
    return bytes(out)


def left_task(shared):
    """Counts of the left parts, longest last: nodes come in the order of their paths, ancestors before what is below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: list[int] = []  # counts on the way from the root
        part = None
        for batch in batches:
            lefts = []
            for p, path, n in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "n")), strict=True):
                if p != part:
                    part, above = p, list(shared.value.get(p, []))
                del above[len(path) - 1 :]
                lefts.append(list(above))
                above.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "path", "n")), pa.array(lefts, pa.list_(pa.int64()))], ["lang", "path", "n", "lefts"])

    return run


def walked(trie: DataFrame) -> DataFrame:
    """Adds lefts: the counts of the first word, of the first two and so on."""
    order, parts = ["lang", "path"], shuffle_parts(trie.sparkSession)
    cut = stage(trie.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "phrase-ranges")
    first = cut.groupBy("part").agg(F.min(F.struct(*order)).alias("first")).where(F.size("first.path") > 1)
    above = first.select("part", F.col("first.lang").alias("lang"), F.explode(F.transform(F.sequence(F.lit(1), F.size("first.path") - 1), lambda i: F.slice("first.path", 1, i))).alias("path"))
    # At most LONGEST - 1 ancestors for each range.
    counts = trie.join(F.broadcast(above), order).groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.size("path").alias("depth"), "n"))), lambda x: x["n"]).alias("counts"))
    handed = {r["part"]: r["counts"] for r in counts.collect()}
    rows = cut.repartition(parts, "part").sortWithinPartitions("part", *order)
    return rows.mapInArrow(left_task(trie.sparkSession.sparkContext.broadcast(handed)), f"{NODE}, lefts array<long>")


def linked(trie: DataFrame, longest: int) -> DataFrame:
    """Adds rights: the counts of the node's suffixes, longest first, by links from each level to the one above."""
    level = trie.where(F.size("path") == 1).withColumn("rights", F.array().cast("array<bigint>"))
    levels = []
    for depth in range(2, longest + 1):
        suffix = level.select("lang", F.col("path").alias("suffix"), F.concat(F.array("n"), "rights").alias("rights"))
        own = trie.where(F.size("path") == depth).withColumn("suffix", F.slice("path", 2, depth - 1))
        level = stage(own.join(suffix.hint("merge"), ["lang", "suffix"]).drop("suffix"), "phrase-links")
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def scored(linked_nodes: DataFrame) -> DataFrame:
    """Adds l, r and score of the lowest cut."""
    big = lambda c: c.cast("decimal(38,0)")
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda x, k: F.struct(F.call_function("div", big(F.col("n")) * big(F.col("n")) * big(F.lit(SCALE)), big(x["lefts"]) * big(x["rights"])).alias("score"), k.alias("k"), x["lefts"].alias("l"), x["rights"].alias("r")))
    return linked_nodes.withColumn("cut", F.array_min(cuts)).select("lang", "path", "n", "cut.score", "cut.l", "cut.r")


def outermost(candidates: DataFrame, longest: int) -> DataFrame:
    """Candidates that no longer candidate holds with at least INSIDE hundredths of their count."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("path") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("path") - k + 1), lambda i: F.slice("path", i, k))))
    within = candidates.where(F.size("path") > 2).select("lang", F.explode(inner).alias("path"), "n").groupBy("lang", "path").agg(F.max("n").alias("longer"))
    both = candidates.join(within.hint("merge"), ["lang", "path"], "left")
    return both.where(~F.coalesce(F.col("longer") * 100 >= F.col("n") * INSIDE, F.lit(False))).drop("longer")


def mined(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to longest words."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # Single words stay whole, for the sum of all occurrences.
    words = merged(docs, (1,), 1)
    totals = words.groupBy("lang").agg(F.sum("n").alias("all")).withColumnRenamed("lang", "_lang")
    trie = level = words.where(F.col("n") >= least)
    for depth in range(2, longest + 1):
        level = merged(docs, (depth,), least, spark.sparkContext.broadcast(frequent_filter(level)))
        trie = trie.unionByName(level)
    candidates = stage(scored(linked(stage(walked(trie), "phrase-walk"), longest)), "phrase-scores")
    best = outermost(candidates, longest).withColumn("phrase", F.array_join("path", " "))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase"))).where(F.col("rank") <= top)
    # As many rows as languages.
    out = best.join(totals, F.col("lang") == F.col("_lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("all").alias("n"), "score")


def mined_sql(docs: str = "documents", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> str:
    """The same rows for DuckDB."""
    grams = " UNION ALL ".join(f"SELECT lang, words[i:i+{k - 1}] AS path FROM w, unnest(generate_series(1, len(words) - {k - 1})) AS t(i)" for k in range(1, longest + 1))
    inner = " UNION ALL ".join(f"SELECT lang, path[i:i+{k - 1}] AS path, a FROM c, unnest(generate_series(1, len(path) - {k - 1})) AS t(i) WHERE len(path) > {k}" for k in range(2, longest))
    return rf"""
WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM {docs}),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
f AS (SELECT lang, path, count(*) AS a FROM ({grams}) GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(path) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(path) > 1 AND a >= {least}),
cut AS (SELECT c.lang, c.path, c.a, k, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score
        FROM c, unnest(generate_series(1, len(c.path) - 1)) AS t(k) JOIN f l ON l.lang = c.lang AND l.path = c.path[1:k] JOIN f r ON r.lang = c.lang AND r.path = c.path[k+1:]),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, path ORDER BY score, k) = 1),
longer AS (SELECT lang, path, max(a) AS most FROM ({inner}) GROUP BY ALL),
kept AS (SELECT low.*, array_to_string(low.path, ' ') AS phrase FROM low LEFT JOIN longer USING (lang, path) WHERE NOT coalesce(100 * most >= {INSIDE} * a, false))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= {top}"""

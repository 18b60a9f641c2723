"""Substring dedup: fuzzy passages found by chaining k-mer seeds.

Seeds are minimizers: of every WINDOW consecutive k-mers of words the one that hashes lowest, so two
texts that share K + WINDOW - 1 words in a row share a seed. Each seed is joined to its first
occurrence, the one of least doc_id, never to all others: matches grow with the text, not with the
square of a passage's copies. For each text and first text, runs of matches on a diagonal are
segments; segments are chained in both orders with a cost for gaps, by a Fenwick tree over the first
text's positions. A chain is aligned segment by segment: words that differ on a segment's diagonal and the
gaps between segments are compared by themselves, by pairs of equal words or by whole integers of bits, so a gap of some
words costs as much as its longer side. Chains grow at both ends, which also joins what other first occurrences took out of a chain. Where
the seeds of a run have first occurrences in several documents, no chain may show who has the whole run: runs
of repeated seeds that no passage covers are searched again by their grams of MIN_WORDS words, each joined to
the first document that has it. So each exact repeat of MIN_WORDS words is found, whatever else holds parts of
it. A passage is reported by the document that repeats it and the first document that has it, with its place in
both; a passage that a text repeats itself is reported too (first_id is doc_id), from MIN_WORDS words on.

Edge cases: null and empty texts and texts under K words have no seeds; passages under MIN_WORDS words
are not reported; a repeated row repeats no more than its first; rows that share an id are texts of their own (each
is told by a hash of its text) and one may repeat the other; rows without an id are left out; ids are whole
numbers, or strings of their digits, others fail; an empty table gives no rows; other columns are not
looked at. Positions count words from 0."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm import tokens
from folio.llm.base import release, shuffle_parts, stage

K, WINDOW = 6, 8
MIN_WORDS = 50
#: Cost of a word of gap in either text; matched words that a chain needs.
GAP, MIN_CHAIN = 0.25, 12
#: Matches on a diagonal this near are one segment.
JOIN = 32
#: Words beyond a chain that the alignment may grow into; words that it may pass over there in either text, and that must agree after them.
MARGIN, SKIP, SURE = 96, 6, 3
#: Edits for each word that a passage may have.
EDITS = 0.4
#: Pairs of equal words for each word of two runs, up to which they are compared pair by pair; the result is the same beyond.
PAIRS = 64
#: A text is named by its id and the upper half of a spot, a hash of the text; the lower half is a word's position.
KEYS = ("doc_id", "mark", "first_id", "first_mark")
CHAIN = "doc_id long, mark long, first_id long, first_mark long, start int, stop int, first_start int, first_stop int, score double, parts array<int>"


def minimizers(values: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Marks the least value of each window of valid k-mers; the last of equals. Short runs have at least one."""
    n = len(values)
    key = np.where(ok, values, np.uint64(2**64 - 1))
    marked = np.zeros(n, bool)
    if not n:
        return marked
    # A window ends with its text: what follows an invalid k-mer is not part of it.
    end = np.minimum.accumulate(np.where(ok, n, np.arange(n))[::-1])[::-1]
    best, at = key, np.arange(n)
    size = 1
    while size < WINDOW:
        # A window of size + step is two of size, the later one taken where it has the least or an equal; short texts have shorter ones.
        step = min(size, WINDOW - size)
        take = (end[: max(n - step, 0)] > np.arange(step, max(n, step))) & (best[step:] <= best[: max(n - step, 0)])
        best = np.r_[np.where(take, best[step:], best[: max(n - step, 0)]), best[max(n - step, 0) :]]
        at = np.r_[np.where(take, at[step:], at[: max(n - step, 0)]), at[max(n - step, 0) :]]
        size += step
    marked[at[ok]] = True
    # The first and last k-mer of each text too, so that repeats at its ends have seeds however short.
    marked[1:] |= ok[1:] & ~ok[:-1]
    marked[:1] = True
    marked[:-1] |= ok[:-1] & ~ok[1:]
    marked[-1:] = True
    return marked & ok


def mark_of(text: Column) -> Column:
    """31 bits that tell apart the texts of rows that share an id."""
    return F.xxhash64(text).bitwiseAND((1 << 31) - 1)


def mark(spot: str) -> Column:
    return F.call_function("shiftright", F.col(spot), F.lit(32))


def place(spot: str) -> Column:
    return F.col(spot).bitwiseAND((1 << 32) - 1).cast("int")


def seed_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, doc_id, spot, lead): lead marks a seed's first place in its text."""
    for batch in batches:
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy() << 32
        for start, _, data, offsets in tokens.pieces(batch.column("text")):
            w = tokens.words(data, offsets)
            values, ok = tokens.grams(w.hashes(), w.first, K)
            at = np.flatnonzero(minimizers(values, ok))
            owner = np.searchsorted(w.first, at, "right") - 1
            v = values[at]
            order = np.lexsort((at, v, owner))
            lead = np.ones(len(at), bool)
            lead[order[1:]] = (v[order][1:] != v[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            yield pa.RecordBatch.from_arrays([tokens.longs(v), pa.array(ids[start + owner]), pa.array(marks[start + owner] + at - w.first[owner]), pa.array(lead)], ["seed", "doc_id", "spot", "lead"])


class Fenwick:
    """Prefix maxima over ranks, with who holds them."""

    def __init__(self, n: int) -> None:
        self.best = [(-1e300, -1)] * (n + 1)

    def put(self, rank: int, value: float, who: int) -> None:
        i = rank + 1
        while i < len(self.best):
            if self.best[i][0] < value:
                self.best[i] = value, who
            i += i & -i

    def upto(self, rank: int) -> tuple[float, int]:
        """The maximum over ranks below rank."""
        out, i = (-1e300, -1), rank
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def traced(x0: list[int], x1: list[int], y0: list[int], y1: list[int], weight: list[int]) -> list[tuple[list[int], float]]:
    """Best chains of segments [x0, x1) to [y0, y1): their segments in order, each used once, and their score."""
    n = len(x0)
    ends = sorted(set(y1))
    tree = Fenwick(len(ends))
    score, before = [0.0] * n, [-1] * n
    # A segment may follow those that end where it begins or earlier, so ends come before starts.
    events = sorted([(x1[i], 0, i) for i in range(n)] + [(x0[i], 1, i) for i in range(n)])
    for _, starts, i in events:
        if starts:
            value, who = tree.upto(bisect_left(ends, y0[i] + 1))
            gained = value - GAP * (x0[i] + y0[i])
            score[i], before[i] = (weight[i] + gained, who) if gained > 0 else (float(weight[i]), -1)
        else:
            tree.put(bisect_left(ends, y1[i]), score[i] + GAP * (x1[i] + y1[i]), i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        j, path = i, []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = before[j]
        last = path[-1]
        # A chain cut at a segment used before counts its own weights only, not the cost of the gap to it.
        gained = score[i] - score[last] + weight[last]
        if gained >= MIN_CHAIN:
            out.append((path[::-1], gained))
    return out


def chains(x0: list[int], x1: list[int], y0: list[int], y1: list[int], weight: list[int]) -> list[tuple[int, int, int, int, float]]:
    """The chains of traced as (start, stop, first_start, first_stop, score)."""
    return [(x0[path[0]], x1[path[-1]], y0[path[0]], y1[path[-1]], score) for path, score in traced(x0, x1, y0, y1, weight)]


def chain_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each text and first text; rows come sorted by both, diagonal and position."""
    open_group: list[np.ndarray] = []  # what has come of the last group, joined when it ends

    def of(rows: np.ndarray) -> Iterator[tuple]:
        keys, diagonal, pos = rows[:4], rows[4], rows[5]
        n = len(pos)
        if not n:
            return
        new, other = np.ones(n, bool), np.ones(n, bool)
        other[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        new[1:] = other[1:] | (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > JOIN)
        begin = np.flatnonzero(new)
        stop = np.r_[begin[1:], n]
        gain = np.full(n, K)
        gain[1:] = np.where(new[1:], K, np.minimum(pos[1:] - pos[:-1], K))
        weight = np.add.reduceat(gain, begin)
        x0, x1 = pos[begin], pos[stop - 1] + K
        shift = diagonal[begin]
        groups = np.flatnonzero(other[begin])
        for a, b in zip(groups, np.r_[groups[1:], len(begin)], strict=True):
            s = slice(a, b)
            ends = [x0[s].tolist(), x1[s].tolist(), (x0[s] - shift[s]).tolist(), (x1[s] - shift[s]).tolist()]
            for path, score in traced(*ends, weight[s].tolist()):
                span = [ends[k][path[-(k % 2)]] for k in range(4)]
                yield *keys[:, begin[a]].tolist(), *span, score, [e[i] for i in path for e in ends]

    def sent(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 4 + (pa.int32(),) * 4 + (pa.float64(), pa.list_(pa.int32()))
        columns = zip(*found, strict=True) if found else [()] * 10
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in CHAIN.split(", ")])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*KEYS, "diagonal", "pos")])
        if not rows.shape[1]:
            continue
        # The last group may go on in the next batch.
        earlier = np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))
        whole = int(earlier[-1]) + 1 if len(earlier) else 0
        if whole or (open_group and (open_group[-1][:4, -1] != rows[:4, 0]).any()):
            # Something ended: what came before, with the rows of this batch that belong to it or follow it whole.
            yield sent(list(of(np.concatenate([*open_group, rows[:, :whole]], axis=1))))
            open_group = []
        open_group.append(rows[:, whole:])
    if open_group:
        yield sent(list(of(np.concatenate(open_group, axis=1))))


def slice_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chain, side, low, words): word hashes of a chain's span in one of its texts, with a margin; rows come sorted by doc_id."""
    last_text, last_words = None, None
    for batch in batches:
        low, parts = [], []
        texts = batch.column("text")
        start, stop = batch.column("start").to_pylist(), batch.column("stop").to_pylist()
        for r in range(len(batch)):
            text = texts[r].as_py()
            if last_words is None or text != last_text:
                last_text, last_words = text, np.zeros(0, np.uint64)
                for _, _, data, offsets in tokens.pieces(pa.array([text])):
                    last_words = tokens.words(data, offsets).hashes()
            a, b = max(0, start[r] - MARGIN), min(len(last_words), stop[r] + MARGIN)
            low.append(a)
            parts.append((last_words[a:b] >> np.uint64(32)).astype(np.uint32).view(np.int32))
        words = tokens.lists(np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([len(p) for p in parts], np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("chain"), batch.column("side"), pa.array(low, pa.int32()), words], ["chain", "side", "low", "words"])


def in_common(a: list[int], b: list[int]) -> int:
    """Words of the longest common subsequence.

    Where few pairs of places agree, the longest rising row of them is taken pair by pair. Where words are frequent, whole
    columns go at once: bit k of an integer stands for place k of b, one addition for a word of a."""
    places: dict[int, list[int]] = {}
    for k, x in enumerate(b):
        places.setdefault(x, []).append(k)
    counts = Counter(x for x in a if x in places)
    if sum(n * len(places[x]) for x, n in counts.items()) <= PAIRS * (len(a) + len(b)):
        ends: list[int] = []  # the least last place of a common row of each length
        for x in a:
            for k in reversed(places.get(x, ())):
                at = bisect_left(ends, k)
                ends[at : at + 1] = [k]
        return len(ends)
    masks = {x: sum(1 << k for k in places[x]) for x in counts}
    whole = row = (1 << len(b)) - 1
    for x in a:
        if same := row & masks.get(x, 0):
            row = ((row + same) | (row - same)) & whole
    return len(b) - row.bit_count()


def edits(a: list[int], b: list[int]) -> int:
    """Words to drop from a or b until they are equal."""
    n = min(len(a), len(b))
    if n < 2:  # most gaps
        both = n and (b[0] in a if len(b) == 1 else a[0] in b)
        return len(a) + len(b) - 2 * both
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - head) if a[-1 - k] != b[-1 - k]), n - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    return len(a) + len(b) - 2 * (in_common(a, b) if a and b else 0)


def grown(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """How far an alignment goes on from the beginnings of a and b: words of each, and edits among them.

    Where words differ, it goes on at the nearest place at which SURE words agree again; the score of what
    was passed tells whether that was worth it."""
    i = j = wrong = score = best = 0
    out = (0, 0, 0)
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, score = i + 1, j + 1, score + 1
            if score > best:
                best, out = score, (i, j, wrong)
            continue
        skip = next(((x, d - x) for d in range(1, 2 * SKIP + 1) for x in range(max(0, d - SKIP), min(SKIP, d) + 1) if a[i + x : i + x + SURE] == b[j + d - x : j + d - x + SURE] and i + x + SURE <= len(a) and j + d - x + SURE <= len(b)), None)
        if skip is None:
            break
        i, j, wrong, score = i + skip[0], j + skip[1], wrong + sum(skip), score - sum(skip)
    return out


def part_edits(a: list[int], b: list[int], parts: list[tuple[int, int, int, int]]) -> int:
    """Edits of a chain: of its segments along their diagonals, and of the gaps between them."""
    wrong = 0
    for k, (s, e, fs, fe) in enumerate(parts):
        if k:
            wrong += edits(a[parts[k - 1][1] : s], b[parts[k - 1][3] : fs])
        x, y = a[s:e], b[fs:fe]
        if x != y:
            turns = np.flatnonzero(np.diff(np.r_[True, np.array(x) == np.array(y), True])).tolist()
            wrong += sum(edits(x[i:j], y[i:j]) for i, j in zip(turns[::2], turns[1::2], strict=True))
    return wrong


def aligned(a: list[int], b: list[int], parts: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int, int] | None:
    """(start, stop, first_start, first_stop, edits) of the passage around a chain, or None if it differs too much."""
    s, e, fs, fe = parts[0][0], parts[-1][1], parts[0][2], parts[-1][3]
    core = part_edits(a, b, parts)
    if core > int(EDITS * (e - s + fe - fs)):
        return None
    left, first_left, left_wrong = grown(a[:s][::-1], b[:fs][::-1])
    right, first_right, right_wrong = grown(a[e:], b[fe:])
    return s - left, e + right, fs - first_left, fe + first_right, core + left_wrong + right_wrong


def equal_runs(a: list[int], b: list[int], part: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """Runs of equal words on the diagonal of a segment."""
    s, e, fs, _ = part
    same = np.r_[False, np.array(a[s:e]) == np.array(b[fs : fs + e - s]), False]
    turns = np.flatnonzero(same[1:] != same[:-1]).tolist()
    return [(s + i, s + j, fs + i, fs + j) for i, j in zip(turns[::2], turns[1::2], strict=True)]


def parted(a: list[int], b: list[int], parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """What aligned gives for a chain of segments, or for its parts where the whole differs too much.

    A chain is split at its largest gap, a segment at the words that differ, until each part is judged."""
    out, open_parts = [], [parts]
    while open_parts:
        p = open_parts.pop()
        s, e, fs, fe = p[0][0], p[-1][1], p[0][2], p[-1][3]
        if any(s >= x[0] and e <= x[1] and fs >= x[2] and fe <= x[3] for x in out):
            continue  # a neighbour has grown over it
        if found := aligned(a, b, p):
            out.append(found)
        elif len(p) > 1:
            gap = lambda k: (p[k][0] - p[k - 1][1] + p[k][2] - p[k - 1][3], -abs(2 * k - len(p)))  # noqa: B023, E731
            cut = max(range(1, len(p)), key=gap)
            open_parts += [p[cut:], p[:cut]]
        elif len(runs := equal_runs(a, b, p[0])) > 1:
            open_parts.append(runs)
    return out


def align_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("chain", "start", "words", "first_start", "first_words", "matched")
    for batch in batches:
        out = []
        c = {x: batch.column(x) for x in batch.schema.names}
        spans = {x: c[x].to_numpy().tolist() for x in ("chain", "low", "first_low")}
        # Words go through NumPy: Arrow makes an object of each on the way to a list.
        ends = {x: c[x].offsets.to_numpy() for x in ("own_words", "other_words", "parts")}
        flat = {x: c[x].values.to_numpy() for x in ends}
        for r in range(len(batch)):
            a, b = (flat[x][ends[x][r] : ends[x][r + 1]].tolist() for x in ("own_words", "other_words"))
            low, first_low = spans["low"][r], spans["first_low"][r]
            p = flat["parts"][ends["parts"][r] : ends["parts"][r + 1]].tolist()
            parts = [(p[k] - low, p[k + 1] - low, p[k + 2] - first_low, p[k + 3] - first_low) for k in range(0, len(p), 4)]
            for s, e, fs, fe, wrong in parted(a, b, parts):
                if min(e - s, fe - fs) >= MIN_WORDS:
                    out.append((spans["chain"][r], s + low, e - s, fs + first_low, fe - fs, (e - s + fe - fs - wrong) // 2))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], list(names))


def reported(docs: DataFrame, matches: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The passages around matches (KEYS, diagonal, pos) of K words, and the staged tables that they are read from."""
    n = shuffle_parts(docs.sparkSession)
    matches = matches.repartition(n, *KEYS).sortWithinPartitions(*KEYS, "diagonal", "pos")
    found = stage(matches.mapInArrow(chain_task, CHAIN).distinct().withColumn("chain", F.monotonically_increasing_id()), "chains")
    release()
    sides = found.select("chain", F.lit(0).alias("side"), "doc_id", "mark", "start", "stop").union(found.select("chain", F.lit(1), "first_id", "first_mark", "first_start", "first_stop"))
    # Merge join at every size: the chains grow with the documents. Texts leave the join sorted by their names.
    one = docs.join(sides.hint("merge"), ["doc_id", "mark"]).select("chain", "side", "start", "stop", "text")
    words = stage(one.mapInArrow(slice_task, "chain long, side int, low int, words array<int>"), "chain-words")
    release()
    own = words.where("side = 0").select("chain", "low", F.col("words").alias("own_words"))
    other = words.where("side = 1").select("chain", F.col("low").alias("first_low"), F.col("words").alias("other_words"))
    spans = found.select("chain", "parts")
    done = spans.join(own, "chain").join(other, "chain").mapInArrow(align_task, "chain long, start long, words long, first_start long, first_words long, matched long")
    out = done.join(found.select("chain", *KEYS), "chain")
    return out.select(*KEYS, "start", "words", "first_start", "first_words", "matched").distinct(), [found, words]


def long_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, doc_id, spot, open) for each gram of MIN_WORDS words inside the runs; open if passages don't cover it."""

    def inside(spans: list, w: tokens.Words, start: int) -> np.ndarray:
        """How many words before each one lie in the spans of their text."""
        mask = np.zeros(int(w.first[-1]), bool)
        for d in range(len(w.first) - 1):
            for x in spans[start + d] or ():
                mask[min(w.first[d] + x["low"], w.first[d + 1]) : min(w.first[d] + x["high"], w.first[d + 1])] = True
        return np.r_[0, np.cumsum(mask)]

    for batch in batches:
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy() << 32
        runs, covered = (batch.column(c).to_pylist() for c in ("runs", "covered"))
        for start, _, data, offsets in tokens.pieces(batch.column("text")):
            w = tokens.words(data, offsets)
            values, ok = tokens.grams(w.hashes(), w.first, MIN_WORDS)
            at = np.flatnonzero(ok)
            within, under = inside(runs, w, start), inside(covered, w, start)
            at = at[within[at + MIN_WORDS] - within[at] == MIN_WORDS]
            owner = np.searchsorted(w.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays([tokens.longs(values[at]), pa.array(ids[start + owner]), pa.array(marks[start + owner] + at - w.first[owner]), pa.array(under[at + MIN_WORDS] - under[at] < MIN_WORDS)], ["seed", "doc_id", "spot", "open"])


MATCH = "doc_id long, mark long, first_id long, first_mark long, diagonal int, pos int"


def cover_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the matches of MIN_WORDS words of each text and first text, as few as cover the same words; rows come sorted by both and pos.

    In a text that repeats a few words over and over all matches have one place in the first document."""
    names = [x.split()[0] for x in MATCH.split(", ")]
    key, end, later, at = None, 0, None, names.index("pos")
    schema = None

    def sent(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    for batch in batches:
        out, schema = [], batch.schema
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            pos = row[at]
            if later and (row[:4] != key or pos > end):
                out.append(later)
                end, later = later[at] + MIN_WORDS, None
            if row[:4] != key or pos > end:
                out.append(row)
                key, end = row[:4], pos + MIN_WORDS
            else:
                later = row
        yield sent(out)
    if later:
        yield sent([later])


def first_places(hits: DataFrame) -> DataFrame:
    """seed, first_id and first_spot of the seeds (seed, doc_id, spot, lead) that stand in several places."""
    # One lead for each text, so longs are enough to find the first and the aggregate stays a hash table.
    found = hits.groupBy("seed").agg(F.min("doc_id").alias("first_id"), F.expr("min_by(spot, doc_id) FILTER (WHERE lead)").alias("first_spot"), F.count("*").alias("n"))
    return found.where("n > 1").drop("n")


def matched(hits: DataFrame, least: int) -> DataFrame:
    """KEYS, diagonal and pos of hits (doc_id, spot, first_id, first_spot) away from their first place; in one text at least so many words."""
    rows = hits.select("doc_id", mark("spot").alias("mark"), "first_id", mark("first_spot").alias("first_mark"), (place("spot") - place("first_spot")).alias("diagonal"), place("spot").alias("pos"))
    return rows.where((F.col("doc_id") != F.col("first_id")) | (F.col("mark") != F.col("first_mark")) | (F.col("diagonal") >= least))


def long_matches(docs: DataFrame, hits: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches of MIN_WORDS words that the passages in done don't cover, with the first document that has all of them, and the staged grams.

    hits are the staged places of all seeds that stand in several, deleted here. In a repeated run of MIN_WORDS words
    they lie at most WINDOW apart, so only such runs are searched."""
    name = ["doc_id", "mark"]
    seeds = hits.select("doc_id", mark("spot").alias("mark"), place("spot").alias("pos"))
    by = W.partitionBy(*name).orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(by) <= WINDOW, 0).otherwise(1)
    runs = seeds.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy(*name, "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).where(F.col("b") - F.col("a") >= MIN_WORDS - K - 2 * (WINDOW - 1))
    span = F.struct(F.greatest(F.col("a") - (WINDOW - 1), F.lit(0)).cast("long").alias("low"), (F.col("b") + K + WINDOW - 1).cast("long").alias("high"))
    runs = stage(runs.groupBy(*name).agg(F.collect_list(span).alias("runs")), "seed-runs")
    release(hits)  # before the grams are written, which need as much room
    covered = done.groupBy(*name).agg(F.collect_list(F.struct(F.col("start").alias("low"), (F.col("start") + F.col("words")).alias("high"))).alias("covered"))
    # Merge joins at every size, as above.
    texts = docs.join(runs.join(covered.hint("merge"), name, "left").hint("merge"), name).select(*name, "text", "runs", "covered")
    grams = stage(texts.mapInArrow(long_task, "seed long, doc_id long, spot long, open boolean"), "long-grams")
    release(runs)
    wanted = grams.groupBy("seed").agg(F.max("open").alias("any_open"), F.min("doc_id").alias("first_id"), F.min_by("spot", F.struct("doc_id", "spot")).alias("first_spot"), F.count("*").alias("n"))
    found = grams.where("open").join(wanted.where("any_open AND n > 1").select("seed", "first_id", "first_spot").hint("merge"), "seed")
    found = matched(found, MIN_WORDS).repartition(shuffle_parts(docs.sparkSession), *KEYS).sortWithinPartitions(*KEYS, "pos")
    found = found.mapInArrow(cover_task, MATCH)
    # As matches of K words: its first, middle and last.
    each = F.explode(F.array(*(F.lit(x) for x in (0, (MIN_WORDS - K) // 2, MIN_WORDS - K))))
    return found.select(*KEYS, "diagonal", "pos", each.alias("on")).withColumn("pos", F.col("pos") + F.col("on")).drop("on").distinct(), grams


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, start, words, first_id, first_start, first_words, matched of each repeated passage."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(F.col("text")).alias("mark"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    # Seeds are taken twice rather than written: they are more than the texts.
    seeds = docs.mapInArrow(seed_task, "seed long, doc_id long, spot long, lead boolean")
    firsts = stage(first_places(seeds), "seed-firsts")
    release()
    hits = stage(seeds.drop("lead").join(firsts, "seed").select("doc_id", "spot", "first_id", "first_spot"), "seed-hits")
    # Each step's tables and shuffle files go before the next writes its own.
    release(firsts)
    found, used = reported(docs, matched(hits, MIN_WORDS))
    done = stage(found, "passages")
    release(*used)
    matches, grams = long_matches(docs, hits, done)
    more, also = reported(docs, matches)
    every = stage(done.union(more).distinct(), "all-passages")
    release(*also, grams, done)
    own = (F.col("doc_id") == F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    # Grown towards each other, two places of one text may come to overlap; that is one run, not a repeat of MIN_WORDS words.
    apart = ~own | (F.col("start") - F.col("first_start") >= MIN_WORDS)
    return every.where(apart).select("doc_id", "start", "words", "first_id", "first_start", "first_words", "matched")

"""N-gram Jaccard join through a MinHash LSH forest.

Texts are sets of word 5-grams (a text of fewer words is one gram). Each of TREES prefix tries holds
one key for each text: LEVELS min-hash digits, packed into a long from the root down, so that the
order of keys is the order of the trie and its nodes at depth k are the runs of equal k-digit prefix.
Texts that share a node at the matched depth in any tree are candidates. Candidates are verified by
their exact similarity, in blocks. From the links found, each weighed by the chance that the forest
had to find a pair so similar, the share of links found is estimated. The matched prefix is shortened by
one digit and the join repeated until that share meets the target and the last digit brought no new link.

Work stays linear in rows and pairs never become rows. Equal word sequences are one class, whose
number follows the order of its first document, and only that document's text takes part. Candidates are
joined to one star for each trie node. A connected group of stars is cut into blocks of at most about
BLOCK texts and BLOCK_BYTES, and each pair of blocks is one unit of work that counts the shared grams of
all its pairs by a matrix product and returns a count and a star edge for each text; comparing more pairs
than the candidates can only add links. A group of more than TREES blocks is verified node by node of its
tries instead, each node in pairs of blocks, and a pair counts in the first tree where it meets: so a long
chain of chance matches ships each text at most once for each tree and block of its nodes. No group is
too large, and no link in it is lost.

Edge cases: texts without words (null, empty) have no grams: they link to nothing and each is its own
class; a repeated row is a copy of its first; rows that repeat an id with other text are classes of their
own; rows without an id have no class and no links; an empty table gives no rows. Ids may be of any type
that has an order; other columns are carried along whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import tokens
from folio.llm.base import WORD_RE, components, ranked, shuffle_parts, stage, unstage

WORDS = 5
SIMILAR = 0.8
TREES, LEVELS, DIGIT = 24, 6, 10
TARGET = 0.9995
#: Texts of a block, and their bytes.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Columns of the gram matrix that are multiplied at once.
SLICE = 4096
_U = np.uint64
#: Odd multipliers, one for each min-hash.
_SEEDS = tokens.mixed(np.arange(1, TREES * LEVELS + 1, dtype=np.uint64) << _U(32)) | _U(1)


def gram_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams of several texts in a row with repeats, how many each text has, and a 128-bit key of each word sequence."""
    w = tokens.words(data, offsets)
    h = w.hashes()
    n_docs, n = len(w.first) - 1, np.diff(w.first)
    value, ok = tokens.grams(h, w.first, WORDS)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    with np.errstate(over="ignore"):
        for d in short:
            part = h[w.first[d] : w.first[d + 1]]
            value[w.first[d]] = tokens.mixed((part * tokens.powers(WORDS)[: len(part)]).sum(keepdims=True) + _U(len(part)))[0]
        ok[w.first[short]] = True
        keys = np.zeros((2, n_docs), np.uint64)
        has = np.flatnonzero(n)
        if len(has):
            place = np.arange(len(h)) - np.repeat(w.first[:-1], n)
            step = tokens.mixed(place.astype(np.uint64) + _U(1))
            keys[0, has] = np.add.reduceat(tokens.mixed(h ^ step), w.first[has])
            keys[1, has] = np.add.reduceat(tokens.mixed(h * _U(3) + step), w.first[has])
    owner = np.repeat(np.arange(n_docs), n)
    return value[ok], np.bincount(owner[ok], minlength=n_docs), keys[0], keys[1]


def tree_keys(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The key of each text with grams in each tree."""
    has = np.flatnonzero(n)
    at = (np.cumsum(n) - n)[has]
    out = np.zeros((len(has), TREES), np.uint64)
    if not len(has):
        return out
    with np.errstate(over="ignore"):
        for i, seed in enumerate(_SEEDS):
            least = np.minimum.reduceat(values * seed, at)
            digit = (least * _U(0x9E3779B97F4A7C15)) >> _U(64 - DIGIT)
            t, level = divmod(i, LEVELS)
            out[:, t] |= digit << _U(DIGIT * (LEVELS - 1 - level))
    return out


def sign_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tokens.pieces(batch.column("text")):
            values, n, k1, k2 = gram_sets(data, offsets)
            keys = tokens.lists(tree_keys(values, n).ravel().view(np.int64), np.where(n > 0, TREES, 0))
            own = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("doc_id", "mark", "bytes")), tokens.longs(k1), tokens.longs(k2), keys], ["doc_id", "mark", "bytes", "k1", "k2", "keys"])


def verify_block(ids: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], cross: bool, similar: float, prefixes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each text (in documents), the least linked id that each reaches inside the block, and link counts by similarity.

    Pairs that share one of the prefixes (a row for each text, a column for each tree) met in an earlier tree and don't count."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    code = np.cumsum(new) - 1
    many = np.bincount(code)[code] > 1  # grams of a single text take no part in any intersection
    owner, code = owner[many], code[many]
    code = np.cumsum(np.r_[True, code[1:] != code[:-1]]) - 1 if len(code) else code
    shared = np.zeros((n, n), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, SLICE):
        a, b = np.searchsorted(code, (low, low + SLICE))
        m = np.zeros((n, min(SLICE, int(code[-1]) + 1 - low)), np.float32)
        m[owner[a:b], code[a:b] - low] = 1
        shared += m @ m.T
    union = sizes[:, None] + sizes[None, :] - shared
    with np.errstate(invalid="ignore", divide="ignore"):
        linked = shared >= similar * union - 1e-6
    np.fill_diagonal(linked, False)
    linked &= union > 0
    if cross:
        linked &= side[:, None] != side[None, :]
    if prefixes is not None:
        for column in prefixes.T:
            linked &= column[:, None] != column[None, :]
    links = linked @ copies
    upper = np.triu(linked, 1)
    bins = np.bincount(np.minimum((100 * shared[upper] / union[upper]).astype(int), 100), minlength=101)
    root = ids.copy()
    while True:  # the least id spreads along links
        near = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        least = np.minimum(root, near)
        if (least == root).all():
            return links, root, bins
        root = least


def verify_task(similar: float):
    """Rows of one unit come together: (kind, a, b) for links (0), edges (1) and similarities (2).

    A unit is a pair of blocks of a group (tree -1) or of a trie node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        key = None
        bins = np.zeros(101, np.int64)
        out: list[np.ndarray] = []

        def flush() -> None:
            nonlocal bins
            if len(held) > 1:
                ids = np.array(list(held), np.int64)
                side, copies, earlier, sets = (list(x) for x in zip(*held.values(), strict=True))
                prefixes = np.array(earlier, np.int64).reshape(len(ids), -1) if key[1] > 0 else None
                links, root, found = verify_block(ids, np.array(side), np.array(copies, np.int64), sets, key[2] != key[3], similar, prefixes)
                bins += found
                has = links > 0
                out.append(np.stack([np.zeros(has.sum(), np.int64), ids[has], links[has]]))
                moved = root != ids
                out.append(np.stack([np.ones(moved.sum(), np.int64), ids[moved], root[moved]]))
            held.clear()

        def batch_of(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), pa.array(rows[1]), pa.array(rows[2])], ["kind", "a", "b"])

        for batch in batches:
            unit = list(zip(*(batch.column(c).to_pylist() for c in ("unit", "tree", "i", "j")), strict=True))
            side, node, copies, k1, k2, earlier = (batch.column(c).to_pylist() for c in ("block", "node", "n", "k1", "k2", "earlier"))
            for start, _, data, offsets in tokens.pieces(batch.column("text")):
                values, n, a, b = gram_sets(data, offsets)
                a, b = a.view(np.int64), b.view(np.int64)
                at = np.r_[0, np.cumsum(n)]
                for d in range(len(n)):
                    r = start + d
                    if unit[r] != key:
                        flush()
                        key = unit[r]
                    # A text of the same id and mark, but of other words, is not the class's.
                    if a[d] == k1[r] and b[d] == k2[r]:
                        held[node[r]] = side[r], copies[r], earlier[r], np.unique(values[at[d] : at[d + 1]])
            if out:
                yield batch_of(np.concatenate(out, axis=1))
                out.clear()
        flush()
        seen = np.flatnonzero(bins)
        out.append(np.stack([np.full(len(seen), 2), seen, bins[seen]]))
        yield batch_of(np.concatenate(out, axis=1))

    return run


def chance(similarity: float, depth: int) -> float:
    """The chance that a pair meets in a node at this depth of any tree."""
    return 1 - (1 - similarity**depth) ** TREES


def candidates(classes: DataFrame, depth: int) -> DataFrame:
    """Edges (a, b) from each class to the least class in its trie node at this depth, where it has company."""
    keys = classes.select("node", F.posexplode("keys").alias("tree", "key")).select("node", "tree", F.shiftright("key", DIGIT * (LEVELS - depth)).alias("prefix"))
    nodes = keys.groupBy("tree", "prefix").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(nodes, ["tree", "prefix"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def blocked(members: DataFrame, by: list[str]) -> DataFrame:
    """members with the number of blocks of their group, where that has company."""
    needed = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES))
    return members.join(members.groupBy(*by).agg(needed.cast("int").alias("blocks"), F.count("*").alias("texts")).where("texts > 1").drop("texts"), by)


def units(classes: DataFrame, depth: int, most: int) -> DataFrame:
    """unit, tree, block, blocks and the class for each part that a class has in the work; groups of more than `most` blocks go node by node."""
    group = stage(components(candidates(classes, depth), "forest"), "forest-groups")
    own = classes.select("node", "rep", "mark", "bytes", "n", "k1", "k2")
    members = stage(blocked(group.join(own, "node"), ["root"]), "forest-members")
    none = F.array().cast("array<bigint>")
    small = members.where(F.col("blocks") <= most).select(F.col("root").alias("unit"), F.lit(-1).alias("tree"), "blocks", *own.columns, none.alias("earlier"))
    large = members.where(F.col("blocks") > most).drop("blocks", "root").join(classes.select("node", "keys"), "node")
    prefixes = F.transform("keys", lambda k: F.call_function("shiftright", k, F.lit(DIGIT * (LEVELS - depth))))
    large = large.withColumn("prefixes", prefixes).select(*own.columns, "prefixes", F.posexplode("prefixes").alias("tree", "unit"))
    large = blocked(large.withColumn("earlier", F.slice("prefixes", F.lit(1), F.col("tree"))).drop("prefixes"), ["unit", "tree"])
    both = small.unionByName(large.select(*small.columns))
    return both.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def verified(docs: DataFrame, classes: DataFrame, depth: int, similar: float, most: int = TREES) -> DataFrame:
    """The rows of verify_task for all candidates at this depth."""
    parts = stage(units(classes, depth, most), "forest-units")
    # Merge join at every size: the parts grow with the documents.
    parts = docs.select(F.col("doc_id").alias("rep"), marked().alias("mark"), "text").join(parts.hint("merge"), ["rep", "mark"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    parts = parts.select("*", other.alias("other")).select("unit", "tree", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "k1", "k2", "earlier", "text")
    n = shuffle_parts(docs.sparkSession)
    parts = parts.repartition(n, "unit", "tree", "i", "j").sortWithinPartitions("unit", "tree", "i", "j", "node")
    return stage(parts.mapInArrow(verify_task(similar), "kind int, a long, b long"), "forest-links")


def marked():
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def linked(docs: DataFrame, similar: float, target: float, most: int = TREES) -> tuple[DataFrame, DataFrame]:
    """All rows with their class (doc_id, k1, k2), and the classes: k1, k2, rep, mark, n, links, head (first document that links reach) and first (whether it is its own)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", marked().alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    signed = stage(rows.mapInArrow(sign_task, f"doc_id {kind}, mark long, bytes long, k1 long, k2 long, keys array<long>"), "forest-signed")
    named = signed.where((F.size("keys") > 0) & F.col("doc_id").isNotNull())
    classes = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "mark", "bytes")).alias("x"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    classes = classes.select("k1", "k2", "n", "keys", F.col("x.doc_id").alias("rep"), "x.mark", "x.bytes")
    classes = stage(ranked(classes, [F.col("rep"), F.col("k1"), F.col("k2")], "node", "forest-ranks"), "forest-classes")
    depth, before, found = LEVELS, None, None
    while True:
        if found is not None:
            unstage(found)
        found = verified(docs, classes, depth, similar, most)
        links = found.where("kind = 2").groupBy("a").agg(F.sum("b").alias("n")).collect()  # at most 101 rows
        seen = sum(r.n for r in links)
        # By the lower edge of each bin, where the chance is least.
        due = sum(r.n / chance(max(similar, r.a / 100), depth) for r in links)
        # What was found can't tell of similarities that the forest missed; only a shorter prefix can.
        if depth == 1 or (seen == before and seen >= target * due):
            break
        depth, before = depth - 1, seen
    count = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    group = components(found.where("kind = 1").select("a", "b"), "links")
    own = classes.select("node", "k1", "k2", "rep", "mark", "n")
    nodes = own.join(count, "node", "left").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = own.select(F.col("node").alias("root"), F.col("rep").alias("head"))
    nodes = nodes.join(heads, "root").select("k1", "k2", "rep", "mark", "n", F.coalesce("links", F.lit(0)).alias("links"), "head", (F.col("node") == F.col("root")).alias("first"))
    return signed.select("doc_id", "k1", "k2"), stage(nodes, "forest-nodes")


def joined(docs: DataFrame, similar: float = SIMILAR, target: float = TARGET, most: int = TREES) -> DataFrame:
    """doc_id, copy_of (first document with the same words), class_id (first of all that links reach) and n_links."""
    signed, nodes = linked(docs, similar, target, most)
    out = signed.join(nodes, ["k1", "k2"], "left")
    out = out.withColumns({c: F.when(F.col("doc_id").isNotNull(), F.col(c)) for c in ("rep", "head", "links", "n")})
    return out.select("doc_id", F.coalesce("rep", "doc_id").alias("copy_of"), F.coalesce("head", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"))


def kept(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each group that links and equal words reach, its first document's; columns as before. Rows without an id or words all stay."""
    _, nodes = linked(docs, similar, TARGET)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    alone = F.col("row.doc_id").isNull() | F.col("row.text").isNull() | ~F.col("row.text").rlike(WORD_RE)
    first = nodes.where("first").select("rep", "mark")
    # Equal rows meet before the shuffle; merge join at every size, since the heads grow with the documents.
    mark = F.xxhash64("row.text").alias("mark")
    each = row.where(~alone).groupBy(F.col("row.doc_id").alias("rep"), mark).agg(F.first("row").alias("row"))
    return each.join(first.hint("merge"), ["rep", "mark"]).select("row.*").unionByName(row.where(alone).select("row.*"))

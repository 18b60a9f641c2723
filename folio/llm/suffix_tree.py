"""Language-model scores by a probabilistic suffix tree over tokens, whose root spells tokens by a tree over bytes.

A text is a row of tokens: its lower-cased words and its end. A token is spelled by the UTF-8 bytes of its
word and a space, the end by a line feed; spaces stand before its first byte. Grams of DEPTH + 1 bytes are
counted over all distinct training tokens (what the tree prices is a new token, and frequent ones would
drown the rest), and sums over them give every shorter context. A context is a state of the
tree if it was seen MIN_SEEN times and its next-symbol counts diverge from those of its suffix by more
than their description costs: n * KL(child || parent) >= symbols / 2 * ln n. A state's distribution is smoothed
towards that of its longest suffix that is a state: P(a) = (n_a + w * P_parent(a)) / (n + w), where w is
PARENT times the number of symbols seen after it, and below the root all bytes are alike. Each
byte is priced by the longest suffix of what stands before it in the token that is a state.

The root also has whole words as symbols. With u the share of tokens seen once, which is how likely a new
word comes next, P(token) = (1 - u) * c / N + u * P_tree(token): c of N training tokens, and
the product of the tree's prices. So every token has a probability of its own, unseen ones by
their spelling, and all of them sum to one. The base score is no such measure: it gives each of endlessly many
unseen words the same share, so it may be higher where many words are new.

Above this root, contexts are the tokens before a token in its text, at most `words` of them, with the text's beginning as a
token of its own. They are counted over all training tokens. A context's entries are the tokens that were seen ENTRY times
after it; what else was seen there, R of its n, goes to its suffix: P(a) = (n_a + (R + w) * P_suffix(a)) / (n + w), with n_a 0
for other tokens and w PARENT for each entry. It is a state if it was seen MIN_SEEN times and its entries and R
diverge from what its suffix says of them by the same test as above. Each token is priced by the longest suffix of what stands
before it that is a state, so known tokens too; with no state it is the root. All of these sum to one.

The bytes' contexts end at the token, so that tree is learned from and applied to the table of distinct tokens, whose
grams meet the counts and states by joins. Nothing is left out for being rare in a larger corpus, and neither
tree is ever sent anywhere as a whole. In logarithms a price is a sum: the root's, for each context what it leaves to
its suffix, and for each entry what it adds to that. So tokens and entries are rows of one table. Those
that make up at least LEAST_WORD of all tokens (so at most 1 / LEAST_WORD for each length) are broadcast; occurrences of others
meet the table in parts, dealt by hash, whose number grows with the corpus. A filter of fixed size keeps back most of what
the table doesn't have, and can only err by letting more through.

Edge cases: null text is empty and has one token, its end; repeated rows and rows that share an id are scored each;
rows without an id are training rows; with no training rows all counts are 0 and each byte costs
1 / 256; an empty table gives no rows; other columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folio.llm import tokens
from folio.llm.base import release, stage
from folio.llm.phrases import FILTER_BITS, passes

DEPTH = 5
#: Times that a state was seen.
MIN_SEEN = 4
LEAST_WORD = 1e-6
#: Weight of the parent's distribution, in observations for each distinct next symbol.
PARENT = 1.0
#: Tokens of the longest contexts that op2 learns.
WORDS = 2
#: Times that a token was seen after a context, to be an entry of it.
ENTRY = 3
#: Codes of the token that ends a text and of what stands before its first; no word hash is used for them.
END, START = 0, 1
#: Occurrences that a part of the dealt tables is meant to have, and bits of the least number of parts.
PART, LEAST_BITS = 1 << 20, 6
#: Rows a task holds before it merges equal codes.
MERGE = 1_000_000
#: Contexts of so many bytes are few by their nature (256 ** NEAR), so their counts are broadcast.
NEAR = 1
_SPACE, _FEED = 32, 10
_ODD = np.uint64(0x9E3779B97F4A7C15)
TOKENS = "code long, word binary, n long, train long"


def held_out(doc_id: Column, every: int = 10) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(every)) == 0


def distinct_words(w: tokens.Words, train: np.ndarray) -> pa.Table:
    """code, word, n and train of the distinct words of several texts; train tells which texts count for it."""
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    code, at, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
    size = (w.end - w.start)[at]
    offsets = np.r_[0, np.cumsum(size)]
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    data = w.data[np.repeat(w.start[at], size) + inside]
    word = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    n, learned = np.bincount(back, minlength=len(at)), np.bincount(back[train[owner]], minlength=len(at))
    return pa.table([tokens.longs(code), word, pa.array(n.astype(np.int64)), pa.array(learned.astype(np.int64))], ["code", "word", "n", "train"])


def token_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of many texts, merged in the task before they are sent."""
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        g = pa.concat_tables(held).group_by("code", use_threads=False).aggregate([("word", "first"), ("n", "sum"), ("train", "sum")])
        return g.rename_columns([c.rsplit("_", 1)[0] for c in g.column_names]).select(["code", "word", "n", "train"])

    for batch in batches:
        learned = batch.column("train").to_numpy(zero_copy_only=False)
        for low, high, data, offsets in tokens.pieces(batch.column("text")):
            ends = pa.table([pa.array([END]), pa.array([b""], pa.binary()), pa.array([high - low]), pa.array([int(learned[low:high].sum())])], ["code", "word", "n", "train"])
            held += [distinct_words(tokens.words(data, offsets), learned[low:high]), ends]
            rows += len(held[-2]) + 1
            if rows > MERGE:
                held = [merged()]
                rows = len(held[0])
                if rows > MERGE // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
    if held:
        yield from merged().combine_chunks().to_batches()


def spelling(data: np.ndarray, offsets: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The grams of several words one after another as integers, newest byte lowest; last ends each word."""
    size = np.diff(offsets) + 1
    pad = np.arange(1, len(size) + 1) * DEPTH
    begin = np.cumsum(size) - size + pad
    out = np.full(int(size.sum()) + DEPTH * len(size), _SPACE, np.uint64)
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], size - 1)
    out[np.repeat(begin, size - 1) + inside] = data
    out[begin + size - 1] = last
    code = out.copy()
    for k in range(1, DEPTH + 1):
        code[k:] |= out[: len(out) - k] << np.uint64(8 * k)
    return code[np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]


def spell_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, train, grams) of each token."""
    for batch in batches:
        for low, high, data, offsets in tokens.pieces(batch.column("word").cast(pa.large_binary()).view(pa.large_string())):
            own = batch.slice(low, high - low)
            code = own.column("code").to_numpy()
            grams = spelling(data, offsets, np.where(code == END, _FEED, _SPACE).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([own.column("code"), own.column("train"), tokens.lists(grams.view(np.int64), np.diff(offsets) + 1)], ["code", "train", "grams"])


def shortened(gram: str, depth: int) -> Column:
    """The gram with a context of depth bytes."""
    return F.col(gram).bitwiseAND((1 << 8 * (depth + 1)) - 1)


def at_depths(gram: str, depths: range) -> Column:
    """A row for each depth: depth, code (context and next) and context."""
    return F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), shortened(gram, d).alias("code"), F.call_function("shiftright", shortened(gram, d), F.lit(8)).alias("context")) for d in depths)))


def levels(grams: DataFrame) -> DataFrame:
    """depth, code, context, n: counts for contexts of every length; grams: gram, n."""
    rows = grams.where("n > 0").select("n", at_depths("gram", range(DEPTH + 1)).alias("x"))
    return rows.groupBy("x.depth", "x.code", "x.context").agg(F.sum("n").alias("n"))


def states(level: DataFrame) -> DataFrame:
    """depth, context, total, kinds of the contexts that the divergence test keeps, and of the root."""
    sums = level.groupBy("depth", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    whole = level.join(sums.where((F.col("total") >= MIN_SEEN) | (F.col("depth") == 0)), ["depth", "context"])
    masks = F.array(*(F.lit((1 << 8 * d) - 1 if d else 0).cast("long") for d in range(DEPTH + 1)))
    child = whole.where("depth > 0").withColumn("up", F.col("code").bitwiseAND(F.element_at(masks, F.col("depth") + 1)))
    # A suffix was seen at least as often as the context, so it has its sums.
    parent = whole.select((F.col("depth") + 1).alias("depth"), F.col("code").alias("up"), F.col("n").alias("up_n"), F.col("total").alias("up_total"))
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("up_n") / F.col("up_total"))))
    tested = child.join(parent, ["depth", "up"]).groupBy("depth", "context").agg(gain.alias("gain"), F.max("total").alias("total"), F.max("kinds").alias("kinds"))
    kept = tested.where(F.col("gain") >= F.col("kinds") / 2 * F.log("total")).drop("gain")
    return kept.unionByName(sums.where("depth = 0"))


def prices(grams: DataFrame, level: DataFrame, kept: DataFrame) -> DataFrame:
    """gram and p, its last byte's probability after the bytes before it."""
    found = []
    for depths, hint in ((range(NEAR + 1), "broadcast"), (range(NEAR + 1, DEPTH + 1), "merge")):
        rows = grams.select("gram", at_depths("gram", depths).alias("x")).select("gram", "x.*")
        part = F.col("depth").between(depths.start, depths.stop - 1)
        # The near tables have at most 256 ** (NEAR + 1) rows and one more for the root.
        own, state = level.where(part).drop("context").hint(hint), kept.where(part).hint(hint)
        found.append(rows.join(state, ["depth", "context"]).join(own, ["depth", "code"], "left").select("gram", "depth", "n", "total", "kinds"))
    steps = found[0].unionByName(found[1]).groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("depth", F.coalesce("n", F.lit(0)).alias("n"), "total", "kinds"))).alias("steps"))
    weight = lambda x: x["kinds"] * F.lit(PARENT)
    p = F.aggregate("steps", F.lit(1 / 256), lambda p, x: (x["n"] + weight(x) * p) / (x["total"] + weight(x)))
    return steps.select("gram", p.alias("p"))


def spelt(types: DataFrame) -> DataFrame:
    """code, n, train and spelt, the log10 probability of its spelling, of each distinct token."""
    rows = stage(types.mapInArrow(spell_task, "code long, train long, grams array<long>"), "suffix-spelling")
    grams = stage(rows.select("train", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count_if(F.col("train") > 0).alias("n")), "suffix-grams")
    level = stage(levels(grams), "suffix-levels")
    kept = stage(states(level), "suffix-states")
    price = prices(grams, level, kept)
    price = stage(grams.join(price.hint("merge"), "gram", "left").select("gram", F.log10(F.coalesce("p", F.lit(1 / 256))).alias("price")), "suffix-prices")
    each = rows.select("code", F.explode("grams").alias("gram")).join(price.hint("merge"), "gram").groupBy("code").agg(F.sum("price").alias("spelt"))
    out = stage(types.select("code", "n", "train").join(each, "code"), "suffix-words")
    release(rows, grams, level, kept, price)
    return out


def after(context: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The key of a token (by its code, or its key after a shorter context) in a context; also the key of the context that both make up."""
    with np.errstate(over="ignore"):
        return tokens.mixed(context * _ODD + code)


def rows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the tokens of several texts, each from START to END, the place of each in its text, and the words of each text."""
    w = tokens.words(data, offsets)
    n = np.diff(w.first)
    begin = np.cumsum(n + 2) - (n + 2)
    code = np.full(int((n + 2).sum()), END, np.uint64)
    code[begin] = START
    code[np.arange(len(w.start)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = w.hashes()
    return code, np.arange(len(code)) - np.repeat(begin, n + 2), n


def lengthened(key: np.ndarray) -> np.ndarray:
    """Keys with one more token of context; the first that a text has is none."""
    return np.r_[key[:1], after(key[:-1], key[1:])]


def dealt(key: np.ndarray, bits: int, columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> tuple[pa.Array, list[pa.Array]]:
    """Part numbers, and a list of each column for each part; key is sorted."""
    part = (key >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(part)])
    return pa.array(part[first], pa.int32()), [tokens.lists(x, size, kind) for x, kind in columns.values()]


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts key, and where each distinct one begins in it."""
    order = np.argsort(key)
    k = key[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]])


ENTRIES = "part int, context array<long>, up array<long>, n array<int>"


def entry_task(depth: int, bits: int, shared):
    """Tokens after contexts of depth tokens with their counts, in parts; up is the token's key after the context's suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared and np.frombuffer(shared.value, np.uint8)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flushed() -> pa.RecordBatch:
            context, up = (np.concatenate(x) for x in zip(*held, strict=True))
            key = after(context, up)
            order, first = grouped(key)
            at, n = order[first], np.diff(np.r_[first, len(key)])
            part, columns = dealt(key[at], bits, {"context": (context[at].view(np.int64), None), "up": (up[at].view(np.int64), None), "n": (n.astype(np.int32), None)})
            return pa.RecordBatch.from_arrays([part, *columns], ["part", "context", "up", "n"])

        for batch in batches:
            for _, _, data, offsets in tokens.pieces(batch.column("text")):
                key, place, _ = rows_of(data, offsets)
                for _ in range(depth - 1):
                    key = lengthened(key)
                at = np.flatnonzero(place >= depth)
                if seen is not None:  # an entry's key after the suffix is an entry, and so is the context
                    ok = passes(seen, key)
                    at = at[ok[at] & ok[at - 1]]
                if len(at):
                    held.append((key[at - 1], key[at]))
                    rows += len(at)
                if rows > 2 * MERGE:
                    yield flushed()
                    held, rows = [], 0
        if rows:
            yield flushed()

    return run


def flat(t: pa.Table, column: str) -> np.ndarray:
    """The values of a column of lists."""
    parts = [x.flatten().to_numpy(zero_copy_only=False) for x in t[column].chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def entries_of(t: pa.Table) -> pa.Table:
    """The entries among all counts of a part."""
    context, up, n = (flat(t, c) for c in ("context", "up", "n"))
    key = after(context.view(np.uint64), up.view(np.uint64))
    order, first = grouped(key)
    total = np.add.reduceat(n[order].astype(np.int64), first)
    at = order[first[total >= ENTRY]]
    return pa.table([tokens.longs(key[at]), pa.array(context[at]), pa.array(up[at]), pa.array(total[total >= ENTRY])], ["key", "context", "up", "n"])


def key_filter(keys: DataFrame) -> bytes:
    """A bit for each code of keys."""
    piece, out = 1 << 15, bytearray(FILTER_BITS // 8)
    bits = keys.select(F.col("code").bitwiseAND(FILTER_BITS - 1).alias("bit"))
    rows = bits.groupBy(F.floor(F.col("bit") / piece).alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % piece).alias("bits"))
    for r in rows.toLocalIterator():
        out[r["piece"] * (piece // 8) : (r["piece"] + 1) * (piece // 8)] = r["bits"]
    return bytes(out)


def lengths(docs: DataFrame, words: DataFrame, depth: int, bits: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For contexts of 1 to depth tokens: the entries (code, n, p, gain) and the states (context, rest).

    p is an entry's probability; rest is what a state adds to the price of any token, and gain what an entry adds to that."""
    sc = docs.sparkSession.sparkContext
    entries, states_ = [], []
    begin = words.where(F.col("code") == END).select(F.lit(START).cast("long").alias("code"), F.lit(None).cast("double").alias("p"), "total")
    below = words.select("code", F.pow(F.lit(10.0), "price").alias("p"), "total").union(begin)
    for d in range(1, depth + 1):
        shared = sc.broadcast(key_filter(entries[-1])) if entries else None
        counts = docs.where("train").select("text").mapInArrow(entry_task(d, bits, shared), ENTRIES)
        found = stage(counts.groupBy("part").applyInArrow(entries_of, "key long, context long, up long, n long"), "suffix-entries")
        release()
        # Merge joins at every size: entries grow with the corpus.
        rows = stage(found.join(below.select(F.col("code").alias("up"), "p").hint("merge"), "up").drop("up"), "suffix-below")
        release(found)
        seen, up, n = F.sum("n").alias("seen"), F.sum("p").alias("up"), F.count("*").alias("kinds")
        sums = rows.groupBy("context").agg(seen, up, n, F.sum(F.col("n") * F.log(F.col("n") / F.col("p"))).alias("told"))
        kept = sums.join(below.select(F.col("code").alias("context"), "total").where(F.col("total") >= MIN_SEEN).hint("merge"), "context")
        left = F.col("total") - F.col("seen")
        other = F.when(left > 0, left * F.log(left / F.col("total") / F.greatest(1 - F.col("up"), F.lit(1e-12)))).otherwise(0.0)
        gain = F.col("told") - F.col("seen") * F.log("total") + other
        weight = F.col("kinds") * F.lit(PARENT)
        kept = kept.where(gain >= F.col("kinds") / 2 * F.log("total")).select("context", (left + weight).alias("given"), (F.col("total") + weight).alias("whole"))
        kept = stage(kept, "suffix-contexts")
        # A frequent context has many entries, which the join may split; all states have at most as many rows as entries.
        priced_ = rows.join(kept.hint("merge"), "context", "left")
        p = F.coalesce((F.col("n") + F.col("given") * F.col("p")) / F.col("whole"), F.col("p"))
        more = F.coalesce(F.log10(p / F.col("p")) - F.log10(F.col("given") / F.col("whole")), F.lit(0.0))
        entries.append(stage(priced_.select(F.col("key").alias("code"), "n", p.alias("p"), more.alias("gain")), "suffix-priced-entries"))
        states_.append(kept.select("context", F.log10(F.col("given") / F.col("whole")).alias("rest")))
        states_[-1]._folio_path = kept._folio_path
        release(rows)
        below = entries[-1].select("code", "p", F.col("n").alias("total"))
    return entries, states_


def looked_up(words: DataFrame, entries: list[DataFrame], states_: list[DataFrame]) -> DataFrame:
    """code, n, known, base and price of all that a text is looked up by: its tokens, and its tokens after contexts."""
    zero = F.lit(0.0)
    begin = words.where(F.col("code") == END).select(F.lit(START).cast("long").alias("code"), "n", F.lit(0).alias("known"), zero.alias("base"), zero.alias("price"))
    out = words.select("code", "n", "known", "base", "price")
    levels_ = [out.union(begin) if states_ else out]
    levels_ += [x.select("code", "n", F.lit(0).alias("known"), zero.alias("base"), F.col("gain").alias("price")) for x in entries]
    # A context of one token more is told by the key of its last token.
    for d, s in enumerate(states_):
        one = levels_[d].join(s.select(F.col("context").alias("code"), "rest").hint("merge"), "code", "left")
        levels_[d] = one.withColumn("price", F.col("price") + F.coalesce("rest", zero)).drop("rest")
    out = levels_[0]
    for x in levels_[1:]:
        out = out.unionByName(x)
    return out


def score_task(shared, depth: int, bits: int, kind: pa.DataType):
    """What is not common of each text, in parts; and in parts of their own the texts, with the sums of what is common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known, base, price, bloom = shared.value
        seen = bloom and np.frombuffer(bloom, np.uint8)
        task = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        texts: list[tuple] = []
        done = rows = turn = 0

        def flushed() -> pa.RecordBatch:
            key, row = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            part, columns = dealt(key[order], bits, {"code": (key[order].view(np.int64), None), "of": (row[order], None)})
            n = len(part)
            part = pa.concat_arrays([part, pa.array([(task * 7919 + turn) % (1 << bits)], pa.int32())])
            columns = [pa.concat_arrays([c, tokens.lists(np.zeros(0, np.int64), np.zeros(1, np.int64))]) for c in columns]
            own = [pa.concat_arrays([x for x, *_ in texts]).cast(kind), *(pa.array(np.concatenate(x)) for x in list(zip(*texts, strict=True))[1:])]
            ends = pa.array(np.r_[np.zeros(n + 1, np.int32), np.int32(len(own[0]))])
            columns += [pa.ListArray.from_arrays(ends, x) for x in own]
            return pa.RecordBatch.from_arrays([part, *columns], ["part", "code", "of", "doc_id", "row", "n_tokens", "known", "base", "price"])

        for batch in batches:
            for low, high, data, offsets in tokens.pieces(batch.column("text")):
                key, place, n = rows_of(data, offsets)
                n_docs, doc = len(n), np.repeat(np.arange(len(n)), n + 2)
                row = (np.int64(task) << 33) + done + np.arange(n_docs)
                sums = np.zeros((3, n_docs))
                for d in range(depth + 1):
                    if d:
                        key = lengthened(key)
                        at = np.flatnonzero((place >= d) & passes(seen, key))
                    else:
                        at = np.flatnonzero(place >= (0 if depth else 1))
                    at = at[np.argsort(key[at])]  # near ones are looked up together
                    k, owner = key[at], doc[at]
                    if len(common):
                        where = np.minimum(np.searchsorted(common, k), len(common) - 1)
                        head = common[where] == k
                        for j, x in enumerate((known, base, price)):
                            sums[j] += np.bincount(owner[head], x[where[head]], n_docs)
                        k, owner = k[~head], owner[~head]
                    held.append((k, row[owner]))
                    rows += len(k)
                texts.append((batch.column("doc_id").slice(low, high - low), row, n + 1, sums[0].astype(np.int64), sums[1], sums[2]))
                done += n_docs
                rows += n_docs
                if rows > MERGE:
                    yield flushed()
                    held, texts, rows, turn = [], [], 0, turn + 1
        if texts:
            yield flushed()

    return run


SUMS = ["row", "doc_id", "n_tokens", "known", "base", "price"]


def summed(texts: pa.Table, table: pa.Table) -> pa.Table:
    """The sums of a part's occurrences by text, and the texts that came with it."""
    code, of = flat(texts, "code").astype(np.int64), flat(texts, "of").astype(np.int64)
    names = table["code"].to_numpy()
    order = np.argsort(names)
    names = names[order]
    where = np.minimum(np.searchsorted(names, code), max(len(names) - 1, 0))
    hit = names[where] == code if len(names) else np.zeros(len(code), bool)
    row, owner = np.unique(of[hit], return_inverse=True)
    x = [np.bincount(owner, table[c].to_numpy()[order][where[hit]], len(row)) if len(row) else np.zeros(0) for c in ("known", "base", "price")]
    own = {c: pa.chunked_array([y.flatten() for y in texts[c].chunks], texts.schema.field(c).type.value_type) for c in SUMS}
    more = pa.table([pa.array(row), pa.nulls(len(row), own["doc_id"].type), pa.nulls(len(row), pa.int64()), pa.array(x[0].astype(np.int64)), pa.array(x[1]), pa.array(x[2])], SUMS)
    return pa.concat_tables([pa.table([own[c] for c in SUMS], SUMS), more])


def priced(words: DataFrame, total: int, distinct: int, once: int) -> DataFrame:
    """code, n, total (in training), known (whether training has it), base and price: what the token adds to the base score and, at the root, to the score."""
    new = min(max(once, 1) / (total + 1), 1.0)
    c, spelt_ = F.col("train"), F.col("spelt")
    mixed = F.log10(c * ((1 - new) / max(total, 1)) + F.pow(F.lit(10.0), spelt_) * new)
    base = F.log10((c + F.lit(0.1)) / F.lit(total + 0.1 * (distinct + 1)))
    return words.select("code", "n", c.alias("total"), (c > 0).cast("int").alias("known"), base.alias("base"), F.when(c > 0, mixed).otherwise(spelt_ + float(np.log10(new))).alias("price"))


def scored(docs: DataFrame, words: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document, by contexts of at most so many words; 0: by the root alone."""
    spark = docs.sparkSession
    out_of = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    docs = docs.select("doc_id", "text", (~out_of).alias("train"))
    found = docs.select("text", "train").mapInArrow(token_task, TOKENS)
    types = stage(found.groupBy("code").agg(F.first("word").alias("word"), F.sum("n").alias("n"), F.sum("train").alias("train")), "suffix-types")
    every, total, distinct, once = types.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0), F.count_if(F.col("train") == 1)).first()
    root = stage(priced(spelt(types), total, distinct, once), "suffix-priced")
    release(types)
    bits = max(LEAST_BITS, (every // PART).bit_length())
    entries, states_ = lengths(docs, root, words, bits)
    least = max(1.0, every * LEAST_WORD)
    table = stage(looked_up(root, entries, states_).where((F.col("n") >= least) | (F.col("known") + F.abs("base") + F.abs("price") > 0)), "suffix-table")
    # Tokens are looked up without it, so it has entries only.
    bloom = key_filter(table.where("base = 0")) if words else None
    release(root, *entries, *states_)
    t = table.where(F.col("n") >= least).toArrow()  # at most 1 / LEAST_WORD rows for each length
    names = t["code"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    shared = spark.sparkContext.broadcast((names[order], *(t[c].to_numpy().astype(float)[order] for c in ("known", "base", "price")), bloom))
    kind = docs.schema["doc_id"].dataType
    packed = f"part int, code array<long>, of array<long>, doc_id array<{kind.simpleString()}>, row array<long>, n_tokens array<long>, known array<long>, base array<double>, price array<double>"
    rows = docs.select("doc_id", "text").mapInArrow(score_task(shared, words, bits, to_arrow_type(kind)), packed)
    rest = table.where(F.col("n") < least).select(F.shiftrightunsigned("code", 64 - bits).cast("int").alias("part"), "code", "known", "base", "price")
    sums = rows.groupBy("part").cogroup(rest.groupBy("part")).applyInArrow(summed, f"row long, doc_id {kind.simpleString()}, n_tokens long, known long, base double, price double")
    out = sums.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("price").alias("score"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")

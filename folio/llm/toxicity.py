"""Toxicity by a factorization machine over hashed terms.

A text is the set of 64-bit hashes of its words (letters and digits, lower-cased) and their beginnings. The model scores
w0 + sum of w over the terms + sum over pairs of <v_i, v_j>, so that two terms can say together what
neither says alone. It learns from at most SAMPLE labelled rows, the ones whose ids hash lowest, as far
as their terms number SAMPLE_TERMS together (the row that passes this is the last, however long a row is);
every term of at least MIN_TEXTS of them takes part, whatever its own toxic share.

Learning goes twice over the sample. The first time it selects terms: weights alone, by
follow-the-regularised-leader with a penalty that keeps most at zero, then weights and factors together under a group
penalty that kills the factors of all terms but those whose pairs say what weights do not. The second time it
learns weights and factors of the terms that are left together from the start, under a light penalty, so
that what terms say together goes to their pairs. Terms left at zero are dropped, and the rest is broadcast:
at most SAMPLE_TERMS / MIN_TEXTS terms whatever the corpus. Scoring covers all texts.

Edge cases: null and empty texts score the intercept alone; rows without a label, or with a null label,
teach nothing; a row labelled twice counts twice; with no labels all scores are one half; an empty
table gives no rows; other columns are not looked at. Ids of any type are kept as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm import tokens
from folio.llm.base import stage
from folio.llm.suffix_tree import held_out

#: Labelled rows that the model learns from, and terms that these have together; documented bounds.
SAMPLE, SAMPLE_TERMS = 20_000, 8_000_000
#: A term counts from so many texts.
MIN_TEXTS = 4
#: Besides a word, its first bytes are terms, for inflected and compound words.
PREFIXES = (4, 5, 6, 7)
FACTORS = 4
#: Passes over the rows, those of them before the factors, and rows that make one step.
EPOCHS, ALONE, BATCH = 10, 4, 32
#: Step sizes of weights and factors, and how far factors start from zero, for texts of one term.
RATE, FACTOR_RATE, START = 0.2, 0.1, 0.25
#: Penalties: of a weight, times the root of the rows; of a term's factors at each step, while terms are selected and afterwards.
SPARSE, GROUP, LIGHT = 0.27, 0.3, 0.02
#: How far factors start from zero once terms are selected.
SELECTED_START = 0.5
#: Holdout remainder: rows whose crc32(doc_id) mod 5 is 0 teach nothing.
EVERY = 5


def term_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each text in a row, and how many each has: words and their beginnings."""
    w = tokens.words(data, offsets, tokens.ALNUM)
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    size = w.end - w.start
    hashes, owners = [w.hashes()], [owner]
    for n in PREFIXES:
        longer = size > n
        cut = tokens.Words(w.data, w.start[longer], w.start[longer] + n, w.first)
        hashes.append(cut.hashes() ^ np.uint64(n))
        owners.append(owner[longer])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(w.first) - 1)


def term_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tokens.pieces(batch.column("text")):
            hashes, sizes = term_sets(data, offsets)
            own = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("place", "toxic", "key")), tokens.lists(hashes.view(np.int64), sizes)], ["place", "toxic", "key", "terms"])


def place_task(shared):
    """Terms of each text as places in the model's sorted terms; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(shared.value)
        for batch in batches:
            terms = batch.column("terms")
            sizes = np.asarray(pc.list_value_length(terms)).astype(np.int64)
            at, known = machine.rows(np.asarray(terms.flatten()).astype(np.int64).view(np.uint64), sizes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("place", "toxic", "key")), tokens.lists(at.astype(np.int32), known)], ["place", "toxic", "key", "places"])

    return run


class Machine:
    """w0, the sorted term hashes, their weights and factors."""

    def __init__(self, terms: np.ndarray, factors: int = FACTORS) -> None:
        self.terms, self.w0 = terms, 0.0
        self.w = np.zeros(len(terms))
        self.v = np.zeros((len(terms), factors))

    def rows(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of each text as places in the model, and how many."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return at[known], np.bincount(owner[known], minlength=len(sizes))

    def margin(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and the factor sums of each text."""
        n, k = len(sizes), self.v.shape[1]
        linear, sums, squares = np.zeros(n), np.zeros((n, k)), np.zeros((n, k))
        has = np.flatnonzero(sizes)
        if len(has):
            begin = (np.cumsum(sizes) - sizes)[has]
            v = self.v[at]
            linear[has] = np.add.reduceat(self.w[at], begin)
            sums[has] = np.add.reduceat(v, begin)
            squares[has] = np.add.reduceat(v * v, begin)
        return self.w0 + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def fit(self, at: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> "Machine":
        """The machine of the terms that a first learning selects, learned anew on them alone."""
        self.learn(at, sizes, y)
        kept = self.used()
        out, owner = self.pruned(), np.repeat(np.arange(len(sizes)), sizes)[kept[at]]
        out.learn((np.cumsum(kept) - 1)[at[kept[at]]], np.bincount(owner, minlength=len(sizes)), y, alone=0, group=LIGHT, start=SELECTED_START)
        return out.pruned()

    def learn(self, at: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7, alone: int = ALONE, group: float = GROUP, start: float = START) -> None:
        """Logistic loss over mini-batches; terms are updated where they occur. Factors join after `alone` epochs."""
        rng, begin = np.random.default_rng(seed), np.cumsum(sizes) - sizes
        self.w, self.v = np.zeros_like(self.w), np.zeros_like(self.v)
        if not len(y):
            return
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.w0 = float(np.log(rate / (1 - rate)))
        push, seen, seen_v = np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.w)
        least = SPARSE * np.sqrt(len(y))
        for epoch in range(epochs):
            if epoch == alone:
                self.v = rng.normal(0, start / np.sqrt(max(sizes.mean(), 1)), self.v.shape)
            order = rng.permutation(len(y))
            for low in range(0, len(y), BATCH):
                docs = order[low : low + BATCH]
                n = sizes[docs]
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                terms = at[np.repeat(begin[docs], n) + inside]
                z, sums = self.margin(terms, n)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]
                each = np.repeat(error, n)
                place, back = np.unique(terms, return_inverse=True)
                g = np.bincount(back, each, len(place))
                more = seen[place] + g * g
                push[place] += g - (np.sqrt(more) - np.sqrt(seen[place])) / RATE * self.w[place]
                seen[place] = more
                far = np.maximum(np.abs(push[place]) - least, 0)
                self.w[place] = -np.sign(push[place]) * far * RATE / (1 + np.sqrt(more))
                self.w0 -= 0.01 * float(error.mean())
                if epoch < alone:
                    continue
                spread = np.repeat(sums, n, axis=0) - self.v[terms]
                gv = np.stack([np.bincount(back, each * spread[:, f], len(place)) for f in range(spread.shape[1])], axis=1)
                seen_v[place] += (gv * gv).mean(axis=1)
                step = FACTOR_RATE / (1 + np.sqrt(seen_v[place]))
                v = self.v[place] - step[:, None] * gv
                norm = np.sqrt((v * v).sum(axis=1)) + 1e-12
                self.v[place] = v * np.maximum(0, 1 - step * group / norm)[:, None]

    def used(self) -> np.ndarray:
        return (self.w != 0) | (self.v != 0).any(axis=1)

    def pruned(self) -> "Machine":
        """The same scores without the terms that learning left at zero."""
        has = self.used()
        out = Machine(self.terms[has], self.v.shape[1])
        out.w0, out.w, out.v = self.w0, self.w[has], self.v[has]
        return out


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_terms: int = SAMPLE_TERMS) -> Machine:
    rows = labels.where(F.col("toxic").isNotNull() & ~F.coalesce(held_out(F.col("doc_id"), EVERY), F.lit(True))).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("id"), F.col("id"), F.col("toxic")]
    # At most `sample` rows from here on, so one task can number them and a broadcast holds them.
    picked = rows.orderBy(*order).limit(sample).withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).withColumn("key", F.xxhash64("text"))
    # However many rows share an id, equal ones teach once and the rest are part of the same bound.
    texts = texts.select("place", "toxic", "key", "text").dropDuplicates(["place", "key"])
    terms = stage(texts.mapInArrow(term_task, "place long, toxic int, key long, terms array<long>"), "toxic-terms")
    sizes = terms.select("place", "key", F.size("terms").cast("long").alias("n")).orderBy("place", "key").limit(sample)
    upto = F.sum("n").over(W.orderBy("place", "key").rowsBetween(W.unboundedPreceding, 0))
    fit = sizes.withColumn("upto", upto).where(F.col("upto") - F.col("n") < sample_terms).select("place", "key")
    terms = terms.join(F.broadcast(fit), ["place", "key"])
    seen = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    names = seen.where(F.col("n") >= MIN_TEXTS).select("term").toArrow()["term"].to_numpy()
    machine = Machine(np.sort(names.astype(np.int64).view(np.uint64)))
    # Only the places of these terms come to the driver, in an order that reruns share.
    spots = terms.select("place", "toxic", "key", "terms").mapInArrow(place_task(docs.sparkSession.sparkContext.broadcast(machine.terms)), "place long, toxic int, key long, places array<int>")
    t = spots.toArrow().sort_by([("place", "ascending"), ("key", "ascending")])
    places = t["places"].combine_chunks()
    places = places.chunk(0) if isinstance(places, pa.ChunkedArray) else places
    at = np.asarray(places.flatten()).astype(np.int64)
    return machine.fit(at, np.asarray(pc.list_value_length(places)).astype(np.int64), t["toxic"].to_numpy().astype(float))


def score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for low, high, data, offsets in tokens.pieces(batch.column("text")):
                z, _ = machine.margin(*machine.rows(*term_sets(data, offsets)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    key = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(score_task(shared), f"doc_id {key}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), EVERY), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

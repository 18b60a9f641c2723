"""Quality by supervised subword embeddings.

A text is a bag of features: its words as they stand, a ditto for each word that is the one before again, the byte
n-grams of GRAMS lengths of each word with a mark at both ends, and the end of the text, all hashed into BUCKETS
rows of a table of vectors. Vectors are averaged over
the text, a linear layer and a softmax give the classes' probabilities, and vectors and layer are learned together
by stochastic gradient descent, text by text, with a rate that falls to zero.

It learns from at most SAMPLE labelled rows, the ones whose ids hash lowest, each with its whole text: a bag
has at most BUCKETS entries, so the sample is bounded in bytes too. As the layer is linear, a text's margin is the mean of one number
per bucket, so scoring gathers one number a feature and sends BUCKETS numbers to the tasks. Scoring covers all texts.

Edge cases: null and empty texts have the end as their only feature; rows without a label, or with a null label, teach
nothing; a row labelled twice counts twice, equal texts of one id once for each label; labels other than 0 count as 1; with no labels all scores are one half; an empty
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
from folio.llm.base import stage, unstage
from folio.llm.suffix_tree import held_out

#: Labelled rows that the model learns from: a documented bound.
SAMPLE = 4096
BUCKETS = 1 << 15
#: Buckets that no hash falls into.
END, DITTO = 0, 1
#: Times that the end of a text counts, so that texts of a few words lean on it more than on one odd word.
ENDS = 8
#: Lengths of byte n-grams of words, marks counted.
GRAMS = (2, 3, 4)
DIM = 8
EPOCHS, RATE = 4, 0.5
#: Score from which a text counts as good.
GOOD = 0.3
#: Holdout remainder: rows whose crc32(doc_id) mod 5 is 0 teach nothing.
EVERY = 5
#: Bytes of texts that are taken at once.
PIECE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of some texts and the text of each, one kind after another, so that few are held at once."""
    n, texts = len(data), len(offsets) - 1
    yield np.full(texts * ENDS, END), np.repeat(np.arange(texts), ENDS)
    # Texts are set apart by one separator each, so no gram runs over an end.
    owner = np.repeat(np.arange(texts, dtype=np.int32), np.diff(offsets))
    place = np.arange(n) + owner + 1
    spread, where = np.full(n + texts + 1, 32, np.uint8), np.zeros(n + texts + 1, np.int32)
    spread[place], where[place] = data, owner
    word = tokens.SPACED[spread]
    edges = np.diff(np.r_[False, word, False].astype(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(start):
        return
    h = tokens.Words(spread, start, end, start[:0]).hashes()
    yield bucket(h, 0), where[start]
    again = np.flatnonzero((h[1:] == h[:-1]) & (where[start[1:]] == where[start[:-1]])) + 1
    yield np.full(len(again), DITTO), where[start[again]]
    value = np.where(word, spread, 0).astype(np.uint64) + np.uint64(1)
    for k in GRAMS:
        size = len(spread) - k + 1
        if size < 1:
            continue
        ok = word[:size] | word[1 : size + 1]  # of two marks alone there is no gram
        for i in range(1, k - 1):
            ok &= word[i : i + size]
        at = np.flatnonzero(ok)
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                h = (h ^ value[at + i]) * _MIX
        yield bucket(h, k), where[at + ~word[at]]


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (tokens.mixed(h + np.uint64(kind)) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text, their counts, and how many each text has."""
    each = [np.unique(owner * np.int64(BUCKETS) + at, return_counts=True) for at, owner in features(data, offsets)]
    key, back = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
    n = np.bincount(back, np.concatenate([n for _, n in each]), len(key))
    return (key % BUCKETS).astype(np.int32), n.astype(np.int32), np.bincount(key // BUCKETS, minlength=len(offsets) - 1)


def bag_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tokens.pieces(batch.column("text"), PIECE):
            at, n, sizes = bags(data, offsets)
            own = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("place", "label", "key")), tokens.lists(at, sizes), tokens.lists(n, sizes)], ["place", "label", "key", "at", "n"])


class Embedding:
    """Vectors of the buckets and the output layer of two classes."""

    def __init__(self, seed: int = 7) -> None:
        self.vectors = np.random.default_rng(seed).uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.layer = np.zeros((DIM, 2), np.float32)

    def probabilities(self, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Softmax of one text, and its mean vector; weights sum to one."""
        mean = weight @ self.vectors[at]
        z = mean @ self.layer
        e = np.exp(z - z.max())
        return e / e.sum(), mean

    def step(self, at: np.ndarray, weight: np.ndarray, label: int, rate: float) -> None:
        """One step of gradient descent on the cross entropy of one text. The vectors' step is scaled by the squared length
        of the weights, so that a text moves its own margin by as much however many features share it."""
        p, mean = self.probabilities(at, weight)
        error = p.copy()
        error[label] -= 1
        back = self.layer @ error * np.float32(rate / (weight @ weight))
        self.layer -= np.float32(rate) * np.outer(mean, error)
        self.vectors[at] -= weight[:, None] * back

    def learn(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        rng, steps = np.random.default_rng(seed), epochs * len(labels)
        texts = [(at, (n / n.sum()).astype(np.float32)) for at, n in texts]
        for epoch in range(epochs):
            for i, k in enumerate(rng.permutation(len(labels))):
                self.step(*texts[k], int(labels[k]), RATE * (1 - (epoch * len(labels) + i) / steps))

    def margins(self) -> np.ndarray:
        """What each bucket adds to the log odds of class 1, before averaging."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0])


def sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """place, label, key and text of the rows that the model learns from."""
    named = F.col(label)
    rows = labels.where(named.isNotNull() & ~F.coalesce(held_out(F.col("doc_id"), EVERY), F.lit(True))).select(F.col("doc_id").alias("id"), (named != 0).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id"), F.col("label")]
    # At most `sample` rows from here on, so one task can number them and a broadcast holds them.
    picked = rows.orderBy(*order).limit(sample).withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).withColumn("key", F.xxhash64("text"))
    return texts.select("place", "label", "key", "text").dropDuplicates(["place", "key"])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Embedding:
    rows = stage(sampled(docs, labels, label, sample).mapInArrow(bag_task, "place long, label int, key long, at array<int>, n array<int>"), "embedded-bags")
    # However many rows share an id, at most `sample` of them are learned from, in an order that reruns share.
    t = rows.orderBy("place", "key").limit(sample).toArrow().sort_by([("place", "ascending"), ("key", "ascending")])
    at, n = (np.asarray(pc.list_flatten(t[c]).combine_chunks()) for c in ("at", "n"))
    cuts = np.cumsum(np.asarray(pc.list_value_length(t["at"])).astype(np.int64))[:-1] if len(t) else []
    model = Embedding()
    if len(t):
        model.learn(list(zip(np.split(at, cuts), np.split(n, cuts), strict=True)), t["label"].to_numpy())
    unstage(rows)
    return model


def score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = shared.value
        for batch in batches:
            for low, high, data, offsets in tokens.pieces(batch.column("text"), PIECE):
                n = high - low
                z, total = np.zeros(n), np.zeros(n)
                for at, owner in features(data, offsets):
                    z += np.bincount(owner, margins[at], n)
                    total += np.bincount(owner, minlength=n)
                z /= total
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, n), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label).margins())
    key = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(score_task(shared), f"doc_id {key}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), EVERY), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))

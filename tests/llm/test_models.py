"""Whitening, embedded classifier and phrase mining, held against brute force, SQL and held-out labels."""

import math
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from folio.llm import embedded as E
from folio.llm import phrases as P
from folio.llm import queries
from folio.llm import whitening as Z
from folio.session import table

VECTORS = "vec_id long, embedding array<float>"


def dense(spark, rows, form=VECTORS, **k):
    return [r.asDict() for r in Z.whitened(spark.createDataFrame(rows, form), **k).collect()]


# whitening


@pytest.mark.parametrize("shape", [(30, 7), (7, 7), (5, 8), (40, 1)])
def test_jacobi_is_an_svd(shape):
    a = np.random.default_rng(3).normal(size=shape) * np.logspace(0, -9, shape[1])
    if shape[1] > 4:
        a[:, 4] = a[:, 0]  # one singular value is zero
    sigma, v = Z.jacobi(Z.triangle(a))
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(sigma[: len(want)], want, rtol=1e-10, atol=1e-15)
    assert np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-12)
    assert np.allclose(np.linalg.norm(a @ v, axis=0), sigma, rtol=1e-9, atol=1e-14)


@pytest.mark.parametrize("d", [2, 3, 6, 7])
def test_rounds_hold_each_pair_once(d):
    pairs = [tuple(sorted(x)) for p, q in Z.rounds(d) for x in zip(p.tolist(), q.tolist(), strict=True)]
    assert sorted(pairs) == [(i, j) for i in range(d) for j in range(i + 1, d)]
    assert all(len({*p, *q}) == 2 * len(p) for p, q in Z.rounds(d))


def test_whitened_by_brute_force(spark):
    rng = np.random.default_rng(5)
    values = (rng.normal(size=(600, 9)) @ rng.normal(size=(9, 9))).astype(np.float32)
    values[300:450] = values[7]  # a quarter of all rows are copies
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    got = dense(spark, [*rows, (900, None), (901, [float("nan")] * 9), (902, [float("inf")] + [0.0] * 8), (903, [None] + [0.0] * 8), (1, values[0].tolist())])
    x = [[math.floor(256 * c) for c in map(float, v)] for v in values]
    fit = np.array(sorted(set(map(tuple, x))))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    assert len(got) == 601 * 4 and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] != 1}
    sign = [np.sign(by[0, k + 1]["whitened"] * ((np.array(x[0]) - sums / n) @ u[:, k])) for k in range(4)]
    for i in range(600):
        if i == 1:
            continue
        for k in range(4):
            r = by[i, k + 1]
            assert r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
            assert math.isclose(r["whitened"], sign[k] * ((np.array(x[i]) - sums / n) @ u[:, k]) / math.sqrt(e[k]), rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(r["explained"], e[k] / (centred**2).sum() * n, rel_tol=1e-9)
    assert {r["identity_error"] for r in got}.pop() < 1e-10


def test_small_deviations_keep_their_digits(spark):
    rng = np.random.default_rng(9)
    values = np.c_[rng.normal(size=(500, 2)) * 2**20, np.floor(rng.normal(size=500) * 2) / 256]
    got = dense(spark, [(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    assert max(r["component"] for r in got) == 3 and got[0]["identity_error"] < 1e-9
    third = np.array([r["whitened"] for r in got if r["component"] == 3])
    assert abs(third.std() - 1) < 1e-9


def test_triangles_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(Z, "FAN", 2)
    values = np.random.default_rng(2).normal(size=(400, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, VECTORS)
    fit = Z.gridded(df).select("x").repartition(7)
    x = np.floor(256 * values.astype(np.float32).astype(float))
    r = Z.tsqr(fit, x.mean(axis=0))
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c)


@pytest.mark.parametrize("top", [1, 1 << 24, 1 << 30, 1 << 52])
def test_distances_are_exact(top):
    rng = np.random.default_rng(1)
    x = rng.integers(-top, top + 1, (20, 6))
    model = Z.Whitening(12345, [int(v) * 9999 for v in x[0]], np.zeros((6, 0)), np.zeros(0), np.zeros(0))
    want = [sum((12345 * int(a) - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x]
    assert model.distances(x) == [w if w < 1 << 63 else None for w in want]
    assert Z.exact_sum(x).tolist() == [sum(map(int, x[:, k])) for k in range(6)]


def test_whitening_of_odd_tables(spark):
    assert dense(spark, []) == []
    assert dense(spark, [(1, None), (2, [])]) == []
    one = dense(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0])])
    assert len(one) == 8 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is r["explained"] is r["identity_error"] is None for r in one)
    flat = dense(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert {(r["vec_id"], r["component"]): r["whitened"] and round(abs(r["whitened"]), 12) for r in flat} == {(1, 1): 1.0, (1, 2): None, (2, 1): 1.0, (2, 2): None}
    assert {r["explained"] for r in flat} == {1.0, 0.0} and flat[0]["identity_error"] < 1e-12
    ragged = dense(spark, [(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 5.0])])
    assert {r["n"] for r in ragged} == {2}
    far = dense(spark, [("a", [1e300, 0.0], 1), ("b", [-1e300, 0.0], 2)], "vec_id string, embedding array<double>, x int")
    assert {r["deviation"] for r in far} == {None} and {r["vec_id"] for r in far} == {"a", "b"}


# embedded classifier


def grams_of(text):
    """Features by plain Python, as (kind, bytes)."""
    out, words = Counter({("end", b""): E.ENDS}), [w for w in text.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    for last, w in zip([None, *words], words, strict=False):
        out["word", w] += 1
        out["ditto", b""] += w == last
        marked = [None, *w, None]
        for k in E.GRAMS:
            for i in range(len(marked) - k + 1):
                out[k, tuple(marked[i : i + k])] += 1
    return +out


def found(data, offsets):
    at, owner = zip(*E.features(np.frombuffer(data, np.uint8), offsets), strict=True)
    return np.concatenate(at), np.concatenate(owner)


def test_features_by_brute_force():
    texts = ["", "a", "ab ab ab abc", "  Überfall\tüber\n\nÜberfall ", "x" * 300 + " y", "\n"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    at, owner = found(data, offsets)
    place = {}
    for i, t in enumerate(texts):
        want, got = grams_of(t), Counter(at[owner == i].tolist())
        assert sorted(got.values()) == sorted(want.values())
        alone, _ = found(t.encode(), np.array([0, len(t.encode())]))
        assert Counter(alone.tolist()) == got  # what stands around a text is no part of it
        place[t] = got
    assert place["a"].keys() < {*place["a"], *place["ab ab ab abc"]}


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(4)
    m = E.Embedding()
    m.vectors, m.layer = m.vectors.astype(float), rng.normal(size=m.layer.shape)
    at, weight = np.array([3, 8, 90]), np.array([0.5, 0.25, 0.25])
    loss = lambda: -np.log(m.probabilities(at, weight)[0][1])
    was, grad = m.vectors.copy(), np.zeros((3, E.DIM))
    for i, row in enumerate(at):
        for j in range(E.DIM):
            m.vectors[row, j] += 1e-6
            up = loss()
            m.vectors[row, j] -= 2e-6
            grad[i, j] = (up - loss()) / 2e-6
            m.vectors[row, j] += 1e-6
    m.step(at, weight, 1, 0.01)
    assert np.allclose((was - m.vectors)[at], 0.01 / (weight @ weight) * grad, atol=1e-7)
    assert (np.delete(m.vectors, at, 0) == np.delete(was, at, 0)).all()


def test_margins_give_the_softmax():
    m = E.Embedding()
    m.layer = np.random.default_rng(1).normal(size=m.layer.shape)
    at, owner = found(b"one two two", np.array([0, 11]))
    key, n = np.unique(at, return_counts=True)
    p, _ = m.probabilities(key, n / n.sum())
    assert math.isclose(p[1], 1 / (1 + math.exp(-m.margins()[at].mean())), rel_tol=1e-6)


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = E.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))
    both = got.where("held_out").join(table(spark, sf, "labels").where("quality is not null"), "doc_id").select("quality", "predicted", "score").collect()
    assert sum(r["quality"] == r["predicted"] for r in both) >= 0.97 * len(both) > 50
    assert all(r["predicted"] for r in both if r["quality"] == 1)
    assert all(0 <= r["score"] <= 1 for r in both)


def test_classifier_of_odd_tables(spark):
    form = "doc_id string, text string, label int, place int"
    docs = spark.createDataFrame([("a", None, 1, 2), ("b", "", 1, 2), (None, "x", 1, 2), ("a", "one " * 5000, 1, 2), ("c", "🦉 é", 1, 2)], form)
    none = spark.createDataFrame([], "doc_id string, quality int")
    assert {r["score"] for r in E.scored(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([("a", 1), ("a", 1), ("c", 0), ("zz", 1), (None, 0), ("b", None)], "doc_id string, quality int")
    got = E.scored(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["score"] == got[1]["score"]  # null and empty
    assert E.scored(docs.limit(0), labels).collect() == []
    assert sorted(map(tuple, E.scored(docs.repartition(3), labels).collect()), key=repr) == sorted(map(tuple, got), key=repr)


# phrases


def mined(rows, longest=3, least=10, top=2000):
    """The contract word for word."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang if lang is not None else "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(end, ".")
        for piece in text.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        holds = [b for (other, q), b in cand.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in holds):
            continue
        score, _, left, right = min((math.floor(Fraction(1000000 * a * a, f[lang, p[:k]] * f[lang, p[k:]])), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -score) for lang, rows in out.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def phrase_rows(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("held", [P.HELD, 2000])
def test_phrases_by_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(P, "HELD", held)
    monkeypatch.setattr(P.tokens, "PIECE", 1 << 20)
    rng = np.random.default_rng(8)
    words = ["the", "The", "of", "new", "york", "city", "é", "\x01", "a\x01", "日本", "x" * 40]
    rows = [(lang, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(90))) for lang in ["en", "de", None, "und", ""] * 12]
    rows += [("en", None), ("en", ""), ("fr", " .;"), ("en", "new york city " * 400), ("en", "new york city " * 400)]
    df = spark.createDataFrame([(t, lang, 1, [2]) for lang, t in rows], "text string, lang string, n int, path array<int>").repartition(5)
    want = mined(rows)
    assert len(want) > 100 and {r[0] for r in want} == {"en", "de", "und", ""}
    assert phrase_rows(P.mined(df)) == want
    assert phrase_rows(P.mined(df, longest=4, least=15, top=7)) == mined(rows, 4, 15, 7)


def test_phrases_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(tuple(r) for r in c.sql(f"select {', '.join(COLUMNS)} from ({P.mined_sql()})").fetchall())
    assert want and phrase_rows(queries.op13_phrase_mining(spark, sf_dir)) == want


def test_scores_pass_64_bits(spark):
    a, left, right = 3 * 10**12 + 7, 7 * 10**12 + 1, 4 * 10**12 + 3
    df = spark.createDataFrame([("en", ["a", "b"], a, [left], [right])], "lang string, path array<string>, n long, lefts array<long>, rights array<long>")
    assert P.scored(df).first()["score"] == 10**6 * a * a // (left * right)


def test_phrases_of_empty_tables(spark):
    form = "lang string, text string"
    assert P.mined(spark.createDataFrame([], form)).collect() == []
    assert P.mined(spark.createDataFrame([("en", "a b")], form)).collect() == []


def test_whitening_query(spark, sf_dir):
    df = queries.op11_embedding_whitening(spark, sf_dir)
    assert df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert df.count() == 4 * table(spark, sf_dir, "embeddings").count()
    assert df.first()["identity_error"] < 1e-9

"""Word hashes and minimizers against their definitions, and what they cost."""

import time

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import passages, tokens


def plain_hashes(texts):
    out = []
    for t in texts:
        for word in (t or "").lower().split():
            x = sum(int(tokens._BYTE[b]) * pow(tokens._BASE, k, 1 << 64) for k, b in enumerate(word.encode()))
            out.append(x % (1 << 64))
    return tokens.mixed(np.array(out, np.uint64)).tolist()


@pytest.mark.parametrize("piece", [1 << 20, 1])
def test_hashes_by_sums_are_those_of_each_word(monkeypatch, piece):
    """Texts above four pieces take the other way, with the same result."""
    texts = ["", None, " ", "a", "The quick  brown fox", "the слово " * 30, "x" * 500 + " y"]
    got = [w.hashes().tolist() for _, _, data, offsets in tokens.pieces(pa.array(texts)) for w in [tokens.words(data, offsets)]]
    monkeypatch.setattr(tokens, "PIECE", piece)
    again = [w.hashes().tolist() for _, _, data, offsets in tokens.pieces(pa.array(texts)) for w in [tokens.words(data, offsets)]]
    assert sum(got, []) == sum(again, []) == plain_hashes(texts)


def test_minimizers_are_the_least_of_each_window():
    rng = np.random.default_rng(5)
    for n in [*range(30), *[400] * 20]:
        values, ok = rng.integers(0, 9, n).astype(np.uint64), rng.random(n) < 0.9
        want = np.zeros(n, bool)
        for i in np.flatnonzero(ok):
            run = next((k for k in range(i, min(n, i + passages.WINDOW)) if not ok[k]), min(n, i + passages.WINDOW))
            want[min(range(i, run), key=lambda k: (values[k], -k))] = True
            want[i] |= i == 0 or i == n - 1 or not ok[i - 1] or not ok[i + 1]
        assert (passages.minimizers(values, ok) == want).all()


def test_minimizers_cost_three_steps_a_window():
    """Less than half of what seven steps, one for each further place of a window, take."""
    values, ok = np.random.default_rng(6).integers(0, 1 << 62, 1 << 20).astype(np.uint64), np.ones(1 << 20, bool)

    def steps():
        best, at = values.copy(), np.arange(len(values))
        for j in range(1, passages.WINDOW):
            later = np.full(len(values), 2**64 - 1, np.uint64)
            later[:-j] = values[j:]
            take = later <= best
            best[take], at[take] = later[take], np.arange(len(values))[take] + j

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert 2 * least(lambda: passages.minimizers(values, ok)) < least(steps)

import numpy as np
import pytest

from tradespan.llm.fmindex import FMIndex, WaveletMatrix, suffix_order


def phrases(seed, n=300, vocabulary=5):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, vocabulary + 1, n)
    text[rng.random(n) < 0.15] = 0
    text[-1] = 0
    return text


@pytest.mark.parametrize("seed", range(6))
def test_occurrences_equal_a_plain_search(seed):
    text = phrases(seed, vocabulary=2 + seed)
    index = FMIndex(text, 2 + seed, sample=1 + seed)
    rng = np.random.default_rng(seed)
    for k in (1, 2, 3, 5):
        patterns = rng.integers(1, 3 + seed, (40, k))
        which, where = index.occurrences(patterns)
        got = sorted(zip(which.tolist(), where.tolist()))
        assert got == [(p, i) for p in range(40) for i in range(len(text) - k + 1) if (text[i : i + k] == patterns[p]).all()]


def test_suffix_order_sorts_suffixes():
    text = phrases(3, 120)
    ranked = text.astype(float)
    ends = np.flatnonzero(text == 0)
    ranked[ends] = np.arange(len(ends)) / 1000
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: ranked[i:].tolist())


def test_wavelet_rank_and_access():
    values = np.random.default_rng(1).integers(0, 13, 200)
    w = WaveletMatrix(values, 4)
    assert w.access(np.arange(200)).tolist() == values.tolist()
    for c in range(13):
        assert w.rank(np.full(201, c), np.arange(201)).tolist() == [int((values[:i] == c).sum()) for i in range(201)]


def test_empty_and_repeats():
    assert FMIndex(np.zeros(0, int), 3).occurrences(np.array([[1]]))[0].size == 0
    text = np.tile([1, 2, 0], 50)
    assert len(FMIndex(text, 2).occurrences(np.array([[1, 2]]))[1]) == 50

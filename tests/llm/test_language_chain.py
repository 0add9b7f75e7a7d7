"""Texts longer than a part are one chain; words are runs of letters."""

import numpy as np
import pytest

from wavetide.llm import langid


@pytest.mark.parametrize("counts", [[1, 7, 23, 5, 10], [3], [40, 2]])
def test_parts_of_a_chain_equal_the_whole(monkeypatch, counts):
    monkeypatch.setattr(langid, "PART", 5)
    rng, k = np.random.default_rng(0), 4
    model = langid.Crf(list("abcd"), np.zeros((langid.ROWS, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    n = np.array(counts)
    parts = -(-n // 5)
    text = np.repeat(np.arange(len(n)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    length = np.minimum(5, n[text] - number * 5)
    e, inside = rng.normal(size=(n.sum(), k)) * 3, np.arange(5) < length[:, None]
    padded = np.zeros((len(text), 5, k))
    padded[inside] = e
    got = model.posteriors(padded, length, number)[inside]
    for at, c in zip(np.cumsum(n) - n, counts):
        own = np.exp(e[at : at + c] - e[at : at + c].max(axis=1, keepdims=True))[None]
        want = langid.forward_backward(own, np.array([c]), np.exp(model.transitions), np.exp(model.first))[0][0]
        assert np.allclose(got[at : at + c], want)


def test_numbers_that_are_no_digits_are_no_letters():
    assert langid.words_of("½ ² ① Ⅷ 12 _") == [] and langid.words_of("x² Straße don't") == ["x", "straße", "don", "t"]

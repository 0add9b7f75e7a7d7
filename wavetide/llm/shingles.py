"""Sets of word shingles of whole texts, as sorted 64-bit hashes, for many texts at once in numpy."""

from __future__ import annotations

import re

import numpy as np

from .common import per_task

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = _TABLE[_LOWER]
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@per_task
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text (UTF-8), its distinct k-word shingles, sorted; fewer words make one shingle, none an empty set.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z in
    lower case. Texts are read PIECE bytes at a time, long ones in parts that share k - 1 words.
    """
    out, part, held = [], [], 0
    for t in texts:
        if part and held + len(t) > PIECE:
            out += _sets(part, k)
            part, held = [], 0
        if len(t) > PIECE:
            out.append(_long_set(t, k))
        else:
            part.append(t)
            held += len(t)
    return out + _sets(part, k)


#: Bytes that are hashed at once, and the whitespace between words.
PIECE = 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0d]+")


def _long_set(text: bytes, k: int) -> np.ndarray:
    """The set of one text, by parts that end between words."""
    sets, at, size = [], 0, PIECE
    while True:
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        words = text[at:end].rsplit(None, k - 1)  # all but the last k - 1 words, and these
        if end == len(text) or len(words) == k:
            if len(words) == k or not sets:
                sets += _sets([text[at:end]], k)
            if end == len(text):
                return np.unique(np.concatenate(sets))
            at, size = at + len(words[0]), PIECE
        else:
            size *= 2


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    if not texts:
        return []
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts_of = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    power, inverse = (p[: len(buf)] for p in _powers((len(buf) >> 19) + 1 << 19))
    sums = np.cumsum(_TABLE[buf] * power)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]  # the buffer ends with a space
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in texts]
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    words = mix((sums[ends - 1] - before) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, starts_of)  # each text's first word
    weights = [mix(np.array([j + 1], np.uint64))[0] | np.uint64(1) for j in range(k)]
    rolled = words[: max(0, len(words) - k + 1)] * weights[0]
    for j in range(1, k):
        rolled = rolled + words[j : j + len(rolled)] * weights[j]
    rolled = mix(rolled)
    out = []
    for d in range(len(texts)):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
        elif b > a:
            one = np.array([b - a], np.uint64)
            for j in range(b - a):
                one = one + words[a + j : a + j + 1] * weights[j]
            out.append(mix(one))
        else:
            out.append(np.empty(0, np.uint64))
    return out

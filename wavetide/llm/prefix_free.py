"""Prefix-free parsing of the texts of one task: their suffixes in order, from suffix arrays of a dictionary and a parse.

A rolling hash of WINDOW bytes ends a phrase wherever it meets a trigger, and the next phrase begins with the same WINDOW
bytes. So no suffix of a phrase that is longer than WINDOW is the beginning of another one (it would hold a trigger inside),
and two suffixes of the texts compare like the rests of their phrases, or, where these are equal, like what follows in the
parse. Repetitive texts have few different phrases: only the dictionary's bytes are sorted as bytes, the parse as numbers.
"""

from __future__ import annotations

import numpy as np

from .collocations import suffix_order as parse_order
from .shingles import mix

WINDOW, EVERY = 6, 32


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the phrases of texts data[start:end]; a phrase and the next one share WINDOW bytes."""
    n = len(data)
    value = np.zeros(max(0, n - WINDOW + 1), np.uint64)
    for j in range(WINDOW):
        value = (value << np.uint64(8)) | data[j : j + len(value)].astype(np.uint64)
    stop = np.flatnonzero(mix(value + np.uint64(1)) % np.uint64(EVERY) == 0) + WINDOW
    del value
    text = np.searchsorted(ends, stop)  # the text that a trigger's end lies in
    inside = (text < len(ends)) & (stop - WINDOW >= starts[np.minimum(text, len(ends) - 1)])
    stop, text = stop[inside], text[inside]
    begin = np.concatenate([starts, stop - WINDOW])
    of = np.concatenate([np.arange(len(starts)), text])
    order = np.argsort(of, kind="stable")  # a text's start, then its triggers, which rise
    begin, of = begin[order], of[order]
    last = np.append(of[1:] != of[:-1], True)
    end = np.where(last, ends[of], np.append(begin[1:] + WINDOW, 0))
    return begin, end, of


def _words(data: np.ndarray, at: np.ndarray, size: np.ndarray, length: int) -> list[np.ndarray]:
    """The first length bytes at places, eight to a number; bytes behind size are zero."""
    out, most = [], len(data) - 1
    for k in range(0, length, 8):
        w = np.zeros(len(at), dtype=np.uint64)
        for j in range(k, min(k + 8, length)):
            w = (w << np.uint64(8)) | np.where(j < size, data[np.minimum(at + j, most)], 0).astype(np.uint64)
        out.append(w)
    return out


def corpus_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of texts data[start:end] at the places, in order as far as their first length bytes tell; and a flag
    where these bytes differ from the suffix before. Texts follow each other and each place has length bytes before its
    text's end."""
    begin, end, of = phrases(data, starts, ends)
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    named = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(begin.tolist(), end.tolist())), np.int64, len(begin))
    del raw
    # the dictionary in order, and where each phrase's bytes stand in it
    distinct = list(number)
    by = sorted(range(len(distinct)), key=distinct.__getitem__)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    parse = rank[named]
    sizes = np.array([len(distinct[k]) for k in by], np.int64)
    dictionary = np.frombuffer(b"".join(distinct[k] for k in by), np.uint8)
    place = np.cumsum(sizes) - sizes
    del number, distinct
    # suffix array of the dictionary: the rests of phrases, cut at length bytes
    rest = np.minimum(np.repeat(place + sizes, sizes) - np.arange(len(dictionary)), length)
    words = _words(dictionary, np.arange(len(dictionary)), rest, length)
    order = np.lexsort([rest, *words[::-1]])
    new = np.diff(rest[order], prepend=-1) != 0
    for w in words:
        new[1:] |= w[order[1:]] != w[order[:-1]]
    of_rest = np.empty(len(dictionary), np.int64)
    of_rest[order] = np.cumsum(new)
    del words, order
    # suffix array of the parse: phrases as numbers from 1, a 0 behind each text
    slot = np.arange(len(parse)) + of
    symbols = np.zeros(len(parse) + len(starts), np.int64)
    symbols[slot] = parse + 1
    of_parse = np.empty(len(symbols), np.int64)
    of_parse[parse_order(symbols)] = np.arange(len(symbols))
    # both give the order of the texts' suffixes
    phrase = np.searchsorted(begin, at, side="right") - 1
    spot = place[parse[phrase]] + at - begin[phrase]
    first, then = of_rest[spot], of_parse[slot[phrase] + 1]
    order = np.argsort(first * np.int64(len(symbols)) + then, kind="stable")
    differs = np.diff(first[order], prepend=-1) != 0
    # equal rests that are shorter than length: their bytes tell
    short = np.flatnonzero(~differs & (rest[spot[order]] < length))
    for lo in range(0, len(short), 1 << 20):
        here = short[lo : lo + (1 << 20)]
        a, b = at[order[here]], at[order[here - 1]]
        for x, y in zip(_words(data, a, np.full(len(a), length), length), _words(data, b, np.full(len(b), length), length)):
            differs[here] |= x != y
    return order, differs

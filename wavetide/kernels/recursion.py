"""Linear recursions: filtered in blocks, and continued over the chunks of a signal.

A filter with state s does y = C s + D x and s' = A s + B x at each sample. Over a block of samples the output is a
triangular matrix times the samples plus a matrix times the state before the block, so only the states of blocks follow
each other. Over a chunk of n samples the state goes through the affine map s -> A^n s + b, where b is the state that the
chunk leaves when it starts from nothing. Such maps compose, in any grouping: that is how chunks in different tasks get
their states.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 64


@lru_cache(maxsize=256)
def _blocks(a: tuple, b: tuple, c: tuple, d: float, n: int) -> tuple[np.ndarray, ...]:
    """For blocks of n samples: output from samples and from the state, state from the state and from samples."""
    a, b, c = np.array(a), np.array(b), np.array(c)
    powers = [np.eye(len(b))]
    for _ in range(n):
        powers.append(a @ powers[-1])
    answer = np.array([d, *(c @ powers[k] @ b for k in range(n - 1))])
    lag = np.arange(n)[:, None] - np.arange(n)[None]
    return np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0), np.stack([c @ p for p in powers[:n]]), powers[n], np.stack([powers[n - 1 - k] @ b for k in range(n)], axis=1)


def state_filter(a, b, c, d: float, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filtered samples and the state behind them."""
    a = tuple(map(tuple, np.asarray(a, float).tolist()))
    b, c = (tuple(np.asarray(v, float).tolist()) for v in (b, c))
    x, state = np.asarray(x, float), np.array(state, float)
    out = np.empty(len(x))
    whole = len(x) // BLOCK * BLOCK
    for lo, hi, n in ((0, whole, BLOCK), (whole, len(x), len(x) - whole)):
        if hi == lo:
            continue
        by_sample, by_state, onward, into = _blocks(a, b, c, float(d), n)
        rows = x[lo:hi].reshape(-1, n)
        gained = rows @ into.T
        before = np.empty((len(rows), len(state)))
        for k, g in enumerate(gained):
            before[k] = state
            state = onward @ state + g
        out[lo:hi] = (rows @ by_sample.T + before @ by_state.T).ravel()
    return out, state


def section(b0: float, b1: float, b2: float, a0: float, a1: float, a2: float):
    """A, B, C, D of a second-order section in transposed direct form II."""
    b0, b1, b2, a1, a2 = (v / a0 for v in (b0, b1, b2, a1, a2))
    return [[-a1, 1.0], [-a2, 0.0]], [b1 - a1 * b0, b2 - a2 * b0], [1.0, 0.0], b0


def transition(step, size: int) -> np.ndarray:
    """A of a recursion by its answers to one silent sample; step(x, state) returns (output, state)."""
    return np.stack([step(np.zeros(1), unit)[1] for unit in np.eye(size)], axis=1)


def through(a: np.ndarray, counts, gains, state: np.ndarray) -> tuple[list[np.ndarray], int, np.ndarray]:
    """The states before each of consecutive chunks; their samples in all and the state that they leave from nothing.

    a is (m, m); gains and state have m values for each channel, channels first to last within a value.
    """
    m = len(a)
    before, total, own, powers = [], 0, np.zeros_like(state), {}
    for n, g in zip(counts, gains):
        before.append(state)
        if n not in powers:
            powers[n] = np.linalg.matrix_power(a, n)
        move = lambda s, p=powers[n]: (p @ s.reshape(m, -1)).ravel()
        state, own, total = move(state) + g, move(own) + g, total + n
    return before, total, own

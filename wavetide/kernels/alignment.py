"""Dynamic time warping in tiles: cells of one anti-diagonal at a time, and borders that tiles hand on.

A tile needs the costs in the row above it, in the column to its left and in the cell before its corner; its last row and
column are what its neighbours need. With each cost travels where its path has entered the tile: a place on the tile's rim.
So the way through a tile is known from its border alone.
"""

from __future__ import annotations

import numpy as np


def tile(cost: np.ndarray, above: np.ndarray, left: np.ndarray, corner: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(accumulated cost, step, entry) of every cell.

    step: 0 from the diagonal, 1 along y (from the left), 2 along x (from above), of equal ones the first. entry: the rim
    cell that the path came from; 0 is the corner, then come the cells of the row above, then those of the left column.
    """
    n, m = cost.shape
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 1:], d[1:, 0], d[0, 0] = above, left, corner
    entry = np.zeros((n + 1, m + 1), np.int32)
    entry[0, 1:], entry[1:, 0] = np.arange(1, m + 1), np.arange(m + 1, m + n + 1)
    step = np.zeros((n + 1, m + 1), np.int8)
    flat, from_, steps, width = d.ravel(), entry.ravel(), step.ravel(), m + 1
    padded = np.zeros((n + 1, m + 1))
    padded[1:, 1:] = cost
    costs = padded.ravel()
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        at = i * width + (s - i)
        best, way, came = flat[at - width - 1], np.zeros(len(at), np.int8), from_[at - width - 1]
        for code, back in ((1, 1), (2, width)):
            less = flat[at - back] < best
            best, way, came = np.where(less, flat[at - back], best), np.where(less, np.int8(code), way), np.where(less, from_[at - back], came)
        flat[at], steps[at], from_[at] = costs[at] + best, way, came
    return d[1:, 1:], step[1:, 1:], entry[1:, 1:]


def path_in(step: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """The cells from (i, j) back to where the path enters the tile."""
    out = []
    while i >= 0 and j >= 0:
        out.append((i, j))
        s = step[i, j]
        i, j = i - (s != 1), j - (s != 2)
    return out

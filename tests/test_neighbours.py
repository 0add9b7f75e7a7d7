"""Nearest neighbours by cells against all pairs."""

import numpy as np
import pytest

from wavetide.operators import neighbours as N


def rows_of(rng, n, ids):
    centres = rng.normal(size=(6, 5)) * 8
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 5))
    x[: n // 4] = x[0]  # a quarter are one vector: ties
    return [(s, int(i), v.tolist()) for s in ("p", "q") for i, v in zip(ids, x)]


def all_pairs(a, b, k, metric, width):
    out = []
    for s, i, v in a:
        near = []
        for z, j, w in b:
            if z == s and abs(i - j) >= width and v and w and None not in v + w:
                x, y = np.array(v), np.array(w)
                if metric == "cosine":
                    if not x.any() or not y.any():
                        continue
                    x, y = x / np.sqrt((x * x).sum()), y / np.sqrt((y * y).sum())
                near.append((float(np.sqrt(((x - y) ** 2).sum())) if metric == "euclidean" else float(np.clip(1 - (x * y).sum(), 0, 2)), j))
        out += [(s, i, j, d) for d, j in sorted(near)[:k]]
    return out


@pytest.mark.parametrize("metric, width, cell, block, part", [("euclidean", 0, 20, 16, 1000), ("euclidean", 3, 30, 7, 40), ("cosine", 1, 15, 50, 60), ("euclidean", 1, 2048, 1024, 1 << 18)])
def test_cells_find_what_all_pairs_find(spark, monkeypatch, metric, width, cell, block, part):
    for name, value in (("CELL", cell), ("BLOCK", block), ("PART", part)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(width + cell)
    a, b = rows_of(rng, 120, rng.permutation(400)[:120]), rows_of(rng, 200, rng.permutation(400)[:200])
    odd = [("p", 1000, None), ("p", 1001, [1.0, None, 2.0, 0.0, 0.0]), ("q", 1002, []), (None, 1003, [1.0] * 5), ("only", 1004, [1.0] * 5), ("p", 1005, [0.0] * 5)]
    left = spark.createDataFrame(a + odd, "signal_id string, i long, v array<double>").repartition(3)
    right = spark.createDataFrame(b + odd[:4] + odd[5:], "signal_id string, j long, w array<double>").repartition(3)
    got = sorted(tuple(r) for r in N.nearest(left, right, 4, metric, width).collect())
    want = sorted(all_pairs(a + odd[5:], b + odd[5:], 4, metric, width))
    key = lambda rows: sorted((s, i, round(d, 9)) for s, i, _, d in rows)
    assert key(got) == key(want)  # equal distances may come from numbers that differ in the last bit
    near = {(s, i, j): d for s, i, j, d in all_pairs(a + odd[5:], b + odd[5:], 1000, metric, width)}
    assert all(abs(near[s, i, j] - d) < 1e-12 for s, i, j, d in got) and len(set(got)) == len(got)


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(1, 5, [1.0, 2.0])], "signal_id long, i long, v array<double>")
    other = one.toDF("signal_id", "j", "w")
    assert [tuple(r) for r in N.nearest(one, other, 3).collect()] == [(1, 5, 5, 0.0)]
    assert not N.nearest(one, other, 3, width=1).collect() and not N.nearest(one.limit(0), other, 3).collect() and not N.nearest(one, other.limit(0), 3).collect()


def test_distant_blocks_are_left_out():
    best = N._Best(np.array([0]), np.zeros((1, 2)), 1, 0, False)
    best.meet(np.array([7]), np.array([[3.0, 4.0]]), 0.0)
    best.meet(np.array([8]), np.array([[0.0, 0.0]]), 5.1)  # skipped: by its bound nothing of it can be nearer
    assert best.j.tolist() == [7] and best.d.tolist() == [5.0]

"""Tiles of an alignment against the plain recursion, merging by heap against the plain search, interval cells against all pairs."""

import numpy as np
import pytest

from wavetide.kernels import sequence
from wavetide.operators import alignment as A
from wavetide.operators import signals as S


def plain_dtw(x, y, subseq):
    c = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    d, back = np.zeros(c.shape), np.zeros(c.shape, int)
    for i in range(len(x)):
        for j in range(len(y)):
            if i == 0 and (j == 0 or subseq):
                d[i, j], back[i, j] = c[i, j], 1
            else:
                ways = [d[i - 1, j - 1] if i and j else np.inf, d[i, j - 1] if j else np.inf, d[i - 1, j] if i else np.inf]
                back[i, j] = int(np.argmin(ways))
                d[i, j] = c[i, j] + ways[back[i, j]]
    return d, back


@pytest.mark.parametrize("subseq", [False, True])
def test_kernel_equals_the_recursion(subseq):
    rng = np.random.default_rng(3)
    for _ in range(40):
        x, y = rng.integers(0, 4, (rng.integers(1, 12), 2)).astype(float), rng.integers(0, 4, (rng.integers(1, 12), 2)).astype(float)
        d, step = sequence.dtw(x, y, subseq)
        want, back = plain_dtw(x, y, subseq)
        assert np.array_equal(d, want) and np.array_equal(step[1:, 1:], back[1:, 1:])


@pytest.mark.parametrize("subseq, block", [(False, 7), (True, 5), (False, 64)])
def test_tiles_equal_the_whole_matrix(spark, subseq, block):
    rng = np.random.default_rng(block)
    sizes = {1: (30, 41), 2: (12, 30), 3: (1, 20), 4: (21, 1) if not subseq else (3, 8), 5: (14, 14)}
    xs, ys = ({k: rng.normal(size=(n[side], 3)).cumsum(axis=0) for k, n in sizes.items()} for side in (0, 1))
    frames = lambda m, extra: spark.createDataFrame([(k, t, f.tolist()) for k, v in m.items() for t, f in enumerate(v)] + extra, "signal_id long, t long, f array<double>").repartition(3)
    cost, path = A.align(frames(xs, [(9, 0, [1.0, 1.0, 1.0])]), frames(ys, []), subseq, block=block)
    costs = {r.signal_id: r.cost for r in cost.collect()}
    cells = {}
    for r in path.collect():
        cells.setdefault(r.signal_id, []).append((r.i, r.j))
    assert set(costs) == set(sizes) == set(cells)
    for k, x in xs.items():
        d, want = sequence.dtw_backtrack(x, ys[k], subseq)
        assert abs(costs[k] - (d[-1].min() if subseq else d[-1, -1])) < 1e-9
        assert sorted(cells[k]) == sorted(want)


def test_no_frames_align_to_nothing(spark):
    none = spark.createDataFrame([], "signal_id long, t long, f array<double>")
    cost, path = A.align(none, none)
    assert not cost.collect() and not path.collect()


def test_heap_merges_as_the_plain_search():
    def plain(data, k):
        starts, sums, counts = list(range(len(data))), [x.astype(float) for x in data], [1] * len(data)
        while len(starts) > k:
            cost = [a * b / (a + b) * ((x / a - y / b) ** 2).sum() for x, y, a, b in zip(sums, sums[1:], counts, counts[1:])]
            i = int(np.argmin(cost))
            sums[i], counts[i] = sums[i] + sums[i + 1], counts[i] + counts[i + 1]
            del starts[i + 1], sums[i + 1], counts[i + 1]
        return starts

    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        data = rng.integers(0, 3, (n, 2)).astype(float) if rng.random() < 0.5 else rng.normal(size=(n, 3))
        k = int(rng.integers(1, n + 1))
        assert sequence.agglomerative(data, k).tolist() == plain(data, k)
    assert len(sequence.agglomerative(rng.normal(size=(20_000, 4)), 50)) == 50


@pytest.mark.parametrize("whole", [True, False])
def test_interval_cells_find_all_that_touch(spark, whole):
    rng = np.random.default_rng(7)
    kind = "long" if whole else "double"

    def made(n):
        start = rng.integers(-200, 200, n) if whole else rng.uniform(-2, 2, n)
        length = rng.integers(0, 60, n) * rng.integers(0, 5, n) if whole else rng.exponential(0.2, n) * (rng.random(n) < 0.9)
        return [(int(rng.integers(0, 2)), k, s.item(), (s + w).item()) for k, (s, w) in enumerate(zip(start, length))]

    a, b = made(120), made(150)
    df = lambda rows: spark.createDataFrame(rows, f"signal_id long, interval_no long, start {kind}, end {kind}").repartition(3)
    pairs = sorted(tuple(r) for r in S.overlapping(df(a), df(b)).select("signal_id", "interval_no", "other").collect())
    assert pairs == sorted((s, i, j) for s, i, p, q in a for z, j, x, y in b if s == z and x <= q and y >= p)
    want = {}
    for s, i, p, q in a:
        best = []
        for z, j, x, y in b:
            if s == z and x <= q and y >= p:
                union = max(q, y) - min(p, x)
                best.append((-((min(q, y) - max(p, x)) / union if union > 0 else 0.0), j))
        if best:
            want[s, i] = min(best)[1]
    assert {(r.signal_id, r.interval_no): r.match for r in S.match_intervals(df(a), df(b)).collect()} == want

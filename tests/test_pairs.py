"""Queries over two matrices of a signal take in all frames, also of signals shorter or longer than the tables' ones."""

import numpy as np
import pytest

from wavetide import registry
from wavetide.kernels import dsp, features, sequence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    rows = [(u, float(rng.random() * 100)) for u, n in enumerate((20, 48, 90, 140)) for _ in range(n)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(rows)], "event_id long, user_id long, value double").write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def pairs(spark, folder):
    y = {}
    for r in sorted(spark.read.parquet(f"{folder}/events.parquet").collect()):
        y.setdefault(r["user_id"], []).append(r["value"])
    s = {u: np.abs(dsp.stft(np.array(v), 16, 4, center=False)) for u, v in y.items()}
    return {u: (x, np.concatenate([x[3:], x[:3]])) for u, x in s.items()}


def by_signal(spark, folder, name):
    out = {}
    for r in registry.queries()[name](spark, folder).collect():
        out.setdefault(r["signal_id"], []).append(r)
    return out


def test_frames_number_2_to_32(pairs):
    assert [len(s) for s, _ in pairs.values()] == [2, 9, 19, 32]


@pytest.mark.parametrize("name,kernel", [("dtw", lambda s, r: sequence.dtw(s, r)[0]), ("nnls", features.nnls)])
def test_whole_matrices(spark, folder, pairs, name, kernel):
    got = by_signal(spark, folder, name)
    for u, (s, r) in pairs.items():
        assert np.allclose([x["f"] for x in sorted(got[u], key=lambda x: x["t"])], kernel(s, r), atol=1e-5)


def test_whole_paths(spark, folder, pairs):
    got = by_signal(spark, folder, "dtw_backtrack")
    for u, (s, r) in pairs.items():
        path = [(x["i"], x["j"]) for x in sorted(got[u], key=lambda x: x["step"])]
        assert path == sequence.dtw_backtrack(s, r)[1]
        assert {i for i, _ in path} == {j for _, j in path} == set(range(len(s)))


def test_whole_similarity(spark, folder, pairs):
    got = by_signal(spark, folder, "cross_similarity_sparse")
    for u, (s, r) in pairs.items():
        want = sequence.cross_similarity(s, r, k=2, mode="distance")
        have = np.zeros_like(want)
        for x in got.get(u, []):
            have[x["i"], x["j"]] = x["w"]
        assert np.allclose(have, want, atol=1e-5)

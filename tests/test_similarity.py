"""Similarity queries on every label of a small table, against brute force."""

import numpy as np
import pytest

from wavetide import registry
from wavetide.kernels import sequence

DIM, K = 64, 4


@pytest.fixture(scope="module")
def labels():
    """vec_id and vectors of each label; the ids lie behind 5000 and have gaps."""
    rng = np.random.default_rng(4)
    ids, label = 4000 + 700 * np.arange(60), np.arange(60) % 10
    v = rng.normal(size=(60, DIM)).astype(np.float32).astype(float)
    return {int(g): (ids[label == g], v[label == g]) for g in range(10)}


@pytest.fixture(scope="module")
def folder(spark, labels, tmp_path_factory):
    rows = [(int(i), [float(x) for x in y], g) for g, (ids, v) in labels.items() for i, y in zip(ids, v)]
    path = str(tmp_path_factory.mktemp("embeddings"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def distances(v, metric="euclidean"):
    if metric == "euclidean":
        return np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    return 1 - v @ v.T / np.sqrt(np.outer((v * v).sum(axis=1), (v * v).sum(axis=1)))


def neighbours(v, metric="euclidean"):
    d = distances(v, metric)
    return d, [[int(j) for j in np.argsort(d[i], kind="stable") if j != i][:K] for i in range(len(v))]


def edges(labels, metric="euclidean"):
    """(label, i, j): d, with vec_ids."""
    out = {}
    for g, (ids, v) in labels.items():
        d, near = neighbours(v, metric)
        out |= {(g, int(ids[i]), int(ids[j])): d[i, j] for i in range(len(v)) for j in near[i]}
    return out


def rows(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name,metric", [("cross_similarity", "euclidean"), ("cross_similarity_cosine", "cosine")])
def test_neighbours_of_every_label(spark, folder, labels, name, metric):
    got, want = {(r["signal_id"], r["i"], r["j"]): r["d"] for r in rows(spark, folder, name)}, edges(labels, metric)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1.1e-5 for e in want)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_distances_of_every_label(spark, folder, labels, metric):
    got = {(r["signal_id"], r["i"], r["j"]): r["d"] for r in rows(spark, folder, f"cdist_{metric}")}
    want = {(g, int(a), int(b)): x for g, (ids, v) in labels.items() for a, y in zip(ids, distances(v, metric)) for b, x in zip(ids, y) if a != b}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1.1e-5 for e in want)


def test_links_of_every_label(spark, folder, labels):
    e = edges(labels)
    assert {(r["signal_id"], r["i"], r["j"]) for r in rows(spark, folder, "recurrence_matrix")} == {(g, i, j) for g, i, j in e if (g, j, i) in e}
    got = {(r["signal_id"], r["i"], r["j"]): r["w"] for r in rows(spark, folder, "recurrence_affinity")}
    far = {g: np.median([max(d for (h, i, _), d in e.items() if (h, i) == (g, a)) for a in ids]) for g, (ids, _) in labels.items()}
    assert got.keys() == e.keys() and all(abs(got[x] - np.exp(-e[x] / far[x[0]])) < 1.1e-5 for x in e)


def test_means_of_neighbours_of_every_label(spark, folder, labels):
    got = {}
    for r in sorted(rows(spark, folder, "nn_filter"), key=lambda r: r["k"]):  # every dimension
        got.setdefault((r["signal_id"], r["i"]), []).append(r["v"])
    want = {(g, int(ids[i])): v[near].mean(axis=0) for g, (ids, v) in labels.items() for i, near in enumerate(neighbours(v)[1])}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1.1e-5) for k in want)


def test_lags_equal_the_kernel_and_lead_back(spark, folder, labels):
    want = set()
    for g, (ids, v) in labels.items():
        rec = np.zeros((len(v), len(v)))
        for i, near in enumerate(neighbours(v)[1]):
            rec[near, i] = 1.0
        want |= {(g, int(ids[i]), int(lag)) for lag, i in zip(*np.nonzero(sequence.recurrence_to_lag(rec)))}
    got = [(r["signal_id"], r["i"], r["lag"]) for r in rows(spark, folder, "recurrence_to_lag")]
    assert set(got) == want and len(got) == len(want)
    back = [(r["signal_id"], r["i"], r["j"]) for r in rows(spark, folder, "lag_to_recurrence")]
    assert set(back) == set(edges(labels)) and len(back) == len(got)

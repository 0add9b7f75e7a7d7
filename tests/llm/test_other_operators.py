"""Vector, sharding and learned operators against brute force, planted cases and held-out rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetide.llm import embedding_join, graph, langid, quality, sharding, va_file

VECTORS = "vec_id long, embedding array<float>, label int, class string, unit string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "c", "u") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, VECTORS)


def planted(seed=0, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(25, dim))
    near = np.concatenate([b + rng.normal(size=(8, dim)) * 0.16 for b in base[:6]])
    x = np.concatenate([base, near, base[:3], base[:2] * 7.5])
    return [*x[rng.permutation(len(x))].tolist(), None, [], [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [1.0, 2.0], [2.0, 4.0]]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_cosine_components_equal_brute_force(spark):
    vectors = planted()
    x = [np.float32(v).astype(float) if usable(v) and any(v) else None for v in vectors]
    n = len(x)
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                links[i, j] = x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.9
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in zip(*np.nonzero(links)):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    for block in (4096, 8):
        got = {r["vec_id"]: r for r in embedding_join.cosine_components(table(spark, vectors), block=block, axes=3).collect()}
        assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(n)] == [(int(links[i].sum()), root(i), root(i) == i) for i in range(n)]
    assert embedding_join.cosine_components(table(spark, [])).count() == 0


def test_interval_join_finds_all_near_boxes(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "FAN", 2)
    rng = np.random.default_rng(1)
    low = np.sort(rng.random((20, 3)) * 5, axis=0)
    high = low + rng.random((20, 3)) * 0.3
    ids = [(k // 3 << 32) + k % 3 + 1 for k in range(20)]
    rows = [(i, bytearray(a.tobytes()), bytearray(b.tobytes())) for i, a, b in zip(ids, low, high)]
    blocks = spark.createDataFrame(rows, "block long, low binary, high binary")
    got = embedding_join._interval_pairs(blocks, 7, 0.5).collect()
    pairs = {(ids.index(r["i"]), ids.index(r["j"])) for r in got}
    assert len(pairs) == len(got)
    for i in range(20):
        for j in range(20):
            gap = np.maximum(0, np.maximum(low[i] - high[j], low[j] - high[i]))
            assert ((i, j) in pairs) == (i <= j and gap @ gap <= 0.25)
    assert embedding_join._interval_pairs(blocks.limit(0), 1, 0.5).count() == 0


@pytest.mark.parametrize("k", [1, 5, 200])
def test_top_k_equals_brute_force(spark, k):
    vectors = planted(3)
    df = table(spark, vectors)
    x = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in enumerate(vectors) if usable(v)}
    want = []
    for i in x:
        if i % 3 == 0:
            s = sorted((-int(x[i] @ x[j]), j) for j in x if j != i and len(x[j]) == len(x[i]))[:k]
            want += [(i, n, j, -v) for n, (v, j) in enumerate(s, 1)]
    got = va_file.top_k(df, df.where("vec_id % 3 = 0"), k=k).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_top_k_of_odd_tables(spark):
    empty = table(spark, [])
    assert va_file.top_k(empty, empty).count() == 0
    one = table(spark, [[1.0, 0.0]])
    assert va_file.top_k(one, one).count() == 0
    ties = table(spark, [[1.0, 0.0]] * 12)
    got = va_file.top_k(ties, ties.where("vec_id = 2"), k=3).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0), (2, 1), (3, 3)]


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 400)] + [(5, j) for j in range(6, 60)] + [(61, 62), (62, 63), (63, 61), (7, 7)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    rng.shuffle(edges)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = {i: 100 for i in range(100, 401)} | {j: 5 for j in range(5, 60)} | {61: 61, 62: 61, 63: 61}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# sharding


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "s") for i, t in zip(ids, texts)], "doc_id long, text string, part int, first string")


def test_matrix_has_exact_sums():
    counts = [17, 0, 5, 123, 1]
    m = sharding.communication_matrix(counts, 7)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()


def test_matrix_is_hypergeometric():
    first = [sharding.communication_matrix([6, 14], 4, seed)[0, 0] for seed in range(3000)]
    assert abs(np.mean(first) - 6 * 5 / 20) < 0.06 and abs(np.var(first) - 6 * 0.25 * 0.75 * 14 / 19) < 0.08


@pytest.mark.parametrize("n,per", [(0, 10), (1, 10), (95, 10), (400, 3)])
def test_shards_are_exact_and_gapless(spark, n, per):
    texts = [None if i % 9 == 0 else "é" * (i % 5) for i in range(n)]
    got = sharding.shard_rows(documents(spark, texts), shards=8, rows_per_partition=per).toPandas()
    assert sorted(got["doc_id"]) == list(range(n))
    sizes = got.groupby("shard")["slot"].agg(list) if n else []
    assert all(sorted(s) == list(range(len(s))) for s in sizes)
    counts = np.bincount(got["shard"].astype(int), minlength=8)
    assert counts.max() - counts.min() <= 1
    for r in got.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)


def test_shards_of_repeated_ids(spark):
    got = sharding.shard_rows(documents(spark, ["a"] * 40, [None] * 10 + [3] * 30), shards=4, rows_per_partition=5).toPandas()
    assert len(got) == 40 and got.groupby("shard").size().tolist() == [10] * 4


# learned


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    good = [words(rng, "abcdefgh", rng.randrange(5, 80)) + "." for _ in range(150)]
    bad = ["$$$ ".join(words(rng, "abcdefgh", 30).split()) if k % 2 else "spam " * rng.randrange(10, 60) for k in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, letters double")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(len(texts))] + [(0, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, labels, ~quality.held_out(3, 1))
    assert 0 < len(model.rules) <= quality.RULES
    got = quality.score_quality(df, model).where(quality.held_out(3, 1)).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "a b", 0.0), (2, "x" * 100_000, 0.0)], "doc_id long, text string, letters double")
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd, model).collect())
    assert quality.keep_quality(odd, model, least=0.0).columns == odd.columns


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(df, none, F.lit(True))
    assert abs(quality.score_quality(df, model).first()["score"] - 0.5) < 1e-9


def test_rules_as_columns_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.random((300, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality.RuleEnsemble.fit(x, y)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "i long, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = np.array([r["s"] for r in df.orderBy("i").select(model.score().alias("s")).collect()])
    want = model.intercept + sum(w * quality.holds(r, x) for r, w in zip(model.rules, model.weights))
    assert np.allclose(got, 1 / (1 + np.exp(-want))) and np.mean((got >= 0.5) == (y > 0)) > 0.95


def test_forward_backward_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(7)
    e, a, p = rng.random((1, 4, 3)), rng.random((3, 3)), rng.random(3)
    weight = lambda s: p[s[0]] * e[0, 0, s[0]] * np.prod([a[s[t - 1], s[t]] * e[0, t, s[t]] for t in range(1, 4)])
    every = list(product(range(3), repeat=4))
    total = sum(map(weight, every))
    gamma, pairs = langid.forward_backward(e, np.array([4]), a, p)
    for t in range(4):
        for k in range(3):
            assert np.isclose(gamma[0, t, k], sum(weight(s) for s in every if s[t] == k) / total)
    assert np.isclose(pairs[0, 1], sum(weight(s) * sum((s[t], s[t + 1]) == (0, 1) for t in range(3)) for s in every) / total)


def test_short_chains_in_a_padded_batch():
    rng = np.random.default_rng(8)
    e, a, p = rng.random((2, 5, 3)), rng.random((3, 3)), rng.random(3)
    both, _ = langid.forward_backward(e, np.array([5, 2]), a, p)
    one, _ = langid.forward_backward(e[1:, :2], np.array([2]), a, p)
    assert np.allclose(both[1, :2], one[0])


def test_language_of_plain_and_switched_texts(spark):
    rng = random.Random(9)
    alphabets = {"aa": "abcdeé", "bb": "cdefghß", "cc": "ghijklñ"}
    rows = [(i, words(rng, alphabets[lang], rng.randrange(5, 60)), lang) for i in range(240) for lang in [rng.choice(list(alphabets))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language(df, ~quality.held_out(5, 0))
    got = {r["doc_id"]: r for r in langid.predict_language(df, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.9
    mixed = words(rng, alphabets["aa"], 40) + " " + words(rng, alphabets["cc"], 15)
    assert model.predict([mixed, None, "", "123 !!", "é" * 20000])[:4] == [model.predict([mixed])[0], ("und", 0.0), ("und", 0.0), ("und", 0.0)]
    assert model.predict([mixed])[0][0] == "aa" and model.predict([mixed])[0][1] < 0.95
    switch = np.exp(model.transitions)
    assert (np.diag(switch) > switch.sum(axis=1) / 2 - 1e-9).all()
    assert langid.keep_language(df.withColumn("score", F.lit("x")), model).columns == [*df.columns, "score"]
    assert langid.predict_language(df.limit(0), model).count() == 0

"""Near copies among rows whose ids are repeated or null."""

import random

import numpy as np

import corpus_pipeline
from wavetide.llm import ngram_join


def test_one_row_stays_of_each_group(spark, tmp_path):
    rng = random.Random(5)
    a, b, c, d, e, f = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)) for _ in range(6))
    rows = [
        (3, a), (3, a), (3, a),  # one id, one text
        (None, b), (None, b), (7, b + " end"),  # a null id is the largest
        (None, c), (None, c),
        (5, d), (5, e), (9, e + " end"), (4, d + " end"),  # one id, two texts, each with a copy
        (6, f), (None, None), (None, ""), (6, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_copies(spark, df, str(tmp_path))
    assert got.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(3, a), (7, b + " end"), (None, c), (5, e), (4, d + " end"), (6, f), (None, None), (None, ""), (6, None)]
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


def test_an_id_has_the_links_of_all_its_rows(spark):
    words = [f"w{k}" for k in range(80)]
    a, b = " ".join(words[:60]), " ".join(words[:61])
    rows = [(1, a), (2, b), (2, " ".join(words[70:79])), (None, a), (3, " ".join(words[70:79])), (4, None)]
    want = sorted([("1", 57, "1"), ("2", 58, "1"), ("2", 6, "1"), ("3", 6, "1"), ("4", 0, "4"), ("None", 57, "None")])
    for one in (rows, rows[::-1], [rows[2], rows[1], rows[0], *rows[3:]]):
        df = spark.createDataFrame(one, "doc_id long, text string").coalesce(1)
        got = ngram_join.jaccard_components(df).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_unrelated_short_sets_share_no_cells():
    rng = np.random.default_rng(3)
    t = ngram_join.Threshold(85, 100)
    for n in (1, 2, 6, 7, 12, 25, 60):
        named = np.concatenate([np.unique(t.cells(np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)))) for _ in range(2000)])
        assert len(np.unique(named)) == len(named)


def test_linked_small_sets_share_a_cell():
    rng = np.random.default_rng(4)
    t = ngram_join.Threshold(80, 100)
    for _ in range(20_000):
        a = rng.integers(0, 1 << 63, rng.integers(4, 30), dtype=np.uint64)
        d = rng.integers(0, 1 + len(a) // 4)
        cut = rng.integers(0, d + 1)
        b = np.concatenate([a[cut:], rng.integers(0, 1 << 63, d - cut, dtype=np.uint64)])
        if 100 * (len(a) - cut) >= 80 * (len(a) + d - cut):
            assert set(t.cells(np.sort(a)).tolist()) & set(t.cells(np.sort(b)).tolist())

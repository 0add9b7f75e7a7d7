"""The pipeline's stages on a small corpus with planted rows."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_text_operators import removed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    text = lambda n=120: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    clean = [text() for _ in range(60)]
    junk = ["$$$ ".join(text(60).split()) for _ in range(30)]
    copies = [clean[k] + " end" for k in range(5)]
    passage = text(30)
    share = [text(60) + " " + passage + " " + text(60) for _ in range(4)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate([*clean, *junk, *copies, *share, "123 456", None])]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(not 60 <= i < 90), 0) for i in range(100) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, ids = dict(corpus_pipeline.STAGES), lambda d: sorted(r["doc_id"] for r in d.collect())
    a = stages["quality"](spark, docs, folder)
    assert a.columns == docs.columns and not set(ids(a)) & set(range(60, 90)) and set(range(60)) <= set(ids(a))
    b = stages["language"](spark, a, folder)
    assert b.columns == docs.columns and 99 not in ids(b) and 100 not in ids(b) and set(range(60)) <= set(ids(b))
    c = stages["near_copies"](spark, b, folder)
    assert set(ids(c)) == set(ids(b)) - set(range(90, 95)) and c.columns == docs.columns
    d = stages["repeats"](spark, c, folder)
    rows = sorted(c.collect(), key=lambda r: r["doc_id"])
    want = {r["doc_id"]: kept.decode("utf-8", "ignore") for r, (kept, _) in zip(rows, removed([r["text"] for r in rows], 50))}
    assert {r["doc_id"]: r["text"] for r in d.collect()} == want and d.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in d.collect())
    e = corpus_pipeline.STAGES[-1][1](spark, d, folder).toPandas()
    assert set(e["doc_id"]) == set(ids(d))


def test_empty_tables_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 60

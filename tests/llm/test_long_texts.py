"""Texts of several megabytes, one without any place to split, through the registered queries and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_phrases_and_runs import plain_op12, plain_phrases
from wavetide.llm import bpe, registry

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 9))) for _ in range(4000)]
LONG = " ".join(RNG.choice(WORDS) + RNG.choice(["", "", "", ",", "."]) for _ in range(500_000))
NEAR = LONG[: len(LONG) - 60_000]
UNSPLIT = "".join(RNG.choice("abcdefgh") for _ in range(1_000_000))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(0, LONG, "aa"), (1, NEAR, "aa"), (2, UNSPLIT, "bb"), (3, "a short text of words. " * 3, "aa"), (4, "z " * 700_000, None)]
    rows += [(10 + k, " ".join(RNG.choice(WORDS) for _ in range(60)) + ".", ("aa", "bb")[k % 2]) for k in range(40)]
    docs = [(i, t, lang, "s", len(t)) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(LONG[2_000_000:].split()[1:30])), (2, "short text of words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    turns = [(1, 0, "user", LONG), (1, 1, "assistant", NEAR + "</s>"), (2, 0, "user", "hi"), (2, 1, "assistant", UNSPLIT)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_sizes():
    assert len(LONG) > 2_900_000


def test_codec_joins_halves_of_an_unsplit_text(spark, folder):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in registry.queries()["op4_bpe_codec"](spark, folder).collect()}
    for i, text in ((0, LONG), (2, UNSPLIT)):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == bpe.digest(np.array(ids), text)


def test_near_copies_of_long_texts_are_linked(spark, folder):
    got = {r.doc_id: r for r in registry.queries()["op10_ngram_jaccard"](spark, folder).collect()}
    words = LONG.split()
    assert got[0].n_shingles == len({tuple(words[k : k + 4]) for k in range(len(words) - 3)})
    assert got[1].component_id == 0 and got[2].component_id == 2 and got[4].n_shingles == 1


def test_long_conversations(spark, folder):
    got = {r.conv_id: r for r in registry.queries()["op3_chat_format"](spark, folder).collect()}
    assert got[1].loss_sha256 == sha(NEAR + "</s>") and got[1].turns_sha256 == sha(f"user\n{LONG}\nassistant\n{NEAR}</s>\n")
    assert got[2].loss_sha256 == sha(UNSPLIT) and got[2].loss_chars == len(UNSPLIT)


def test_runs_passages_and_phrases_of_long_texts(spark, folder):
    runs = {r.doc_id: r for r in registry.queries()["op11_periodic_runs"](spark, folder).collect()}
    assert (runs[4].n_runs, runs[4].start, runs[4].length, runs[4].period) == (1, 0, 700_000, 1) and runs[4].collapsed_sha256 == sha("z")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = {r.doc_id: tuple(r) for r in registry.queries()["op12_decontamination"](spark, folder).collect()}
    assert hits[3] == plain_op12(3, rows[[r.doc_id for r in rows].index(3)].text, items) and hits[0][2] >= 28 and hits[0][5]
    counts = plain_phrases([(r.doc_id, r.text, r.lang) for r in rows])
    for r in registry.queries()["op13_collocations"](spark, folder).collect():
        c = counts[r.lang]
        assert (r.a, r.n) == (c[r.phrase], c[""])


def test_pipeline_takes_long_texts(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in got}
    assert 0 in kept and 1 not in kept
    assert sum(r.length for r in got if r.doc_id == 0) > 300_000

"""Each registered query as it is, over a planted folder: nulls, repeats, ties, a text of several MB, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_text_operators import removed
from wavetide.llm import bpe, packing, registry

LONG = 3_000_000


@pytest.fixture(scope="module")
def rows():
    """doc_id, text, lang; the good texts of a language have an even id's spelling, junk has signs."""
    rng = random.Random(21)
    letters = {"aa": "abcdeé", "bb": "cdefghß"}
    text = lambda x, n: " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    out = []
    for i in range(160):
        lang = rng.choice(list(letters))
        t = text(lang, rng.randrange(20, 80))
        out.append((i, "$$$ ".join(t.split()) if i % 4 == 1 else t + ".", lang))
    passage = text("aa", 25)
    out += [(200 + k, text("aa", 30) + passage + text("aa", 30), "aa") for k in range(3)]
    out += [(210, None, "aa"), (211, "", None), (212, "12 ² ½", "bb"), (213, out[0][1], "aa"), (214, "x", None)]
    piece = text("bb", 1500) + " "
    out.append((215, piece * (LONG // len(piece.encode()) + 1), "bb"))
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("contract"))
    made = [(i, t, lang, "s", len(t or ""), 1, "z", 2) for i, t, lang in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, n long, bucket string, part int").repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 != 1), 0) for i, _, _ in rows if i < 160] + [(0, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def ids_of(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    return {i: lib.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}


def result(spark, folder, name):
    return registry.queries()[name](spark, folder)


def kinds(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


TYPES = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_bpe_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_substring_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_quality_rules": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_language_crf": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


@pytest.mark.parametrize("name", TYPES)
def test_empty_tables_give_no_rows_of_the_same_types(spark, empty, name):
    got = result(spark, empty, name)
    assert kinds(got) == TYPES[name] and got.count() == 0


def test_op1(spark, folder, rows, ids_of):
    got = result(spark, folder, "op1_best_fit_packing").toPandas()
    pieces = 0
    for i, own in got.groupby("doc_id"):
        ids = np.array([*ids_of[i], 2], "<u4")
        own = own.sort_values("piece")
        want = packing.cut(len(ids), 1024)
        pieces += len(want)
        assert list(zip(own["start"], own["length"])) == want and own["piece"].tolist() == list(range(len(want)))
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n]) for a, n in want]
    assert len(got) == pieces and set(got["doc_id"]) == {i for i, _, _ in rows}
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 1024


def test_op4(spark, folder, rows, ids_of):
    got = {r["doc_id"]: r for r in result(spark, folder, "op4_bpe_codec").collect()}
    for i, t, _ in rows:
        ids = np.array(ids_of[i], "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(ids.tobytes())), i
        assert got[i]["decoded_sha256"] == sha((t or "").encode())
    assert len(got) == len(rows)


def test_op5(spark, folder, rows):
    got = {r["doc_id"]: r for r in result(spark, folder, "op5_substring_dedup").collect()}
    short = sorted((r for r in rows if r[0] != 215), key=lambda r: r[0])
    for (i, t, _), (kept, spans) in zip(short, removed([t for _, t, _ in short], 50)):
        n = len((t or "").encode())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (n, n - len(kept), spans, sha(kept)), i
    raw = next(t for i, t, _ in rows if i == 215).encode()
    assert (got[215]["n_bytes"], got[215]["n_removed"], got[215]["kept_sha256"]) == (len(raw), 0, sha(raw))  # repeats within a document stay


def test_op6(spark, folder, rows):
    got = {r["doc_id"]: r for r in result(spark, folder, "op6_quality_rules").collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in got if i < 160 and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 4 != 1) for i in held]) > 0.9
    assert got[0]["score"] == got[213]["score"]  # equal texts have equal scores, whatever their ids


def test_op7(spark, folder, rows):
    got = {r["doc_id"]: r for r in result(spark, folder, "op7_language_crf").collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "bb", "und")
    assert [got[i]["lang_pred"] for i in (210, 211, 212)] == ["und"] * 3 and got[215]["lang_pred"] == "bb"
    held = [(i, lang) for i, _, lang in rows if i < 160 and got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.9


def test_op8(spark, folder, rows):
    got = result(spark, folder, "op8_sharding").toPandas()
    texts = {i: (t or "").encode() for i, t, _ in rows}
    assert sorted(got["doc_id"]) == sorted(texts) and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    assert got["size"].tolist() == [len(texts[i]) + 16 for i in got["doc_id"]] and got["text_crc32"].tolist() == [zlib.crc32(texts[i]) for i in got["doc_id"]]
    counts = np.bincount(got["shard"], minlength=40)
    assert len(counts) == 40 and counts.max() - counts.min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])

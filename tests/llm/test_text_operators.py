"""Text operators against libraries, brute force and round trips, with nulls, empty texts, ties and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetide.llm import bpe, chat, ngram_join, packing, prefix_free, shingles, substring_dedup

SCHEMA = "doc_id long, text string, lang string, row int, k int, n long, part string"


def docs(spark, texts, ids=None):
    """A documents table with extra columns of clashing names."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "x") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def odd_texts(n=60, seed=1):
    rng = random.Random(seed)
    pieces = ["abcdefgh", "ab", "the an", "  \n", "'s're", "é漢字ß", "12", "😀 "]
    out = ["".join(rng.choice(rng.choice(pieces)) for _ in range(rng.randrange(1, 400))) for _ in range(n)]
    out += ["", " ", "a" * 5000, "<|endoftext|>", "x<|endoftext|>y" * 30, "word " * 3000, "\t\n" * 900]
    return [x.replace(" ", "").replace("\n", "") if k % 4 == 1 else x for k, x in enumerate(out)]


# BPE


def test_tree_concatenation_equals_the_library(lib):
    c = bpe.codec(bpe.default_path())
    for x in odd_texts():
        want = lib.encode(x, add_special_tokens=False).ids
        assert c.encode(x).tolist() == want
        for leaf, piece in ((16, 8), (100, 64)):
            assert c.encode_tree(x, leaf, piece).tolist() == want
        assert c.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_bpe_over_a_table(spark, lib):
    texts = [*odd_texts(12), None, "same", "same"]
    got = bpe.encode_tokens(docs(spark, texts), leaf_chars=64, piece_bytes=16).collect()
    want = Counter((i, np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in enumerate(texts))
    assert Counter((r["id"], bytes(r["ids"])) for r in got) == want
    assert bpe.encode_tokens(docs(spark, [])).count() == 0


# chat


def test_escapes_round_trip():
    rng = random.Random(2)
    for _ in range(500):
        x = "".join(rng.choice(["[", "\\", "INST]", "/INST]", "<", "s>", "/s>", "a", "[INST]", "</s>", "NOROLE]"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(x)) == x
        assert not chat._MARK.search(chat.escape(x))


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi [/INST]"), (1, 1, "assistant", "(yes) </s>\\ é"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 1, "tool:[ROLE]", "[TURN] 漢字"), (3, 0, "assistant", ""), (None, 0, "system", "s"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c in {r[0] for r in rows}:
        turns = [(role or "", text or "") for i, _, role, text in rows if i == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# packing


def test_local_search_packs_as_well_as_any_order():
    rng = random.Random(3)
    for _ in range(20):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))]
        bins = packing.local_search(packing.best_fit_decreasing(Counter(lengths), 100), 100)
        assert Counter(x for b, n in bins.items() for _ in range(n) for x in b) == Counter(lengths)
        assert all(sum(b) <= 100 for b in bins)
        assert -(-sum(lengths) // 100) <= sum(bins.values()) <= -(-sum(lengths) // 100) * 1.25 + 2


def test_exchanges_empty_a_bin():
    bins = packing.local_search(Counter({(6, 3): 1, (5, 4): 1, (2,): 1}), 10)
    assert sum(bins.values()) == 2


def test_packing_over_a_table(spark, lib):
    texts = ["a b c " * 700, None, "", "hello", "hello", *odd_texts(10)]
    got = packing.best_fit_pack(docs(spark, texts)).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids) and (own["length"][1:] == 1024).all()
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + n]) for s, n in zip(own["start"], own["length"])]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) + 1
    assert packing.best_fit_pack(docs(spark, [])).count() == 0


# n-gram join


def components(sets, num, den):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def word_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return out


def copies(seed, n_groups=5, size=12, words=90):
    """Groups of texts that drift from copy to copy, so that chains of links matter, and a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    shared = [word() for _ in range(12)]
    out = []
    for _ in range(n_groups):
        w = [word() for _ in range(words)]
        for _ in range(size):
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w + (shared if rng.random() < 0.5 else [])))
    rng.shuffle(out)
    return [*out, out[0].upper(), out[1], None, "", "  ", "one two", "one two", "one two three"]


def test_shingles_equal_plain_ones():
    texts = copies(4)
    for k in (4, 5):
        assert [len(s) for s in shingles.shingle_sets([(t or "").encode() for t in texts], k)] == [len(s) for s in word_sets(texts, k)]


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_similar_sets_share_a_cell_and_pass_the_bound(k, num):
    t = ngram_join.Threshold(num, 100)
    texts = copies(5) + [" ".join("abcdefgh"[: n + 1] for n in range(m)) for m in range(1, 12)]
    sets = [s for s in shingles.shingle_sets([(x or "").encode() for x in texts], k) if len(s)]
    cells = [set(t.cells(s).tolist()) for s in sets]
    points = np.array([ngram_join.count_vector(s) for s in sets])
    labels = np.arange(len(sets)) // 3
    half, other = (ngram_join.RTree(points[p], labels[p], node=4) for p in (slice(0, None, 2), slice(1, None, 2)))
    tree, overlaps = ngram_join.RTree(points, labels, node=4), ngram_join.Overlaps(sets)
    within = {frozenset(p) for a, b in ngram_join.tree_pairs(tree, tree, t) for p in zip(a.tolist(), b.tolist())}
    across = {(2 * x, 2 * y + 1) for a, b in ngram_join.tree_pairs(half, other, t) for x, y in zip(a.tolist(), b.tolist())}
    assert not any(labels[x] == labels[y] for x, y in [*map(sorted, within), *across])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            linked = 100 * both >= num * (len(a) + len(sets[j]) - both)
            assert overlaps.linked(np.array([i]), np.array([j]), t)[0] == linked
            if linked:
                assert cells[i] & cells[j] and (labels[i] == labels[j] or {i, j} in within)
                x, y = (i, j) if i % 2 == 0 else (j, i)
                assert i % 2 == j % 2 or labels[i] == labels[j] or (x, y) in across


def test_groups_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    texts = copies(9, n_groups=3, size=20)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components(word_sets(texts, 4), 85, 100)


@pytest.mark.parametrize("seed,k,num", [(6, 4, 85), (7, 5, 80), (8, 4, 85)])
def test_components_equal_brute_force(spark, seed, k, num):
    texts = copies(seed)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs(spark, texts), k=k, num=num).collect()}
    sets = word_sets(texts, k)
    want = components(sets, num, 100)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == [(len(s), c) for s, c in zip(sets, want)]


def test_join_of_odd_tables(spark):
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    got = ngram_join.jaccard_components(docs(spark, ["a b c d e", "a b c d e", "x"], [None, 3, 3])).collect()
    assert len(got) == 3 and {r["component_id"] for r in got} == {None, 3}


# substrings


def removed(texts, length):
    seen, out = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        windows = [b[k : k + length] for k in range(len(b) - length + 1)]
        for k, w in enumerate(windows):
            if seen.get(w, i) < i:
                gone[k : k + length] = b"\1" * length
        for w in windows:
            seen.setdefault(w, i)
        out.append((bytes(c for c, g in zip(b, gone) if not g), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))))
    return out


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 50), (3, 20), (4, 7)])
def test_removed_bytes_equal_brute_force(spark, seed, length):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(20, 120))) for _ in range(6)]
    texts = ["".join(rng.choice([*passages, "".join(rng.choice("abcdefgh \n") for _ in range(60)), "aa" * 40]) for _ in range(rng.randrange(1, 8))) for _ in range(30)]
    texts += [texts[0], texts[0], None, "", "a" * 3000, "a" * 2500 + "b", "xy" * 700]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, texts), length=length).collect()}
    for i, (kept, spans) in enumerate(removed(texts, length)):
        assert bytes(got[i]["kept"]) == kept and len(got[i]["spans"]) == spans and got[i]["n_bytes"] == len((texts[i] or "").encode())


def test_repeated_and_null_ids_keep_their_bytes(spark):
    x, y = "abc def ghi " * 20, "q" * 10 + "abc def ghi " * 10
    got = substring_dedup.remove_repeats(docs(spark, [x, y, x], [5, 5, None])).collect()
    assert all(len(r["kept"]) == r["n_bytes"] for r in got) and len(got) == 3
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_a_bucket_sends_a_home_one_row_of_a_kind(spark, monkeypatch):
    rng, n, seen = random.Random(8), 24, []
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(300)]
    texts += [t[:1000] + "#" + t[1000:] for t in texts]  # copies in other partitions, with borders
    kept = substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda df: seen.append(kept(df)) or seen[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = substring_dedup.remove_repeats(docs(spark, texts).repartitionByRange(n, "doc_id"))
        got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == dict(enumerate(removed(texts, 50)))
    buckets = max(32, n, sum(map(len, texts)) // substring_dedup.BUCKET)
    rows = {r["kind"]: r["count"] for r in seen[0].groupBy("kind").count().collect()}
    assert 0 < rows[substring_dedup.OPEN] <= buckets**2 and 0 < rows[substring_dedup.REMOVED] <= buckets**2 + buckets


def test_a_task_with_many_buckets_gathers_phrases_before_it_sends(spark):
    rng = np.random.default_rng(9)
    texts = [rng.integers(97, 123, 500_000, dtype=np.uint8).tobytes().decode() for _ in range(12)]
    rows = docs(spark, texts).select("doc_id", "text").coalesce(1)
    assert sum(map(len, texts)) > 2 * substring_dedup.CHUNK
    got = substring_dedup._entries(rows, 50, 24, 4000, 1).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert got["rows"] <= 4000 and got["n"] == sum(len(substring_dedup.parse([t.encode()])[0]) for t in texts)


@pytest.mark.parametrize("length", [3, 10, 50])
def test_dictionary_and_parse_give_the_order_of_all_suffixes(length):
    rng = np.random.default_rng(length)
    for _ in range(60):
        parts = [rng.integers(0, 256 if rng.random() < 0.3 else 3, rng.integers(1, 90), dtype=np.uint8) for _ in range(4)]
        texts = [np.concatenate([parts[k] for k in rng.integers(0, 4, rng.integers(1, 12))]) for _ in range(rng.integers(1, 8))]
        texts = [t for t in texts if len(t) >= length]
        if not texts:
            continue
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        data = np.concatenate(texts)
        at = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(starts, ends)])
        order, differs = prefix_free.corpus_order(data, starts, ends, at, length)
        rows = [bytes(data[p : p + length]) for p in at[order]]
        assert rows == sorted(rows) and differs.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(len(rows))]
        begin, end, of = prefix_free.phrases(data, starts, ends)
        for k, t in enumerate(texts):  # phrases without what they share with the next one are the text
            a, b = begin[of == k], end[of == k]
            assert a[0] == starts[k] and b[-1] == ends[k] and (b[:-1] - prefix_free.WINDOW == a[1:]).all()
        kinds = {bytes(data[x:y]) for x, y, last in zip(begin, end, np.append(of[1:] != of[:-1], True)) if not last}
        rests = {x[i:] for x in kinds for i in range(len(x) - prefix_free.WINDOW)}
        assert not any(x != y and y.startswith(x) for x in list(rests)[:80] for y in rests)

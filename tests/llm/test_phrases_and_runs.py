"""Periodic runs, benchmark passages and collocations against brute force, at their borders and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetide.llm import collocations, contamination, periodic, registry

DOCS = "doc_id long, text string, lang string, n int, row string, words string, phrase string, bucket int"
ODD = [None, "", "  \t\n", "x", "a " * 400, "a b " * 90 + "c " + "a b c " * 40, "Ünï a\u0085b " * 30, "x" * 5000 + " " + "x" * 5000]


def rows_of(texts):
    return [(i if i != 3 else None, t, (None, "und", "en", "fr")[i % 4], 1, "r", "w", "p", 2) for i, t in enumerate(texts)] + [(1, "b a b a b a b a b", "en", 1, "r", "w", "p", 2)] * 2


def save(spark, path, texts, items=()):
    spark.createDataFrame(rows_of(texts), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string, words int, item int").write.parquet(f"{path}/benchmark.parquet")
    return path


# periodic runs


def plain_runs(words, least=6, exponent=4):
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - start
            part = words[start:i]
            if length >= max(least, exponent * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 3), (20, 3), (9, 5)])
def test_runs_equal_all_lags(least, exponent):
    rng = random.Random(least)
    for _ in range(300):
        words, letters = [], "abc"[: rng.randrange(1, 4)]
        while len(words) < rng.randrange(1, 150):
            words += [rng.choice(letters) for _ in range(rng.randrange(1, 9))] * rng.choice([1, 1, 2, 3, 5, 9])
        raw = " ".join(words).encode()
        got = periodic.find_runs(periodic.word_numbers(raw), least, exponent)
        assert list(zip(*(x.tolist() for x in got))) == plain_runs(words, least, exponent)


def test_runs_of_a_long_text_take_steps_in_proportion(monkeypatch):
    words = np.zeros(400_000, np.int64)  # one word: every earlier occurrence would be 8e10 pairs
    assert [x.tolist() for x in periodic.find_runs(words)] == [[0], [400_000], [1]]
    monkeypatch.setattr(periodic, "SLICE", 7)
    assert periodic.word_numbers(b"ab  cd ab\n efghijklmno ab").tolist() == [0, 1, 0, 2, 0]


def plain_op11(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    got = registry.queries()["op11_periodic_runs"](spark, save(spark, str(tmp_path), texts))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_op11(i, t)) for i, t, *_ in rows_of(texts))


# benchmark passages

ITEMS = [(5, "One two three four, FIVE six seven eight nine ten eleven."), (40, "k l m"), (6, "one two three four five six seven eight nine ten"), (7, None), (8, " .;"), (None, "z z"), (40, "k l m"), (9, "é ü"), (300, "m k")]


def plain_op12(doc_id, text, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = low(text), set(), set()
    for item, t in items:
        w = low(t)
        for x in [w[i : i + 10] for i in range(max(1, len(w) - 9))] if w else []:
            for i in range(len(words) - len(x) + 1):
                if words[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found |= {item} - {None}
    return doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


PASSAGES = ["x k l m k z z z", "a one TWO three-four five six seven eight nine ten eleven b", "two three four five six seven eight nine ten", "é ü k l m k l m", "K\nL\tM", "k l", "ké ü"]


@pytest.mark.parametrize("rows", [100_000, 2])
def test_op12_on_odd_rows(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(contamination, "ROWS", rows)  # with 2, several automata scan
    texts = ODD + PASSAGES
    folder = save(spark, str(tmp_path), texts, [(*x, 1, 2) for x in ITEMS])
    got = registry.queries()["op12_decontamination"](spark, folder)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_op12(i, t, ITEMS)) for i, t, *_ in rows_of(texts))


def test_spans_count_characters_of_the_original(spark):
    docs = spark.createDataFrame([(1, "Éé; K, l — M!  k l m")], "doc_id long, text string")
    items = spark.createDataFrame([("b", "k l m"), ("a", "M k")], "item_id string, text string")
    (row,) = contamination.find_contamination(docs, items).collect()
    assert [tuple(s) for s in row.spans] == [(4, 4, 11, 20)]  # the dash is a word
    assert docs.first().text[11:20] == "M!  k l m" and row["items"] == ["a", "b"]


def test_slices_of_a_long_text_go_on(monkeypatch):
    import pickle

    known, auto = contamination._automaton(pickle.dumps([(1, [b"a", b"b", b"c"])]))
    raw = b"x a b c y a b c " * 20
    whole = contamination.scan(raw, known, auto)
    monkeypatch.setattr(contamination, "SLICE", 3)
    assert contamination.scan(raw, known, auto) == whole and len(whole[1]) == 40


# collocations


def plain_phrases(rows, longest=3):
    counts = {}
    for _, text, lang, *_ in rows:
        c = counts.setdefault(lang or "und", Counter())
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            c[""] += len(words)
            c.update(" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return counts


def plain_op13(rows, least=10, top=2000):
    out = []
    for lang, c in plain_phrases(rows).items():
        held = []
        candidates = {p: f for p, f in c.items() if p.count(" ") and f >= least}
        inner = {}
        for p, f in candidates.items():
            w = p.split(" ")
            for part in [" ".join(w[:-1]), " ".join(w[1:])]:
                inner[part] = max(inner.get(part, 0), f)
        for p, a in candidates.items():
            w = p.split(" ")
            cuts = [(1000000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if 100 * inner.get(p, 0) < 50 * a:
                held.append((-score, -a, p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        out += [(lang, r, p.decode(), -a, x, y, c[""], -s) for r, (s, a, p, x, y) in enumerate(sorted(held)[:top], 1)]
    return out


def test_order_and_counts_of_an_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        most = int(rng.integers(1, 5))
        text = np.concatenate([[0], rng.integers(0, most + 1, rng.integers(1, 60)), [0]]).astype(np.int32)
        ends = [next(j for j in range(i, len(text)) if text[j] == 0) for i in range(len(text))]
        assert collocations.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: (text[i : ends[i] + 1].tolist(), i))
        want = Counter(w for k in range(1, 5) for i in range(len(text) - k + 1) if 0 not in (w := tuple(text[i : i + k].tolist())))
        found = [(tuple(map(int, w)), int(n)) for columns, count in collocations.phrases(text, most, 4) for *w, n in zip(*columns, count)]
        assert dict(found) == want and len(found) == len(want)


@pytest.mark.parametrize("shard, piece", [(1 << 21, 1 << 20), (40, 9)])
def test_op13_on_odd_rows(spark, tmp_path, monkeypatch, shard, piece):
    monkeypatch.setattr(collocations, "SHARD", shard)  # with 40, pieces go on in a second shard
    monkeypatch.setattr(collocations, "SLICE", piece)
    monkeypatch.setattr(collocations, "BUCKET", 500)
    rng = random.Random(8)
    texts = ODD + [" ".join(rng.choice(["A", "b", "c.", "d,e", "é", "f;", "\x00", "g\tg"]) for _ in range(rng.randrange(1, 120))) for _ in range(80)]
    texts.append("no end at all " * 300)
    got = registry.queries()["op13_collocations"](spark, save(spark, str(tmp_path), texts))
    assert sorted(map(tuple, got.collect())) == sorted(plain_op13(rows_of(texts)))


def test_longer_phrases(spark):
    rows = [(1, "a b c d e f " * 12, None), (2, "a b. c d e f", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.lang, r.phrase): r.f for r in collocations.frequent_phrases(docs, longest=5, least=3).collect()}
    assert got == {(x, p): f for x, c in plain_phrases(rows, 5).items() for p, f in c.items() if f >= 3 or not p}


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_decontamination", "op13_collocations"])
def test_empty_tables(spark, tmp_path, name):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert registry.queries()[name](spark, folder).collect() == []

"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a label. A word's features are its affixes, n-grams and the word itself (the lexicon), hashed
into one table of weights; labels of neighbouring words share learned transitions, so a run of words in one language
keeps its label and code-switched text changes it where the words do. Forward-backward gives each word's posterior, and
a text's language is the one with the largest mean posterior over all its words.

The fit uses at most ``SAMPLE`` documents of each language, chosen by a hash of the id, and learns from ``SEGMENTS`` runs
of at most ``SEGMENT`` words of each, spliced into ``CHAINS`` code-switched chains (documented bounds of the fit alone).
Prediction reads every word of every text, and a text is one chain: its parts of ``PART`` words are multiplied out side
by side, their products carry the forward and backward vectors from part to part, and so each word's posterior is that
of the whole chain. A word is a run of letters.

Defined results: null text and text without letters give ``und`` and score 0; without any labelled text so does every
row; a null or repeated id is a row like any other when predicting; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, table
from .quality import held_out
from .shingles import mix

#: Documents of a language in the fit at most; segments of a document and their words.
SAMPLE, SEGMENTS, SEGMENT = 800, 6, 12
#: Documents of all languages together, and languages, at most.
TOTAL, LANGUAGES = 25_600, 256
#: Parts of a language that are cut to SAMPLE on their own first.
SALTS = 16
#: Rows of the weight table, words of a chain's part at inference, words of a chain in the fit, and chains of the fit.
ROWS, PART, FIT_CHAIN, CHAINS = 1 << 16, 64, 24, 4000
CHUNK = 1 << 18
#: Words whose features are made at once, and words whose scores are kept.
SLICE, KEPT = 8192, 100_000
_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
GRAMS = (2, 3, 4)
AFFIXES = (1, 2, 3, 4)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]  # digits like ² aren't letters


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for each word's features, and where each word's begin."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(raw)), size)
    at = np.arange(len(buf)) - start[of]
    left = size[of] - at
    rows, owner = [], []

    def add(keys: np.ndarray, who: np.ndarray, kind: int) -> None:
        rows.append((mix(keys * np.uint64(64) + np.uint64(kind)) % np.uint64(ROWS)).astype(np.int64))
        owner.append(who)

    rolled = buf.copy()
    sums = np.cumsum(mix(buf * _MULTIPLY + at.astype(np.uint64)))
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    add(sums[start + size - 1] - before, np.arange(len(raw)), 0)  # the lexicon
    for k in range(2, max(*GRAMS, max(AFFIXES) + 1) + 1):
        rolled = rolled[:-1] * np.uint64(257) + buf[k - 1 :] if len(rolled) > 1 else rolled[:0]
        whole = left[: len(rolled)] >= k
        if k in GRAMS:
            add(rolled[whole], of[: len(rolled)][whole], k)
        if k - 1 in AFFIXES:  # an affix holds the mark of its end of the word
            first = whole & (at[: len(rolled)] == 0)
            last = whole & (left[: len(rolled)] == k)
            add(rolled[first], of[: len(rolled)][first], 10 + k)
            add(rolled[last], of[: len(rolled)][last], 20 + k)
    owner_all, rows_all = np.concatenate(owner), np.concatenate(rows)
    order = np.argsort(owner_all, kind="stable")
    begin = np.searchsorted(owner_all[order], np.arange(len(raw)))
    return rows_all[order], begin


class Crf:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, first: np.ndarray):
        self.labels, self.weights, self.transitions, self.first = labels, weights, transitions, first
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(labels)))

    def __getstate__(self):
        return self.labels, self.weights, self.transitions, self.first

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word's labels; scores of words seen before are kept, up to a number."""
        if len(self.known) > KEPT:
            self.known, self.scores = {}, self.scores[:0]
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        made = [self.scores]
        for lo in range(0, len(new), SLICE):
            rows, begin = word_features(new[lo : lo + SLICE])
            made.append(np.add.reduceat(self.weights[rows], begin, axis=0))
        self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
        self.scores = np.concatenate(made)
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def posteriors(self, emissions: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Forward-backward over padded parts of chains: emissions (parts, words, labels); number: a part's place in its
        chain, whose parts follow one another."""
        e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
        trans, first = np.exp(self.transitions), np.exp(self.first)
        start, end = np.broadcast_to(first, (len(e), len(first))).copy(), np.ones((len(e), len(first)))
        size = np.diff(np.append(np.flatnonzero(number == 0), len(number)))
        if size.max(initial=0) > 1:
            several = np.repeat(size, size) > 1
            product = np.empty((len(e), *trans.shape))
            product[several] = products(e[several], lengths[several], trans)
            last = number + 1 == np.repeat(size, size)
            for k in range(1, int(size.max())):
                at = np.flatnonzero(number == k)
                r = np.einsum("nk,nkj->nj", start[at - 1], product[at - 1]) @ trans
                start[at] = r / r.sum(axis=1, keepdims=True)
            for k in range(int(size.max()) - 2, -1, -1):
                at = np.flatnonzero((number == k) & ~last)
                b = np.einsum("nkj,nj->nk", product[at + 1], end[at + 1]) @ trans.T
                end[at] = b / b.sum(axis=1, keepdims=True)
        return forward_backward(e, lengths, trans, start, end, pairs=False)[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words, counts = [], []
        for t in texts:
            own = words_of(t) if t else []
            words += own
            counts.append(len(own))
        out = [("und", 0.0)] * len(texts)
        if not words or not self.labels:
            return out
        e = self.emissions(words)
        n = np.array(counts)
        chains = -(-n // PART)
        text_of = np.repeat(np.arange(len(n)), chains)
        number = np.arange(len(text_of)) - np.repeat(np.cumsum(chains) - chains, chains)
        begin = (np.cumsum(n) - n)[text_of] + number * PART
        length = np.minimum(PART, n[text_of] - number * PART)
        padded = np.zeros((len(begin), PART, e.shape[1]))
        inside = np.arange(PART) < length[:, None]
        padded[inside] = e
        total = np.zeros((len(n), e.shape[1]))
        np.add.at(total, text_of, (self.posteriors(padded, length, number) * inside[:, :, None]).sum(axis=1))
        for k in np.flatnonzero(n):
            mean = total[k] / n[k]
            best = int(np.argmax(mean))
            out[k] = (self.labels[best], float(min(1.0, mean[best])))
        return out


def products(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """For each part the product over its words, up to a factor: what comes in front of its first word's scores, times
    this, is the forward vector at its last word."""
    n, t, k = e.shape
    out = np.eye(k) * e[:, :1]
    for i in range(1, t):
        step = (out.reshape(-1, k) @ trans).reshape(n, k, k) * e[:, i, None, :]
        out = step if lengths.min() > i else np.where((lengths > i)[:, None, None], step, out)
        if i % 16 == 0:
            out /= out.max(axis=(1, 2), keepdims=True)
    return out / out.max(axis=(1, 2), keepdims=True)


def forward_backward(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray | float = 1.0, pairs: bool = True):
    """Posteriors of labels (chains, words, labels), and expected transitions summed over chains (if pairs). first, last:
    weights of labels before the first and behind the last word, of each chain or of all."""
    n, t, k = e.shape
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    beta[:, -1] = last
    a = e[:, 0] * first
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ trans) * e[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        on = (lengths > i + 1)[:, None]
        b = (e[:, i + 1] * beta[:, i + 1]) @ trans.T
        beta[:, i] = np.where(on, b / b.sum(axis=1, keepdims=True), last)
        if not pairs:
            continue
        both = alpha[:, i, :, None] * trans * (e[:, i + 1] * beta[:, i + 1])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        expected += (both * on[:, :, None]).sum(axis=0)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=2, keepdims=True), expected


def fit_crf(segments: list[tuple[str, list[str]]], epochs: int = 6, chains: int = CHAINS, seed: int = 9) -> Crf:
    """segments: (label, words). Chains splice segments of random documents, so labels change inside them."""
    labels = sorted({x for x, w in segments if w})
    k = len(labels)
    model = Crf(labels, np.zeros((ROWS, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    rng, by = np.random.default_rng(seed), {x: [w for y, w in segments if y == x and w] for x in labels}
    words, gold = [], []
    for _ in range(chains):
        chain, marks = [], []
        while len(chain) < FIT_CHAIN:
            x = int(rng.integers(k))
            s = by[labels[x]][int(rng.integers(len(by[labels[x]])))]
            chain += s
            marks += [x] * len(s)
        words.append(chain[:FIT_CHAIN])
        gold.append(marks[:FIT_CHAIN])
    gold = np.array(gold)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(w for c in words for w in c))}
    rows, begin = word_features(list(distinct))
    ends = np.append(begin[1:], len(rows))
    index = np.array([[distinct[w] for w in c] for c in words])
    power = [np.full_like(p, 1e-6) for p in (model.weights, model.transitions, model.first)]
    for _ in range(epochs):
        order = rng.permutation(chains)
        for part in np.array_split(order, max(1, chains // 200)):
            ids, inverse = np.unique(index[part], return_inverse=True)
            own = np.concatenate([rows[begin[i] : ends[i]] for i in ids])
            count = ends[ids] - begin[ids]
            at = np.cumsum(count) - count
            e = np.add.reduceat(model.weights[own], at, axis=0)[inverse.reshape(index[part].shape)]
            e = np.exp(e - e.max(axis=2, keepdims=True))
            gamma, pairs = forward_backward(e, np.full(len(part), FIT_CHAIN), np.exp(model.transitions), np.exp(model.first))
            y = gold[part]
            wrong = np.eye(k)[y] - gamma
            by_word = np.zeros((len(ids), k))
            np.add.at(by_word, inverse.reshape(-1), wrong.reshape(-1, k))
            g = np.stack([np.bincount(own, weights=np.repeat(by_word[:, c], count), minlength=ROWS) for c in range(k)], axis=1)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            steps = (g, seen - pairs, wrong[:, 0].sum(axis=0))
            for p, s, h in zip((model.weights, model.transitions, model.first), steps, power):
                s = s / len(part)
                h += s * s
                p += 0.2 * s / np.sqrt(h)
    model.weights = model.weights.astype(np.float32)
    return model


def fit_language(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = LANGUAGES) -> Crf:
    """train: a condition on doc_id for the rows whose languages may be used; the `most` languages with most of these rows
    are learned, from TOTAL documents in all and SAMPLE of each at most."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.where("doc_id is not null and lang is not null and text is not null").where(train)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()  # most rows
    sample = max(1, min(SAMPLE, TOTAL // max(1, len(counts))))
    known = known.where(F.col("lang").isin([r["lang"] for r in counts]))
    # first within salted parts of a language, so that no task gathers a frequent one; the order is the same in both steps
    order = [F.col("by"), F.col("doc_id")]
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(6)).alias("by"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)).alias("salt"))
    first = ids.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= sample)
    chosen = first.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("nth") <= sample).select("doc_id", "lang")
    sampled = known.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).select("doc_id", "lang", "text")  # sample ids a language, TOTAL in all

    @released
    def segments(batches):
        for b in batches:
            ids, langs, out = [], [], []
            for i, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(text)
                if not words:
                    continue
                rng = np.random.default_rng(abs(i))
                for at in rng.integers(0, max(1, len(words) - SEGMENT + 1), SEGMENTS).tolist():
                    ids.append(i)
                    langs.append(lang)
                    out.append(words[at : at + int(rng.integers(3, SEGMENT + 1))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.string()))], ["doc_id", "lang", "words"])

    got = sampled.mapInArrow(segments, "doc_id long, lang string, words array<string>").collect()
    return fit_crf([(r["lang"], list(r["words"])) for r in sorted(got, key=lambda r: (r["doc_id"], r["lang"], r["words"]))])


def predict_language(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    return _predicted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)


def keep_language(docs: DataFrame, model: Crf, text_col: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of docs, with all their columns, that have letters and a language whose score reaches least."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    return _predicted(rows, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def _predicted(docs: DataFrame, model: Crf) -> DataFrame:
    """docs: a key and a text. The key, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # one table of ROWS x languages

    @released
    def run(batches):
        crf = held.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= CHUNK):
                    size += len(texts[hi] or "")
                    hi += 1
                got = crf.predict(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [key, "lang_pred", "score"])
                lo = hi

    key = docs.columns[0]
    return docs.mapInArrow(run, docs.select(key).schema.add("lang_pred", "string").add("score", "double"))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs, ~held_out(5, 0))
    out = predict_language(docs, model)
    return out.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score")

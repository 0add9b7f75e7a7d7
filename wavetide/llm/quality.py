"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark columns.

Statistics of whole texts (shares of kinds of characters, word lengths, repetition of words and lines) are made in one
pass. Shallow trees are fitted to the labels by boosting on random subsets; each path from a root to a node is a
conjunctive rule; lasso logistic regression gives most rules no weight. What is left becomes a Column expression.

The fit uses at most ``SAMPLE`` labelled rows, chosen by a hash of the id (a documented bound); scoring covers all rows.
Rows held out by the caller's condition never reach the fit, and no column but the text is an input.

Defined results: null text is empty and gets a score like any text; a null id has no label and is scored; repeated
labels of an id count once, by their largest value; null labels are ignored; without labels of both kinds the score is
the share of label 1 (0.5 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table

#: Labelled rows in the fit at most.
SAMPLE = 12_000
#: Trees, their depth, distinct rules offered to the lasso, and rules with a weight at most.
TREES, DEPTH, OFFERED, RULES = 60, 3, 200, 64
_LONG = "double"

STATISTICS = (
    "log_bytes", "letters", "upper", "digits", "symbols", "spaces", "line_feeds", "non_ascii", "pipes", "exclaims", "stops",
    "commas", "symbol_pairs", "word_bytes", "words_per_line", "distinct_words", "top_word", "repeated_neighbours", "distinct_lines",
    "long_words", "upper_words", "symbol_words",
)

_KIND = np.zeros((256, 9), dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [_b < 128 and _c.isalpha(), 65 <= _b <= 90, 48 <= _b <= 57, _b < 128 and not _c.isalnum() and not _c.isspace(), _b == 32, _b == 10, _b >= 128, _c == "|", _c == "!"]
_SYMBOL = _KIND[:, 3].astype(bool)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One line of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in zip(out, texts):
        if not text:
            continue
        b = np.frombuffer(text, np.uint8)
        n = len(b)
        counts = np.bincount(b, minlength=256)
        kinds = counts @ _KIND
        symbol = _SYMBOL[b]
        words, lines = text.split(), text.split(b"\n")
        k = max(1, len(words))
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        row[:] = (
            np.log1p(n), *(kinds[:9] / n), counts[46] / n, counts[44] / n,
            np.count_nonzero(symbol[1:] & (b[1:] == b[:-1])) / n,
            (n - kinds[4] - kinds[5]) / k, k / len(lines), len(seen) / k, max(seen.values(), default=0) / k,
            sum(map(bytes.__eq__, words, words[1:])) / k, len(set(lines)) / len(lines),
            sum(len(w) > 12 for w in words) / k, sum(map(bytes.isupper, words)) / k, np.count_nonzero(symbol[:-1] & (b[1:] <= 32)) / k,
        )
    return out


def _with_statistics(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows (text last) with a column for each statistic instead of the text."""

    @released
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                x = statistics([(t or "").encode() for t in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x[:, k]) for k in range(x.shape[1]))], [*keep, *STATISTICS])

    schema = rows.select(*keep).schema
    for s in STATISTICS:
        schema = schema.add(s, _LONG)
    return rows.mapInArrow(run, schema)


# the rule ensemble


def _tree(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, features: np.ndarray, depth: int, rule: tuple) -> Iterator[tuple]:
    """Rules (tuples of (feature, is_above, threshold)) of the nodes below the root; leaves' steps are in the last pair."""
    best, gain = None, 1e-9
    g, h = residual.sum(), weight.sum() + 1.0
    if depth and len(x) >= 20:
        for f in features:
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut >= 4) & (cut < len(v) - 5)]
            if not len(cut):
                continue
            gl, hl = np.cumsum(residual[order])[cut], np.cumsum(weight[order])[cut] + 1.0
            won = gl**2 / hl + (g - gl) ** 2 / (h - hl + 2.0) - g**2 / h
            k = int(np.argmax(won))
            if won[k] > gain:
                best, gain = (int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2)), float(won[k])
    if best is None:
        yield rule, g / h, True
        return
    if rule:
        yield rule, g / h, False
    f, at = best
    above = x[:, f] > at
    for side in (False, True):
        m = above == side
        yield from _tree(x[m], residual[m], weight[m], features, depth - 1, (*rule, (f, side, at)))


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, at in rule:
        out &= (x[:, f] > at) == above
    return out


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list[tuple]:
    rng, score, rules = np.random.default_rng(seed), np.zeros(len(x)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = rng.choice(len(x), min(len(x), max(200, len(x) // 4)), replace=False)
        features = rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False)
        for rule, step, leaf in _tree(x[rows], (y - p)[rows], (p * (1 - p))[rows], features, depth, ()):
            if rule:
                rules[rule] = None
            if leaf:
                score[holds(rule, x)] += 0.3 * np.clip(step, -4, 4)
    return list(rules)


def lasso_logistic(full: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 120) -> np.ndarray:
    """Weights, the last one of a column of ones without penalty, by accelerated proximal gradient."""
    n, k = full.shape[0], full.shape[1] - 1
    power = np.ones(k + 1, dtype=full.dtype)
    for _ in range(10):
        power = full.T @ (full @ power)
        power /= np.linalg.norm(power)
    rate = 4 * n / float(np.linalg.norm(full @ power) ** 2)
    w, at, t = start, start, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ at, -30, 30)))
        new = at - rate * (full.T @ (p - y)) / n
        new[:k] = np.sign(new[:k]) * np.maximum(0, np.abs(new[:k]) - rate * penalty)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, w, t = (new + (t - 1) / nt * (new - w)).astype(full.dtype), new.astype(full.dtype), nt
    return w


class RuleEnsemble:
    """Weighted conjunctive rules; fitted on the driver, scored as a Column."""

    def __init__(self, rules: list[tuple], weights: np.ndarray, intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, most: int = RULES) -> RuleEnsemble:
        if len(y) == 0 or y.min() == y.max():
            share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
            return cls([], np.empty(0), float(np.log(share / (1 - share))))
        rules = boosted_rules(x, y)
        z = np.stack([holds(r, x) for r in rules], axis=1)
        _, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows are one
        centred = np.abs((z[:, first].T @ (y - y.mean())) / np.sqrt(np.maximum(1, z[:, first].sum(axis=0))))
        first = np.sort(first[np.argsort(-centred, kind="stable")[:OFFERED]])
        full = np.concatenate([z[:, first], np.ones((len(x), 1))], axis=1).astype(np.float32)
        y = y.astype(np.float32)
        penalty, w = 2e-4, np.zeros(full.shape[1], dtype=np.float32)
        while True:  # a larger penalty until few enough rules keep a weight
            w = lasso_logistic(full, y, penalty, w)
            used = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
            if len(used) <= most:
                return cls([rules[first[k]] for k in used], w[used].astype(np.float64), float(w[-1]))
            penalty *= 2

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            cond = None
            for f, above, at in rule:
                c = F.col(STATISTICS[f]) > at if above else F.col(STATISTICS[f]) <= at
                cond = c if cond is None else cond & c
            total = total + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """train: a condition on doc_id for the rows whose labels may be used."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(train)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")  # at most sample rows of two integers
    got = _with_statistics(rows, ["doc_id", "y"]).toPandas().sort_values(["doc_id", *STATISTICS[:3]]).drop_duplicates("doc_id")
    return RuleEnsemble.fit(got[list(STATISTICS)].to_numpy(), (got["y"].to_numpy() > 0).astype(np.float64))


def score_quality(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _with_statistics(rows, ["doc_id"]).select("doc_id", model.score().alias("score"))


def keep_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches least."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    return _with_statistics(rows, ["row"]).where(model.score() >= least).select("row.*")


def held_out(divisor: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == remainder


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

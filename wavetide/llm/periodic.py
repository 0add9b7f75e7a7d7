"""Periodic runs of words: online sparse diagonals.

A text is read once, word by word. Each word is looked up among its earlier occurrences; an occurrence q words ago
lengthens the match on the diagonal of lag q by one, and a diagonal that ends is a run if it is long enough, which is known
at once. Listing every earlier occurrence is quadratic (a text of one word), so occurrences are sparse: two places count as
occurrences only where the m words that end there agree too, m being at least q, and then only the nearest earlier one
counts. Nothing is lost by that. A run has at least q + m words, hence such a place; and as any q consecutive words of a
run with smallest period q recur there at multiples of q alone, the nearest occurrence is the one at lag q. So each diagonal
that is followed through m is a whole run with its smallest period, and lags are looked for in bands (0, m], (m, 2m], ...
with one lag at most for each word and band: n log n steps for n words. Names of m words are exact, made by doubling.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table

#: Bytes of a text that are words at one time.
SLICE = 1 << 21
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice after the other; slices end between words."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + SLICE)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].split()  # at exactly the six blanks
        at = end


def word_numbers(raw: bytes) -> np.ndarray:
    """Each word's number, equal words having equal ones."""
    known: dict[bytes, int] = defaultdict(itertools.count().__next__)
    parts = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in _slices(raw)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _repeated(at: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose name another place has, too; names become small."""
    _, name, count = np.unique(name, return_inverse=True, return_counts=True)
    keep = count[name] > 1
    return at[keep], name[keep]


def _longer(at: np.ndarray, name: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
    """From names of the m words that end at places to names of m + more words, more being m at most."""
    if not len(at):
        return at, name
    before = np.searchsorted(at, at - more)  # at rises; a missing place has another one at its rank
    both = at[before] == at - more
    return _repeated(at[both], name[before[both]] * (name.max() + 1) + name[both])


def find_runs(words: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal runs, by start, then period, of numbered words.

    A run has a smallest period q and at least max(least, exponent * q) words; exponent is 3 at least. Texts may follow each
    other in words if they share no numbers: no run then crosses a border.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 at least")
    size = 1
    while all(max(least - q, (exponent - 1) * q) > size for q in range(1, size + 2)):
        size += 1  # a run of period q <= size has more than q + size - 1 words
    at, name = _repeated(np.arange(len(words)), words)
    have = 1
    while have < size:
        more = min(have, size - have)
        at, name = _longer(at, name, more)
        have += more
    low, found = 0, []
    while len(at):
        order = np.argsort(name, kind="stable")
        place, same = at[order], np.diff(name[order]) == 0
        lag, place = np.diff(place)[same], place[1:][same]
        kept = (lag > low) & (lag <= size)
        lag, place = lag[kept], place[kept]
        order = np.argsort(place)
        lag, place = lag[order], place[order]
        if len(place):
            ends = np.flatnonzero((np.diff(place) != 1) | (np.diff(lag) != 0))
            first, last = place[np.append(0, ends + 1)], place[np.append(ends, len(place) - 1)]
            q = lag[np.append(0, ends + 1)]
            start = first - size + 1 - q
            length = last + 1 - start
            long = length >= np.maximum(least, exponent * q)
            found.append(np.stack([start, length, q])[:, long])
        at, name = _longer(at, name, size)
        low, size = size, 2 * size
    start, length, q = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _collapsed(raw: bytes, n: int, runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by single blanks, but for those of a run behind its first period."""
    if not runs:
        return b" ".join(itertools.chain.from_iterable(_slices(raw))).decode()
    step = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    keep, at, out = np.cumsum(step) == 0, 0, []
    for words in _slices(raw):
        out += itertools.compress(words, keep[at : at + len(words)])
        at += len(words)
    return b" ".join(out).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs; words are whole between blanks and compared as they are.

    runs holds (start, length, period) of each maximal run in words, by start, then period; collapsed is the text's words
    joined by single blanks, without those of a run behind its first period. A null or blank text has no words, no runs and
    an empty collapsed text. Rows stay in their tasks, so repeated and null ids are rows like others; other columns are not
    read. Memory follows the longest text: a few numbers for each of its words.
    """

    @released
    def kernel(batches):
        for b in batches:
            raws = [(t or "").encode() for t in b.column(1).to_pylist()]
            numbers = [word_numbers(r) for r in raws]
            sizes = [len(x) for x in numbers]
            base = np.cumsum([0, *(int(x.max()) + 1 if len(x) else 0 for x in numbers)])
            begins = np.cumsum([0, *sizes])
            every = np.concatenate([x + y for x, y in zip(numbers, base)]) if numbers else np.empty(0, np.int64)
            start, length, q = find_runs(every, least, exponent)
            cut = np.searchsorted(start, begins)
            runs = [list(zip((start[i:j] - a).tolist(), length[i:j].tolist(), q[i:j].tolist())) for a, i, j in zip(begins, cut, cut[1:])]
            texts = [_collapsed(r, n, x) for r, n, x in zip(raws, sizes, runs)]
            structs = [[dict(zip(("start", "length", "period"), x)) for x in one] for one in runs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(structs, _RUNS), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period, ties to the smaller start, then period; null without runs."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda a, b: F.when(a.isNull() | (b.length * a.period > a.length * b.period), b).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents; of a tenth of them, by the checksum of the id, words repeat with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeat(words: Column, g: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        return F.transform(F.array(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))), lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(words, (F.when(i < x.a, i).otherwise(x.a + (i - x.a) % x.p) + 1).cast("int"))), " "))[0]

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    repeated = F.transform(F.array(words), lambda w: repeat(w, F.floor(h / 10)))[0]  # a lambda's variable is evaluated once
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda x: F.concat(x.start.cast("string"), F.lit(","), x.length.cast("string"), F.lit(","), x.period.cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

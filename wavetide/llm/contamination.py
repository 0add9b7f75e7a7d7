"""Documents that hold passages of a benchmark: one Aho-Corasick automaton over the words of all its items.

Texts and items are normalised alike: A-Z in lower case, words being runs of a-z, 0-9 and characters beyond ASCII. An item
has a window for each ten consecutive words, an item of fewer words is one window. The automaton's alphabet are the words
of the windows; every document is scanned once, whole, by the numbers of its words, and what is found is said in words and
in characters of the original text.
"""

from __future__ import annotations

import itertools
import pickle

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, per_task, released, small_batches, table

WINDOW = 10
#: Rows of (item, window) and bytes of their words in one automaton; of a larger benchmark each part has an automaton of
#: its own, and the parts scan one after the other. So what the driver holds and the executors get is bounded.
ROWS, BYTES = 100_000, 32 << 20
#: Bytes of a text that are words at one time.
SLICE = 1 << 21

#: A-Z in lower case, and a blank for what no word has; lengths stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_PARTS = ("first_word", "words", "start", "end")
_SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in _PARTS]))
_SPANS_SQL = "array<struct<first_word: long, words: long, start: long, end: long>>"


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or "").encode().translate(_PLAIN).split()


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, words): each window of each item once. Null and wordless texts have none."""
    kind = pa.list_(pa.binary())

    @released
    def cut(batches):
        for b in batches:
            for item, text in zip(b.column(0), b.column(1).to_pylist()):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, 10_000):
                    out = [words[i : i + window] for i in range(at, min(at + 10_000, max(1, len(words) - window + 1)))]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(out), b.column(0).type), pa.array(out, kind)], ["item", "words"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"item {rows.schema['item'].dataType.simpleString()}, words array<binary>").distinct()


@per_task
def _automaton(rows: bytes) -> tuple[dict[bytes, int], ahocorasick.Automaton]:
    """The numbers of words and the automaton, whose values are a window's length and the items that have it."""
    known: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], list] = {}
    for item, words in pickle.loads(rows):
        windows.setdefault(tuple(known.setdefault(w, len(known) + 1) for w in words), []).append(item)
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, items in windows.items():
        auto.add_word(key, (len(key), tuple(items)))
    auto.make_automaton()
    return known, auto


def _numbers(raw: bytes, known: dict[bytes, int]):
    """The numbers of the words of a plain text, a slice after the other, 0 for words that no window has."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield tuple(map(known.get, words := raw[at:end].split(), itertools.repeat(0, len(words))))
        at = end


def scan(raw: bytes, known: dict[bytes, int], auto: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set]:
    """(words, runs of hit words as (first, end), items) of a plain text; a slice goes on where the last one ended."""
    n, found, items, search = 0, [], set(), None
    for ids in _numbers(raw, known):
        if search is None:
            search = auto.iter(ids)
        else:
            search.set(ids)
        for at, (length, of) in search:
            if found and at - length + 1 <= found[-1][1] and at - length + 1 >= found[-1][0]:
                found[-1] = (found[-1][0], at + 1)  # ends never fall
            else:
                found.append((at - length + 1, at + 1))
            items.update(of)
        n += len(ids)
    return n, merged(found), items


def merged(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Maximal runs of spans (first, end, ...) that overlap or touch; further pairs of bounds are merged alike."""
    runs: list[tuple[int, ...]] = []
    for x in sorted(spans):
        if runs and x[0] <= runs[-1][1]:
            last = runs[-1]
            runs[-1] = tuple(f(last[k], x[k]) for k, f in enumerate((min, max) * (len(x) // 2)))
        else:
            runs.append(x)
    return runs


def _characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first word, end, start, end) of runs: start and end count the characters of the original text."""
    if not runs:
        return []
    plain = np.frombuffer(raw.translate(_PLAIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(plain, prepend=False, append=False))
    first = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80  # bytes that begin a character
    out, at, chars = [], 0, 0
    for a, b in runs:
        bounds = []
        for x in (edges[2 * a], edges[2 * b - 1]):
            chars += int(np.count_nonzero(first[at:x]))
            at = x
            bounds.append(chars)
        out.append((a, b, *bounds))
    return out


def _spans(runs: list[tuple[int, int, int, int]]) -> list[dict[str, int]]:
    return [dict(zip(_PARTS, (a, b - a, c, d))) for a, b, c, d in runs]


def _parts(windows: DataFrame) -> list[DataFrame]:
    """The windows in parts of bounded size."""
    size = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w))
    rows, held = windows.select(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    n = max(1, -(-rows // ROWS), -(-held // BYTES))
    while n > 1:
        dealt = windows.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
        if dealt.groupBy("part").count().agg(F.max("count")).first()[0] <= 2 * ROWS:
            return [dealt.where(F.col("part") == k).drop("part") for k in range(n)]
        n *= 2
    return [windows]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of docs.

    spans are the maximal runs of words that occurrences of windows cover: first_word and words count words, start and end
    characters of the text as it is. items are the ids of all items with a window that occurs, each once, ordered as
    strings; an item without an id marks spans, but isn't listed. Null and wordless texts, of documents or items, have no
    words and no windows. Rows stay in their tasks (but for benchmarks of more than ROWS windows, whose parts' findings are
    put together by row), so repeated and null ids are rows like others; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = materialize(benchmark_windows(items, item_id, item_text, window))
    kind = windows.schema["item"].dataType.simpleString()
    parts = _parts(windows)

    def found(rows: DataFrame, part: DataFrame, every: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(pickle.dumps([(r[0], [bytes(w) for w in r[1]]) for r in part.collect()]))

        @released
        def kernel(batches):
            known, auto = _automaton(sent.value)
            for b in batches:
                out = []
                for no, (row, text) in enumerate(zip(b.column(0), b.column(1).to_pylist())):
                    raw = (text or "").encode()
                    n, runs, of = scan(raw.translate(_PLAIN), known, auto) if len(auto) else (len(words_of(text)), [], ())
                    if every or runs:
                        out.append((no, n, _spans(_characters(raw, runs)), sorted(of - {None}, key=str) if of else []))
                rows, n, spans, of = zip(*out) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(of, pa.list_(item_type))], ["row", "n_words", "spans", "items"])

        item_type = pa.string() if kind == "string" else pa.int64()
        of = kind if kind == "string" else "long"
        return rows.mapInArrow(kernel, f"row {rows.schema[0].dataType.simpleString()}, n_words long, spans {_SPANS_SQL}, items array<{of}>")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if len(parts) == 1:
        return found(rows, parts[0], True).withColumnRenamed("row", "doc_id")
    numbered = materialize(rows.select(F.struct(F.monotonically_increasing_id().alias("no"), "doc_id").alias("row"), "text"))
    every = [materialize(found(numbered, part, k == 0)) for k, part in enumerate(parts)]

    def merge(batches):
        for b in batches:
            spans = [merged([(x["first_word"], x["first_word"] + x["words"], x["start"], x["end"]) for x in one]) for one in b.column(2).to_pylist()]
            of = [sorted(set(x), key=str) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_spans(x) for x in spans], _SPANS), pa.array(of, b.column(3).type)], b.schema.names)

    union = every[0]
    for x in every[1:]:
        union = union.unionByName(x)
    by_row = union.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return by_row.select("row.doc_id", "n_words", "spans", "items").mapInArrow(merge, every[0].withColumn("row", F.col("row.doc_id")).withColumnRenamed("row", "doc_id").schema)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.words).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("items").cast("array<string>"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )

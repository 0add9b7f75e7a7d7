"""Phrase collocations by FM-indexes of word numbers, one for each shard of a language.

A task gathers the pieces of its texts, a language at a time, into shards of at most SHARD tokens, and numbers the words of
a shard. Two indexes of the numbers, of the text and of its mirror image, give bidirectional search: a phrase is an interval
of rows of either, and the last columns of its rows hold the words before it (text) or behind it (mirror), so all phrases of
a length are extended at once by sorting their rows by these words. Single words are extended to the right, then everything
to the left, which meets each phrase once, with its count. Suffixes end with their piece, as phrases do.

What a shard counts leaves its task in blocks of phrases, one for each bucket of a hash of the phrase; a bucket's blocks
are added up in one task, and phrases below the threshold go. Parts, extensions and ranks are joins over what is left.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, released, shuffle_partitions, small_batches, table
from .shingles import mix

#: Tokens (words and ends of pieces) of a shard, and of all shards that a task has open.
SHARD, OPEN = 1 << 21, 1 << 22
#: Bytes of all texts for which there is one bucket.
BUCKET = 16 << 20
#: Bytes of a text that are words at one time.
SLICE = 1 << 20
#: Phrases that a bucket holds before equal ones are added up.
FOLD = 1 << 20

#: A-Z in lower case; ends of pieces are line feeds, tabs are blanks.
_PLAIN = bytearray(range(256))
_PLAIN[65:91] = _PLAIN[97:123]
_PLAIN[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _PLAIN[_c] = 10
_PLAIN = bytes(_PLAIN)
_END, _NONE = 0, -1


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The places of a text, sorted by what follows up to the next 0, then by place; the text ends with 0.

    Prefixes double; only places that are not yet told apart, and whose prefix has no 0, are sorted again.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the next 0
    key = np.where(text > 0, text.astype(np.int64) * (int(text.max()) + 1) + np.append(text[1:], 0), 0)
    order = np.argsort(key, kind="stable")
    starts = np.append(True, np.diff(key[order]) != 0)
    slots, size = np.arange(n), 2
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    while True:
        # slots of groups of several places whose first size symbols have no 0
        alone = starts & np.append(starts[1:], True)
        open_ = ~alone & (left[order[slots]] >= size)
        slots = slots[open_]
        if not len(slots):
            return order
        at = order[slots]
        group, key = rank[at], rank[at + size]
        again = np.lexsort((key, group))
        order[slots] = at = at[again]
        group, key = group[again], key[again]
        starts = np.append(True, (np.diff(group) != 0) | (np.diff(key) != 0))
        rank[at] = slots[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
        size *= 2


class WordIndex:
    """The Burrows-Wheeler transform of a text of words 1 to most, with 0 at both ends and between pieces."""

    def __init__(self, text: np.ndarray, most: int):
        self.order = suffix_order(text)
        self.last = text[self.order - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=most + 1)))
        self.row = np.empty(len(text), np.int64)
        self.row[self.order] = np.arange(len(text))

    def extend(self, low: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """The intervals one word longer: (which interval, word, lower row, size, lower row in the mirror's index).

        low and size are intervals of this index, other the lower rows of the same phrases in the mirror's.
        """
        ends = np.cumsum(size)
        which = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(which)) + np.repeat(low - (ends - size), size)
        key = which * len(self.first) + self.last[rows]
        by = np.argsort(key, kind="stable")
        key = key[by]
        at = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(at, len(key)))
        which, word = key[at] // len(self.first), key[at] % len(self.first)
        mirrored = other[which] + at - (ends - size)[which]  # behind the phrases with smaller words there
        kept = word > 0
        first = self.row[self.order[rows[by[at[kept]]]] - 1]  # the row of the place before
        return which[kept], word[kept], first, count[kept], mirrored[kept]


def phrases(text: np.ndarray, most: int, longest: int):
    """For each length up to longest: (columns of word numbers, counts) of all phrases of a text as WordIndex takes it."""
    before, behind = WordIndex(text, most), WordIndex(text[::-1], most)
    words = np.flatnonzero(np.diff(before.first)[1:]) + 1
    low, size = before.first[words], np.diff(before.first)[words]
    mirror, columns = low, [words]
    yield columns, size
    for k in range(2, longest + 1):
        if k == 2:
            which, word, mirror, size, low = behind.extend(mirror, size, low)
            columns = [c[which] for c in columns] + [word]
            del behind
        else:
            which, word, low, size, mirror = before.extend(low, size, mirror)
            columns = [word] + [c[which] for c in columns]
        yield columns, size


def _mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each phrase from those of its words."""
    h = np.zeros(len(hashes[0]), np.uint64)
    for x in hashes:
        h = mix((h + x) * np.uint64(3))
    return h


class _Shard:
    """Tokens of one language; words are numbered as they come."""

    def __init__(self, context: tuple[bytes, ...] = ()):
        """context: words of a piece that another shard has begun; they are counted there."""
        self.known: dict[bytes, int] = defaultdict(itertools.count(1).__next__, {b"\n": _END, b"": _NONE})
        self.parts = [np.array([_END, *map(self.known.__getitem__, context)], np.int32)]
        self.size, self.context = len(self.parts[0]), context

    def add(self, plain: bytes) -> None:
        tokens = plain.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.known.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(ids[ids != _NONE])
        self.size += len(self.parts[-1])

    def tail(self, longest: int) -> tuple[bytes, ...]:
        """The last words of the piece that is still open, as many as a longer phrase may begin with."""
        text = np.concatenate(self.parts)[-(longest - 1) :] if longest > 1 else np.empty(0, np.int32)
        text = text[np.flatnonzero(np.append(_END, text) == _END)[-1] :]
        words = dict(zip(self.known.values(), self.known.keys()))
        return tuple(words[int(i)] for i in text)

    def blocks(self, longest: int, buckets: int):
        """(bucket, phrases, counts): all phrases, and the number of words as the count of the empty phrase."""
        text = np.concatenate([*self.parts, [_END]]).astype(np.int32)
        words = [w for w, i in self.known.items() if i > 0]
        hashes = mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
        vocabulary = pa.array(words, pa.binary())
        n = int(np.count_nonzero(text)) - len(self.context)
        yield 0, pa.array([b""], pa.binary()), np.array([n], np.int64)
        bucket_of = lambda columns: (_mixed([hashes[c - 1] for c in columns]) % np.uint64(buckets)).astype(np.int64)
        for i, j in itertools.combinations(range(len(self.context) + 1), 2):  # counted where the piece began
            numbers = [np.array([self.known[w]]) for w in self.context[i:j]]
            yield int(bucket_of(numbers)[0]), pa.array([b" ".join(self.context[i:j])], pa.binary()), np.array([-1], np.int64)
        made = list(phrases(text, len(words), longest)) if words else []
        del text
        self.parts = []
        while made:
            columns, count = made.pop()
            bucket = bucket_of(columns)
            by = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edge)):
                rows = by[edge[k] : edge[k + 1]]
                parts = [vocabulary.take(pa.array(c[rows] - 1)) for c in columns]
                yield int(k), pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if len(parts) > 1 else parts[0], count[rows]


def _packed(phrase: pa.Array, count: np.ndarray) -> tuple[int, int, bytes]:
    """Phrases and counts as (rows, size, compressed bytes)."""
    phrase = pa.concat_arrays([phrase])
    offsets = np.frombuffer(phrase.buffers()[1], np.int32)[phrase.offset : phrase.offset + len(phrase) + 1]
    raw = count.astype("<i8").tobytes() + np.diff(offsets).astype("<i4").tobytes() + (phrase.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if phrase.buffers()[2] else b"")
    return len(phrase), len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(rows: int, size: int, block: bytes) -> tuple[pa.Array, pa.Array]:
    raw = pa.decompress(block, size, codec="zstd")
    offsets = np.append(0, np.cumsum(np.frombuffer(raw, "<i4", rows, 8 * rows))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), raw.slice(12 * rows)]), pa.array(np.frombuffer(raw, "<i8", rows))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, words, phrase, f): phrases of up to longest words that occur at least `least` times in a language.

    The empty phrase of 0 words counts all words of a language. A null lang is `und`. Null texts and texts of blanks and
    punctuation have no words; rows count as often as they stand in docs, whatever their other columns.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))

    @released
    def count(batches):
        shards: dict[str, _Shard] = {}

        def blocks(lang: str, open_: bool):
            shard = shards.pop(lang)
            if open_ and (tail := shard.tail(longest)):
                shards[lang] = _Shard(tail)
            parts = ((bucket, *_packed(p, c)) for bucket, p, c in shard.blocks(longest, buckets))
            while some := list(itertools.islice(parts, 64)):
                b, n, size, block = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([lang] * len(b)), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(block, pa.binary())], ["bucket", "lang", "n", "size", "block"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, at = (text or "").encode().translate(_PLAIN) + b"\n", 0
                while at < len(raw):
                    end = min((x for x in (raw.find(b" ", at + SLICE), raw.find(b"\n", at + SLICE)) if x >= 0), default=len(raw))
                    if lang not in shards:
                        shards[lang] = _Shard()
                    shard = shards[lang]
                    shard.add(raw[at:end])
                    at = end
                    if shard.size >= SHARD:
                        yield from blocks(lang, at < len(raw))
                if sum(s.size for s in shards.values()) >= OPEN:
                    yield from blocks(max(shards, key=lambda x: shards[x].size), False)
        for lang in list(shards):
            yield from blocks(lang, False)

    @released
    def add(batches):
        held: dict[str, list[tuple[pa.Array, pa.Array]]] = {}
        at, rows = None, 0

        def fold():
            for lang, parts in held.items():
                t = pa.table({"phrase": pa.chunked_array([p for p, _ in parts], pa.binary()), "f": pa.chunked_array([c for _, c in parts], pa.int64())})
                t = t.group_by("phrase").aggregate([("f", "sum")]).combine_chunks()
                held[lang] = [(x, y) for x, y in zip(t["phrase"].chunks, t["f_sum"].chunks)]
            return sum(len(p) for parts in held.values() for p, _ in parts)

        def done():
            fold()
            for lang, parts in held.items():
                for p, f in parts:
                    keep = pc.or_(pc.greater_equal(f, least), pc.equal(pc.binary_length(p), 0))
                    p, f = p.filter(keep), f.filter(keep)
                    words = pc.if_else(pc.equal(pc.binary_length(p), 0), 0, pc.add(pc.count_substring(p, " "), 1))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(p), pa.string()), words.cast(pa.int32()), p.cast(pa.string()), f], ["lang", "words", "phrase", "f"])
            held.clear()

        most = FOLD
        for b in batches:
            for bucket, lang, n, size, block in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != at:
                    if held:
                        yield from done()
                    at, rows, most = bucket, 0, FOLD
                held.setdefault(lang, []).append(_unpacked(n, size, block))
                rows += n
                if rows >= most:
                    rows = fold()
                    most = rows + max(FOLD, rows // 2)
        if held:
            yield from done()

    made = rows.mapInArrow(count, "bucket long, lang string, n long, size long, block binary")
    made = made.repartition(max(shuffle_partitions(spark), 1), "bucket").sortWithinPartitions("bucket", "lang")
    return made.mapInArrow(add, "lang string, words int, phrase string, f long")


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to longest words.

    a is the count of a phrase, l and r those of the parts of its lowest-scoring cut (ties: the first), score
    floor(1000000 a² / (l r)) in exact decimals (counts below 10^15), n the number of words of the language. A phrase goes
    if one that has a word more before or behind it is at least half as frequent. Order: score, a, then phrase in bytes.
    """
    spark = docs.sparkSession
    found = materialize(frequent_phrases(docs, text_col, lang_col, longest, least))
    count = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    candidates = found.where("words >= 2").withColumnRenamed("f", "a")
    split = candidates.withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    split = split.select("lang", "words", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("right"))
    split = split.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    exact = lambda x: F.col(x).cast("decimal(15, 0)")
    split = split.withColumn("square", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7, 0)")).withColumn("parts", exact("l") * exact("r"))
    scored = split.withColumn("score", F.expr("square div parts")).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    longer = candidates.where("words >= 3").withColumn("w", F.split("phrase", " "))
    inner = F.explode(F.array(*(F.array_join(F.slice("w", k, F.col("words") - 1), " ") for k in (1, 2))))
    longer = longer.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where("most is null or 100 * most < 50 * a").select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    # ranks by one sort over all languages: places within ranges, and how many rows of a language stand in earlier ranges
    order = ["lang", F.desc("score"), F.desc("a"), "phrase"]
    ordered = kept.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("no", F.monotonically_increasing_id()).withColumn("part", F.shiftright("no", 33)))
    ranges = ordered.groupBy("lang", "part").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("size"))
    earlier = F.expr("coalesce(sum(size) over (partition by lang order by part rows between unbounded preceding and 1 preceding), 0)")
    ranked = ordered.join(ranges.withColumn("earlier", earlier), ["lang", "part"]).withColumn("rank", F.expr("earlier + no - first + 1")).where(F.col("rank") <= top)
    return ranked.join(found.where("words = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))

"""Removal of repeated substrings of a given length by prefix-free parsing.

A rolling hash of ``SEED_BYTES`` bytes is taken everywhere; the smallest one among those inside a window of ``length``
bytes is the window's trigger, which depends on the window's content alone. Consecutive windows with one trigger make a
phrase, reaching ``length - 1`` bytes into the next ones, so that each window lies whole in one phrase and equal windows
lie in phrases with the same trigger.

1. Parse: each phrase sends its trigger, a name of its content and its place to the task for its trigger. Phrases of
   equal content are one entry of the dictionary, owned by the smallest id; all windows of later occurrences are
   repeats. Chunks of a task do so first among themselves, so a passage in any number of documents brings one entry a
   chunk and never gathers in one task.
2. Where phrases with one trigger differ (borders of repeats, edited copies), the owners send their bytes. A bucket of
   these, which are much alike, is parsed again by a small rolling hash; the suffix arrays of that dictionary and of that
   parse combine into the order of all suffixes (prefix_free.py), so that equal windows stand side by side, and the
   smallest id that has a window is known.
3. Removed ranges return to their documents, where overlapping ones are merged.

For text without any repeats nothing but triggers and names is exchanged. Places and removed ranges travel as packed
arrays: one row from a task to a bucket, and one from a bucket to a home; each bucket and each home is a task of its own.
Where there are many buckets, a task of step 1 gathers up to FULL phrases for each (HELD in all) before it sends them, so
that its rows don't become shorter the more buckets there are.

Defined results: null text is empty; a null id keeps its whole text; rows of one id don't remove each other's bytes,
whether their texts are equal or not; texts shorter than ``length`` are kept; empty tables give no rows; other columns
are ignored. Phrases are named by 88 bits of hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, per_task, released, shuffle_partitions, table
from .prefix_free import corpus_order
from .shingles import mix

LENGTH = 50
#: Bytes under a trigger's hash, of the default length.
SEED_BYTES = 24
#: Bytes of text whose phrases are grouped together, and that are parsed at once.
CHUNK, PIECE = 2 << 20, 1 << 18
#: Bytes of text that one bucket is made for, and parts of a bucket's triggers, of which a task works on one at a time.
BUCKET, PARTS = 8 << 20, 4
#: Phrases that a task gathers for each bucket before it sends them, and that it gathers in all at most.
FULL, HELD = 256, 1 << 19
#: Windows of a phrase at most; a longer one (periodic text) is cut.
LONGEST = 1024
_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_TABLE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@per_task
def _powers(n: int):
    out = []
    for base in (_ODD, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out


def _pack(*columns: np.ndarray) -> bytes:
    """Integers as differences, bytes of equal rank together, compressed."""
    n = len(columns[0])
    raw = [np.diff(c.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(n, 8).T.tobytes() for c in columns]
    return zstandard.compress(b"".join(raw), 1)


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(-1, 8, n)
    return [np.cumsum(np.ascontiguousarray(c.T).view(np.int64).reshape(-1)) for c in raw]


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_low_bytes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.reshape(-1).view(np.uint64)


def parse(texts: list[bytes], length: int = LENGTH, seed: int = SEED_BYTES) -> tuple[np.ndarray, ...]:
    """Phrases of all texts: text number, first byte, windows, trigger, name of the content.

    PIECE bytes are parsed at a time, long texts in parts that share length - 1 bytes, so that no window is in two."""
    found, part, held = [], [], 0

    def flush():
        text, start, *rest = _parse([t for _, _, t in part], length, seed)
        number, first = (np.array([p[c] for p in part], dtype=np.int64) for c in (0, 1))
        found.append((number[text], first[text] + start, *rest))
        part.clear()

    for k, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), PIECE):
            piece = t[lo : lo + PIECE + length - 1]
            if part and held + len(piece) > PIECE + length:
                flush()
                held = 0
            part.append((k, lo, piece))
            held += len(piece)
    if part:
        flush()
    return tuple(np.concatenate([f[c] for f in found]) for c in range(5)) if found else _parse([], length, seed)


def _parse(texts: list[bytes], length: int, seed: int) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    none = tuple(np.empty(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(buf) < length:
        return none
    ends = np.cumsum(sizes)
    power, inverse = (p[: len(buf) + 1] for p in _powers((len(buf) >> 19) + 1 << 19))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[buf] * power[:-1])])
    h = mix((sums[seed:] - sums[:-seed]) * inverse[: len(buf) - seed + 1])
    width, low, reach = length - seed + 1, h, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    n = len(low)  # windows, also those across texts
    alive = np.zeros(n + 1, dtype=np.int32)
    long = sizes >= length
    np.add.at(alive, (ends - sizes)[long], 1)
    np.add.at(alive, (ends - length + 1)[long], -1)
    alive = np.cumsum(alive[:-1]) > 0
    cut = np.empty(n, dtype=bool)
    cut[0] = True
    cut[1:] = (low[1:] != low[:-1]) | (alive[1:] != alive[:-1])
    cut[(ends - sizes)[long]] = True
    start = np.flatnonzero(cut)
    count = np.diff(start, append=n)
    keep = alive[start]
    start, count = start[keep], count[keep]
    if len(count) and count.max() > LONGEST:
        parts = -(-count // LONGEST)
        again = np.repeat(np.arange(len(start)), parts)
        inner = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = start[again] + inner * LONGEST, np.minimum(LONGEST, count[again] - inner * LONGEST)
    if not len(start):
        return none
    text = np.searchsorted(ends, start, side="right")
    stop = start + count + length - 1
    name = mix((sums[stop] - sums[start]) * inverse[start] + count.astype(np.uint64))
    return text, start - (ends - sizes)[text], count, mix(low[start] ^ np.uint64(5)), name


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after another."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _split(to: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(to, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []


def _chunks(batches, id_at: int, text_at: int) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(id_at).to_pylist(), b.column(text_at).to_pylist()):
            if held + len(t) > CHUNK and ids:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t.encode() if isinstance(t, str) else t)
            held += len(texts[-1])
    if ids:
        yield ids, texts


def _place(texts: list[bytes]) -> np.ndarray:
    """High parts of places: places of rows with one id but other texts differ."""
    return np.array([zlib.crc32(t) >> 1 for t in texts], dtype=np.int64) << np.int64(32)


_PACKED = ["kind", "home", "trigger", "n", "places", "keys"]
_PACKED_TYPES = "kind long, home long, trigger long, n long, places binary, keys binary"
REMOVED, OPEN = 0, 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], _PACKED)


def _home_rows(kind: int, trigger: int, doc, place, count, keys: np.ndarray | None, homes: int) -> list[tuple]:
    """Packed places for the tasks of their documents."""
    out = []
    for part in _split(_home(doc, homes)):
        part = part[np.lexsort((place[part], doc[part]))]
        raw = b"" if keys is None else _low_bytes(keys[part], 6)
        out.append((kind, int(_home(doc[part[:1]], homes)[0]), trigger, len(part), _pack(doc[part], place[part], count[part]), raw))
    return out


def _part(trigger: np.ndarray) -> np.ndarray:
    """The part of its bucket that a trigger belongs to, from low bits: high ones choose the bucket."""
    return (trigger % np.uint64(PARTS)).astype(np.int64)


def _home(doc: np.ndarray, homes: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(homes)).astype(np.int64)


def _entries(rows: DataFrame, length: int, seed: int, buckets: int, homes: int) -> DataFrame:
    """Phrases by bucket of triggers (kind 1, places and keys packed), and removed ranges found within a task (kind 0)."""

    @released
    def run(batches):
        held, n = [], 0

        def done():
            doc, place, count, trigger, name = (np.concatenate([x[c] for x in held]) for c in range(5))
            held.clear()
            order = np.lexsort((doc, name, trigger))
            doc, place, count, trigger, name = (x[order] for x in (doc, place, count, trigger, name))
            head = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (name[1:] != name[:-1])])
            owner = doc[np.flatnonzero(head)[np.cumsum(head) - 1]]
            late = doc > owner
            out = _home_rows(REMOVED, -1, doc[late], place[late], count[late], None, homes) if late.any() else []
            doc, place, count, trigger, name = (x[~late] for x in (doc, place, count, trigger, name))
            to = ((trigger >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)
            for part in _split(to):
                part = part[np.lexsort((place[part], doc[part]))]
                out.append((OPEN, -1, int(to[part[0]]), len(part), _pack(doc[part], place[part], count[part]), _low_bytes(trigger[part], 6) + _low_bytes(name[part], 5)))
            yield _batch(out)

        for ids, texts in _chunks(batches, 0, 1):
            text, start, count, trigger, name = parse(texts, length, seed)
            if not len(text):
                continue
            held.append((np.array(ids, dtype=np.int64)[text], _place(texts)[text] + start, count, trigger, name))
            n += len(text)
            if n >= min(FULL * buckets, HELD):
                yield from done()
                n = 0
        if held:
            yield from done()

    return rows.mapInArrow(run, _PACKED_TYPES)


def _dictionary(entries: DataFrame, buckets: int, homes: int) -> DataFrame:
    """Removed ranges (kind 0) and, for phrases whose trigger has other phrases, owners' places (kind 1), by home: at most
    one row of a kind from a bucket to a home."""

    @released
    def run(batches):
        at, held = None, []

        def removed():
            """What senders have told of one home, in one row."""
            if len(held) == 1:
                return _batch(held)
            cols = [_unpack(x[4], x[3]) for x in held]
            return _batch(_home_rows(REMOVED, -1, *(np.concatenate([c[k] for c in cols]) for k in range(3)), None, homes))

        def entries():
            """doc, place, windows, trigger, name of the bucket's phrases, by part."""
            by = [[] for _ in range(PARTS)]
            for *_, n, places, keys in held:
                cols = (*_unpack(places, n), _from_low_bytes(keys[: 6 * n], 6), _from_low_bytes(keys[6 * n :], 5))
                part = _part(cols[3])
                for k in range(PARTS):
                    by[k].append([c[part == k] for c in cols])
            held.clear()
            for cols in by:
                yield (np.concatenate(c) for c in zip(*cols))
                cols.clear()

        def done():
            found = {REMOVED: [], OPEN: []}
            for doc, place, count, trigger, name in entries():
                if not len(doc):
                    continue
                order = np.lexsort((doc, name, trigger))
                doc, place, count, trigger, name = (x[order] for x in (doc, place, count, trigger, name))
                head = np.concatenate([[True], trigger[1:] != trigger[:-1]])
                first = head.copy()
                first[1:] |= name[1:] != name[:-1]
                owner = doc[np.flatnonzero(first)[np.cumsum(first) - 1]]
                late = doc > owner
                start = np.flatnonzero(head)
                kinds = np.add.reduceat(first.astype(np.int64), start)
                varied = (kinds > 1) & (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start))
                open_ = varied[np.cumsum(head) - 1] & ~late
                for kind, which in ((REMOVED, late), (OPEN, open_)):
                    found[kind].append([x[which] for x in (doc, place, count, trigger)])
            for kind, cols in found.items():
                doc, place, count, trigger = (np.concatenate(c) for c in zip(*cols))
                cols.clear()
                if len(doc):
                    yield _batch(_home_rows(kind, at[1] if kind == OPEN else -1, doc, place, count, trigger if kind == OPEN else None, homes))

        def closed():
            if held and at[0] == REMOVED:
                yield removed()
            elif held:
                yield from done()
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                kind, home, bucket = row[:3]
                if at != (kind, home if kind == REMOVED else bucket):
                    yield from closed()
                    at = kind, home if kind == REMOVED else bucket
                held.append(row)
        yield from closed()

    to = F.when(F.col("kind") == OPEN, F.col("trigger")).otherwise(F.col("home"))
    return entries.repartitionById(buckets, to.cast("int")).sortWithinPartitions("kind", "trigger", "home").mapInArrow(run, _PACKED_TYPES)


def _with_homes(rows: DataFrame, packed: DataFrame, homes: int, raw: bool = True) -> DataFrame:
    """Texts (compressed) behind the packed places of their home: home, is_text, n, trigger, places, keys, doc_id, text."""

    @released
    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=1)
        seen = TaskContext.get().partitionId() << 40
        for b in batches:
            ids = b.column(0)
            # rows without an id have no places anywhere, so any home will do: by where they stand
            known = np.where(np.asarray(ids.is_null()), seen + np.arange(b.num_rows), np.asarray(ids.fill_null(0)))
            seen += b.num_rows
            raw = pa.array([z.compress(x.encode()) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_home(known, homes), pa.int64()), ids, raw, *b.columns[2:]], ["home", "doc_id", "text", *rest])

    rest = rows.columns[2:]
    shape = T.StructType([T.StructField("home", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.BinaryType()), *(rows.schema[c] for c in rest)])
    texts = rows.mapInArrow(squeeze, shape)
    none = lambda kind: F.lit(None).cast(kind)
    texts = texts.select("home", F.lit(1).alias("is_text"), none("long").alias("n"), none("long").alias("trigger"), none("binary").alias("places"), none("binary").alias("keys"), "doc_id", "text", *rest)
    packed = packed.select("home", F.lit(0).alias("is_text"), "n", "trigger", "places", "keys", none("long").alias("doc_id"), none("binary").alias("text"), *(none(rows.schema[c].dataType).alias(c) for c in rest))
    return texts.unionByName(packed).repartitionById(homes, F.col("home").cast("int")).sortWithinPartitions("home", "is_text")


class _Places:
    """Packed places of one home, by document."""

    def __init__(self):
        self.blobs = []

    def add(self, n, places, trigger, keys):
        self.blobs.append((n, places, trigger, keys))

    def close(self, keyed: bool):
        cols = [_unpack(p, n) for n, p, _, _ in self.blobs]
        parts = [np.concatenate([c[k] for c in cols]) if cols else np.empty(0, np.int64) for k in range(3)]
        self.doc, self.place, self.count = parts
        if keyed:
            self.bucket = np.repeat([t for _, _, t, _ in self.blobs], [n for n, _, _, _ in self.blobs]).astype(np.int64)
            self.key = np.concatenate([_from_low_bytes(k, 6) for *_, k in self.blobs]) if self.blobs else np.empty(0, np.uint64)
        order = np.lexsort((self.place, self.doc))
        for k in ("doc", "place", "count", *(("bucket", "key") if keyed else ())):
            setattr(self, k, getattr(self, k)[order])
        return self

    def of(self, doc: int, high: int) -> slice:
        a, b = np.searchsorted(self.doc, [doc, doc + 1])
        lo, hi = np.searchsorted(self.place[a:b], [high, high + (1 << 32)])
        return slice(a + lo, a + hi)


def _homes(batches, keyed: bool):
    """(places of the home, documents' ids, texts, their other columns) for batches that _with_homes dealt."""
    home, places, closed, z = None, _Places(), None, zstandard.ZstdDecompressor()
    for b in batches:
        ids, texts, at = [], [], []

        def rest():
            return [c.take(pa.array(at, pa.int64())) for c in b.columns[8:]]  # noqa: B023

        for row, (h, is_text, n, trigger, blob, keys, doc, text) in enumerate(zip(*(c.to_pylist() for c in b.columns[:8]))):
            if h != home:
                if ids:
                    yield closed or places.close(keyed), ids, texts, rest()
                    ids, texts, at = [], [], []
                home, places, closed = h, _Places(), None
            if not is_text:
                places.add(n, blob, trigger, keys)
                continue
            closed = closed or places.close(keyed)
            ids.append(doc)
            texts.append(z.decompress(text))
            at.append(row)
        if ids:
            yield closed, ids, texts, rest()


def _owned_bytes(texts: DataFrame, length: int) -> DataFrame:
    """Phrases' bytes by bucket: bucket, n, places (doc, place, windows), bytes, both by part of the bucket; parts and sizes
    are the phrases and the compressed bytes of each."""

    @released
    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for places, ids, raws, _ in _homes(batches, keyed=True):
            found, starts, base, at = [], [], 0, []
            high = _place(raws)
            for i, raw, up in zip(ids, raws, high):
                if i is not None:
                    s = places.of(i, int(up))
                    found.append(np.arange(s.start, s.stop))
                    at.append(places.place[s] - up + base)
                base += len(raw)
            index = np.concatenate(found) if found else np.empty(0, np.int64)
            if not len(index):
                continue
            data, at = np.frombuffer(b"".join(raws), np.uint8), np.concatenate(at)
            bucket, out = places.bucket[index], []
            for own in _split(bucket):
                part = _part(places.key[index[own]])
                own = own[np.argsort(part, kind="stable")]
                parts = np.bincount(part, minlength=PARTS)
                mine, count = index[own], places.count[index[own]]
                edges = [0, *np.cumsum(parts).tolist()]
                blobs = [z.compress(data[_ranges(at[own[lo:hi]], count[lo:hi] + length - 1)].tobytes()) for lo, hi in zip(edges, edges[1:])]
                out.append((int(bucket[own[0]]), len(own), _pack(places.doc[mine], places.place[mine], count), parts.tolist(), [len(x) for x in blobs], b"".join(blobs)))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["bucket", "n", "places", "parts", "sizes", "bytes"])

    return texts.mapInArrow(run, "bucket long, n long, places binary, parts array<long>, sizes array<long>, bytes binary")


def _window_repeats(owned: DataFrame, length: int, buckets: int, homes: int) -> DataFrame:
    """Removed ranges, by the suffix array of each trigger bucket's dictionary."""

    @released
    def run(batches):
        held, bucket = [], None

        def repeats(k):
            """doc, place, length of the ranges of late windows in the bucket's part k."""
            cols, blobs = [], []
            for n, places, parts, sizes, raw in held:
                if parts[k]:
                    lo, at = sum(parts[:k]), sum(sizes[:k])
                    cols.append([c[lo : lo + parts[k]] for c in _unpack(places, n)])
                    blobs.append(zstandard.decompress(raw[at : at + sizes[k]]))
            doc, place, count = (np.concatenate(c) for c in zip(*cols))
            data = np.frombuffer(b"".join(blobs), np.uint8)
            del cols, blobs
            size = count + length - 1
            at = np.cumsum(size) - size
            windows = _ranges(at, count)
            of = np.repeat(np.arange(len(doc)), count)
            order, differs = corpus_order(data, at, at + size, windows, length)
            start = np.flatnonzero(differs)
            first = np.minimum.reduceat(doc[of[order]], start)[np.cumsum(differs) - 1]
            late = np.zeros(len(windows), dtype=bool)
            late[order] = first < doc[of[order]]
            # runs of removed windows within a phrase
            edge = late & ~np.concatenate([[False], late[:-1] & (of[1:] == of[:-1])])
            runs = np.flatnonzero(edge)
            number = np.cumsum(edge)[late]
            phrase = of[runs]
            return doc[phrase], place[phrase] + windows[runs] - at[phrase], np.bincount(number - 1)

        def done():
            found = [repeats(k) for k in range(PARTS) if any(parts[k] for _, _, parts, _, _ in held)]
            doc, place, count = (np.concatenate(c) for c in zip(*found))
            if len(doc):
                yield _batch(_home_rows(REMOVED, -1, doc, place, count, None, homes))

        for b in batches:
            for to, *row in zip(*(c.to_pylist() for c in b.columns)):
                if to != bucket and held:
                    yield from done()
                    held = []
                bucket = to
                held.append(row)
        if held:
            yield from done()

    return owned.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(run, _PACKED_TYPES)


def _cut(texts: DataFrame, length: int, as_text: bool) -> DataFrame:
    """doc_id, n_bytes, spans, kept, and the other columns of texts."""
    others = texts.columns[8:]
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(texts.schema[c] for c in others)])
    span = pa.list_(pa.list_(pa.int64()))

    @released
    def run(batches):
        for places, ids, raws, rest in _homes(batches, keyed=False):
            spans_of, kept = [], []
            for i, raw, up in zip(ids, raws, _place(raws)):
                spans = []
                if i is not None and len(raw) >= length:
                    s = places.of(i, int(up))
                    start = places.place[s] - up
                    if len(start):
                        reach = np.maximum.accumulate(start + places.count[s] + length - 1)
                        new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                        spans = np.stack([start[new], reach[np.append(new[1:] - 1, len(reach) - 1)]], axis=1).tolist()
                parts, at = [], 0
                for lo, hi in spans:
                    parts.append(raw[at:lo])
                    at = hi
                parts.append(raw[at:])
                spans_of.append(spans)
                kept.append(b"".join(parts).decode("utf-8", errors="ignore") if as_text else b"".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array(spans_of, span), pa.array(kept, pa.string() if as_text else pa.binary()), *rest], ["doc_id", "n_bytes", "spans", "kept", *others])

    return texts.mapInArrow(run, shape)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: bool = False, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs as [start, end)), kept (the other bytes; as_text: a string of them, without
    characters that are cut in half), for every row; with carry also row, a struct of all columns but the text."""
    seed = max(1, min(SEED_BYTES, length // 2))
    size = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = max(32, shuffle_partitions(df.sparkSession), size // BUCKET)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("row")] if carry else []))
    entries = _entries(rows.where("doc_id is not null").select("doc_id", "text"), length, seed, buckets, buckets)
    known = materialize(_dictionary(entries, buckets, buckets))
    owned = _owned_bytes(_with_homes(rows.select("doc_id", "text"), known.where(F.col("kind") == OPEN), buckets), length)
    more = _window_repeats(owned, length, buckets, buckets)
    removed = known.where(F.col("kind") == REMOVED).unionByName(more)
    return _cut(_with_homes(rows, removed, buckets), length, as_text)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

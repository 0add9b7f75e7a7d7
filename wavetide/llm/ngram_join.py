"""N-gram Jaccard join with count-vector R-trees.

A text's word shingles are hashed into groups; the numbers of its shingles in each group are its point. For two sets
the summed minima of their coordinates bound the overlap, so in an R-tree the summed minima of a node's largest
coordinates bound every pair below it, and pairs or nodes that can't reach the asked similarity are skipped. What
survives is verified on the shingle sets.

One tree over a corpus can't be split over machines, so there is a forest: each set lies in cells that any similar set
must share. For sets of at most a given summed size, similarity t leaves at most d = (1-t)/(1+t) * (|A|+|B|) shingles
outside the overlap. The hash space is cut into more than d ranges, so at least one range holds the same shingles of
both; a range's cell is named by a hash of its shingles. Empty ranges have no cells: of sets with at most d non-empty
ranges the only range in common may be an empty one, so each of the first |A| - o + 1 shingles of such a set names a cell,
too (o being the least overlap of a link): linked sets of this kind share one of these.
Size classes grow so that similar sets lie in the same class or in neighbouring ones; a set names cells for its own
class and for the one below.

1. Cells are gathered by hash; each member belongs to the cell's smallest member, its hub. Chunks of a task combine first,
   so that a cell shared by any number of texts brings one entry a chunk.
2. Each text is verified with the hub that shares most cells with it (a star, not all pairs), if the bound allows a link,
   and links are joined into components.
3. Two sets that share a cell lie in the group of one hub, and linked hubs are one. In groups whose members aren't all in one component, an R-tree
   join over the count vectors marks the members that may be linked with a member of another component. Only their sets
   are exchanged; the same join then verifies its pairs where they are found and returns a spanning forest of the links.
   Both joins run on blocks of members, so a group of any size is split; blocks of a group's main component don't meet
   each other.

Step 3 leaves out only pairs that are connected already, so the components are those of all links. What a task returns
grows with its members, not with their pairs. Sets are compared by 64-bit hashes of shingles; bytes of texts aren't
compared again.

Defined results: null text is empty; empty sets link with nothing and are their own component; equal sets link; a null
id is kept, as a row of its own without links; repeated ids are one node; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, released, shuffle_partitions, table
from .graph import components
from .shingles import mix, shingle_sets

GROUPS = 256
#: Bytes of text that a chunk of the shingle pass holds.
CHUNK = 1 << 20
#: Members of a block in an R-tree join, and rows of a hub's part when verifying.
BLOCK = 2048
#: Shingles of a block, about.
WEIGHT = 1 << 20
#: Shingles that one bucket of cells is made for.
BUCKET = 1 << 21
NODE = 16
#: Pairs of nodes or points that are bounded at once.
FRONTIER = 1 << 14


class Threshold:
    """Similarity of at least num/den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.classes = [1]
        while self.classes[-1] < 1 << 40:
            s = self.classes[-1]
            self.classes.append(max(s + 1, den * (s - 1) // num + 1))
        self.starts = np.array(self.classes)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def apart(self, total: int) -> int:
        """Shingles outside the overlap of two linked sets of so many in all, at most."""
        return (self.den - self.num) * total // (self.den + self.num)

    def overlap_of(self, total):
        """Least overlap of linked sets of so many shingles in all."""
        return -((-self.num * total) // (self.den + self.num))

    def cells(self, u: np.ndarray) -> np.ndarray:
        """Names of the cells of a sorted set."""
        c = self.size_class(len(u))
        scrambled = np.concatenate([[np.uint64(0)], np.cumsum(mix(u))])
        high = u >> np.uint64(32)
        out = []
        for level in (c, c - 1):
            if level < 0:
                continue
            d = self.apart(self.classes[level + 1] + self.classes[level + 2] - 2)
            ranges = d + 1 + (max(1, d // 16) if d > 2 else 0)
            of = ((high * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(of, np.arange(ranges + 1))
            name = scrambled[ends[1:]] - scrambled[ends[:-1]]
            full = ends[1:] > ends[:-1]
            salt = mix(np.arange(ranges, dtype=np.uint64) + np.uint64((level + 1) << 40))
            name = mix(name + salt)
            out.append(name[full])
            if np.count_nonzero(full) <= d:  # else a range with the same shingles of both is never an empty one
                least = self.overlap_of(len(u) + -(-self.num * len(u) // self.den))
                out.append(mix(mix(u[: len(u) - least + 1]) + mix(np.array([~np.uint64(level)]))))
        return np.concatenate(out)


def count_vector(u: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((u >> np.uint64(3)).astype(np.int64) % groups, minlength=groups)


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte for each group, or four where a count needs them."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4").tobytes()


def unpack_counts(packed: list[bytes], groups: int = GROUPS) -> np.ndarray:
    if all(len(x) == groups for x in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), groups).astype(np.int16)
    return np.array([np.frombuffer(x, np.uint8 if len(x) == groups else "<u4") for x in packed], dtype=np.int64)


# R-tree over count vectors


class RTree:
    """Packed R-tree of points that have a label (at least 0) each: sorted by label, size and largest groups; a node holds
    its points' largest coordinates, their least and largest size, and their label where they have the same one (else -1)."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, node: int = NODE):
        sizes = points.sum(axis=1)
        self.order = np.lexsort((points[:, 1 % points.shape[1]], points[:, 0], sizes, labels))
        self.points, self.sizes, labels = points[self.order], sizes[self.order], labels[self.order]
        self.levels = [(np.arange(len(points) + 1), self.points, self.sizes, self.sizes, labels)]
        while len(self.levels[-1][1]) > 1:
            _, top, low, high, label = self.levels[-1]
            first = np.arange(0, len(top), node)
            same = np.maximum.reduceat(label, first) == np.minimum.reduceat(label, first)
            self.levels.append((np.append(first, len(top)), np.maximum.reduceat(top, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.where(same, label[first], -1)))


def tree_pairs(left: RTree, right: RTree, t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points (original numbers) of different labels that may be linked, both trees descended side by side."""
    depth = max(len(left.levels), len(right.levels))
    stack = [(depth - 1, np.array([0]), np.array([0]))] if len(left.points) and len(right.points) else []
    while stack:
        level, a, b = stack.pop()
        if len(a) > FRONTIER:
            stack += [(level, a[k : k + FRONTIER], b[k : k + FRONTIER]) for k in range(0, len(a), FRONTIER)]
            continue
        la, lb = min(level, len(left.levels) - 1), min(level, len(right.levels) - 1)
        _, top_a, low_a, high_a, label_a = left.levels[la]
        _, top_b, low_b, high_b, label_b = right.levels[lb]
        ok = (label_a[a] != label_b[b]) | (label_a[a] < 0)
        ok &= (t.num * low_a[a] <= t.den * high_b[b]) & (t.num * low_b[b] <= t.den * high_a[a])
        a, b = a[ok], b[ok]
        ok = np.minimum(top_a[a], top_b[b]).sum(axis=1) >= t.overlap_of(low_a[a] + low_b[b])
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if level == 0:
            yield left.order[a], right.order[b]
            continue
        if la == level:
            child = left.levels[level][0]
            n = child[a + 1] - child[a]
            b, a = np.repeat(b, n), _ranges(child[a], n)
        if lb == level:
            child = right.levels[level][0]
            n = child[b + 1] - child[b]
            a, b = np.repeat(a, n), _ranges(child[b], n)
        if left is right:
            ok = a <= b if level > 1 else a < b
            a, b = a[ok], b[ok]
        stack.append((level - 1, a, b))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after another."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


class Overlaps:
    """Sizes of intersections of sorted sets, by bit rows over the shingles that more than one set has."""

    COLUMNS = 1 << 16

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        every, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        keep = count[index] > 1
        self.rows, owner, column = [], owner[keep], column[index[keep]]
        for lo in range(0, int(column.max(initial=-1)) + 1, self.COLUMNS):
            part = (column >= lo) & (column < lo + self.COLUMNS)
            width = min(self.COLUMNS, int(column.max()) + 1 - lo)
            bits = np.zeros((len(sets), -(-width // 64)), dtype=np.uint64)
            at = column[part] - lo
            np.bitwise_or.at(bits.reshape(-1), owner[part] * bits.shape[1] + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            self.rows.append(bits)

    def linked(self, a: np.ndarray, b: np.ndarray, t: Threshold) -> np.ndarray:
        both = np.zeros(len(a), dtype=np.int64)
        for bits in self.rows:
            step = max(1, (4 << 20) // (8 * bits.shape[1]))
            for k in range(0, len(a), step):
                both[k : k + step] += np.bitwise_count(bits[a[k : k + step]] & bits[b[k : k + step]]).sum(axis=1, dtype=np.int64)
        return t.den * both >= t.num * (self.sizes[a] + self.sizes[b] - both)


# passes over the texts


def _chunks(batches, size: int = CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = t.encode() if t else b""
            if held + len(raw) > size and ids:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(raw)
            held += len(raw)
    if ids:
        yield ids, texts


def _features(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, n, set1 and set2 (a 128-bit name of the set), counts (its point)."""

    @released
    def run(batches):
        for ids, texts in _chunks(batches):
            sets = shingle_sets(texts, k)
            names = [(int(s.sum().astype(np.int64)), int(mix(s ^ np.uint64(77)).sum().astype(np.int64))) if len(s) else (0, 0) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array([pack_counts(count_vector(s)) for s in sets], pa.binary())],
                ["doc_id", "n", "set1", "set2", "counts"],
            )

    return rows.mapInArrow(run, "doc_id long, n long, set1 long, set2 long, counts binary")


def _stars(rows: DataFrame, k: int, t: Threshold, buckets: int) -> DataFrame:
    """kind, a, b, n, docs. Kind 0: the members docs (packed) of cells whose smallest member in chunk b is a. Kind 1: the
    smallest member a of n cells, and b, the smallest one in a chunk. Kind 2: of the a of kind 0, the one that shares most
    cells with b."""

    @released
    def name(batches):
        task = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_chunks(batches)):
            known, keys, docs = {}, [], []
            for i, s in sorted((x for x in zip(ids, shingle_sets(texts, k)) if x[0] is not None), key=lambda x: x[0]):
                if len(s) and known.setdefault(s.tobytes(), i) == i:  # equal sets are linked by name elsewhere
                    cells = t.cells(s)
                    keys.append(cells)
                    docs.append(np.full(len(cells), i, dtype=np.int64))
            if not keys:
                continue
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            low = doc[np.flatnonzero(head)[np.cumsum(head) - 1]]
            tail = ~head & (doc != low)
            out = []
            if tail.any():
                a, b, n = _unique(low[tail], doc[tail])
                order = np.lexsort((a, -n, b))
                most = order[np.concatenate([[True], b[order[1:]] != b[order[:-1]]])]
                out = [(0, (task << 32) + number, a, b), (2, (task << 32) + number, a[most], b[most])]
            key, doc = key[head], doc[head]
            to = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                out.append((1, int(to[part[0]]), key[part], doc[part]))
            # a chunk's own pairs go to any task: they only pass through
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), *(pa.array([np.ascontiguousarray(x[c]).tobytes() for x in out], pa.binary()) for c in (2, 3))],
                ["kind", "bucket", "keys", "docs"],
            )

    def rows_of(kind, a, b, n=None, docs=None):
        none = [None] * len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(none if n is None else n, pa.int64()), pa.array(docs or none, pa.binary())], ["kind", "a", "b", "n", "docs"])

    @released
    def gather(batches):
        held, bucket = [], None

        def done():
            key = np.concatenate([np.frombuffer(x[0], np.uint64) for x in held])
            doc = np.concatenate([np.frombuffer(x[1], np.int64) for x in held])
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            low = doc[np.flatnonzero(head)[np.cumsum(head) - 1]]
            return rows_of(1, *_unique(low[doc != low], doc[doc != low]))

        for b in batches:
            for kind, to, keys, docs in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:  # to is the chunk
                    low, doc = np.frombuffer(keys, np.int64), np.frombuffer(docs, np.int64)
                    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                    yield rows_of(0, low[start], np.full(len(start), to), docs=[d.tobytes() for d in np.split(doc, start[1:])])
                    continue
                if kind == 2:
                    yield rows_of(2, np.frombuffer(keys, np.int64), np.frombuffer(docs, np.int64))
                    continue
                if to != bucket and held:
                    yield done()
                    held = []
                bucket = to
                held.append((keys, docs))
        if held:
            yield done()

    packed = rows.mapInArrow(name, "kind long, bucket long, keys binary, docs binary")
    packed = packed.repartition(buckets, "bucket").sortWithinPartitions("kind", "bucket")
    return packed.mapInArrow(gather, "kind long, a long, b long, n long, docs binary")


def _members(packed: DataFrame) -> DataFrame:
    """Distinct pairs (hub, doc_id) of sorted rows (hub, chunk, docs), for each chunk."""

    @released
    def unpack(batches):
        key, held = None, []

        def pairs():
            docs = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), key[0]), pa.int64()), pa.array(docs, pa.int64())], ["hub", "doc_id"])

        for b in batches:
            for hub, chunk, docs in zip(*(c.to_pylist() for c in b.columns)):
                if (hub, chunk) != key:
                    if held:
                        yield pairs()
                    key, held = (hub, chunk), []
                held.append(np.frombuffer(docs, np.int64))
        if held:
            yield pairs()

    return packed.mapInArrow(unpack, "hub long, doc_id long")


def _unique(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, and how often each is there."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], np.diff(np.append(np.flatnonzero(new), len(a)))


def _within_bound(pairs: DataFrame, features: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (a, b) whose count vectors allow a link, with their sizes."""
    side = features.select("doc_id", "n", "counts")
    joined = pairs.join(side.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca")), "a")
    joined = joined.where("na is not null").join(side.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb")), "b")
    joined = joined.where(f"{t.num} * na <= {t.den} * nb and {t.num} * nb <= {t.den} * na").select("a", "b", "na", "nb", "ca", "cb")

    @released
    def bound(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (unpack_counts(b.column(c).to_pylist()) for c in (4, 5))
            total = np.asarray(b.column(2)) + np.asarray(b.column(3))
            yield b.filter(pa.array(np.minimum(x, y).sum(axis=1) >= t.overlap_of(total))).select([0, 1, 2, 3])

    return joined.mapInArrow(bound, "a long, b long, na long, nb long")


def _dealt(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The sets of texts at the places that ask for them. asked: doc_id, place (a struct of longs; no two are equal).

    Result: the fields of place, doc_id, raw. Texts move once, whatever the number of places."""
    asked = asked.groupBy("doc_id").agg(F.collect_list("place").alias("asked"))
    fields = asked.schema["asked"].dataType.elementType.names
    # no switch to a broadcast of a list that grows with the corpus
    texts = rows.where("doc_id is not null").join(asked.hint("merge"), "doc_id").select("doc_id", "text", "asked")

    @released
    def sets(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                made = shingle_sets([(x or "").encode() for x in part.column(1).to_pylist()], k)
                where = part.column(2)
                count = np.diff(where.offsets.to_numpy())
                flat = where.flatten()
                raws = pa.array([s.tobytes() for s in made], pa.binary()).take(pa.array(np.repeat(np.arange(len(made)), count)))
                yield pa.RecordBatch.from_arrays([*flat.flatten(), part.column(0).take(pa.array(np.repeat(np.arange(len(made)), count))), raws], [*fields, "doc_id", "raw"])

    return texts.mapInArrow(sets, ", ".join(f"{c} long" for c in [*fields, "doc_id"]) + ", raw binary")


def _verified(pairs: DataFrame, rows: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Those of pairs (a, b) that are linked: each a (hub) meets the sets of its b, split into parts of bounded size."""
    load = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("long").alias("parts"))
    spread = pairs.join(load, "a").select("a", "b", F.expr("pmod(xxhash64(b), parts)").alias("part"))
    place = lambda own, part: F.struct(F.col("a").alias("hub"), part.alias("part"), F.lit(own).cast("long").alias("own")).alias("place")
    hubs = load.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    asked = spread.select(F.col("b").alias("doc_id"), place(1, F.col("part"))).unionByName(hubs.select("doc_id", place(0, F.col("part"))))

    @released
    def verify(batches):
        hub, base = None, None
        for b in batches:
            a, c = [], []
            for h, p, own, i, raw in zip(*(x.to_pylist() for x in b.columns)):
                s = np.frombuffer(raw, np.uint64)
                if own == 0:
                    hub, base = (h, p), s
                    continue
                at = np.searchsorted(base, s)
                both = int(np.count_nonzero(base[np.minimum(at, len(base) - 1)] == s)) if len(base) else 0
                if (h, p) == hub and t.den * both >= t.num * (len(base) + len(s) - both):
                    a.append(h)
                    c.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    dealt = _dealt(asked, rows, k).repartition("hub", "part").sortWithinPartitions("hub", "part", "own")
    return dealt.mapInArrow(verify, "a long, b long")


def _pairs(stars: DataFrame) -> DataFrame:
    """Star pairs (a, b): each b with the hub that shares most cells with it, of its chunk and of all."""
    shared = stars.where("kind = 1").groupBy("b", "a").agg(F.sum("n").alias("n"))
    top = shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    return top.select("a", "b").unionByName(stars.where("kind = 2").select("a", "b"))


_SPOT = ["hub", "i", "j", "only"]


def _blocks(stars: DataFrame, found: DataFrame, features: DataFrame) -> DataFrame:
    """Members of the hubs' groups at the block pairs where they meet others: hub, i, j, only, side, doc_id, component, counts.

    Hubs of one component are one. A group's most frequent component has blocks i, its other members have blocks j; a block i meets each j, and blocks j
    meet one another (only: without a block i; else one block j is with itself, too, where i is 0)."""
    of = found.select(F.col("id").alias("low"), F.col("component").alias("own"))
    named = lambda df: df.join(of, "low", "left").withColumn("hub", F.coalesce("own", "low")).drop("own")
    top = named(stars.where("kind = 1").select(F.col("a").alias("low"), "b"))
    chunk = named(stars.where("kind = 0").select(F.col("a").alias("low"), F.col("b").alias("chunk"), "docs"))
    # a chunk's member belongs to the hubs of its chunk's smallest member, too
    through = top.select("hub", F.col("b").alias("low")).distinct().join(chunk.drop("hub"), "low")
    packed = through.select("hub", "chunk", "docs").unionByName(chunk.select("hub", "chunk", "docs"))
    own = top.select("hub", F.col("b").alias("doc_id")).unionByName(top.unionByName(chunk, allowMissingColumns=True).select("hub", F.col("low").alias("doc_id")))
    member = _members(packed.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk")).unionByName(own).distinct()
    member = member.join(features.select("doc_id", "n", "counts"), "doc_id").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    member = materialize(member.withColumn("component", F.coalesce("component", "doc_id")))
    unit = member.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    group = unit.groupBy("hub").agg(F.max(F.struct("size", "component", "weight")).alias("main"), F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    group = group.where("size > main.size").select(
        "hub",
        F.col("main.component").alias("main"),
        F.expr(f"div(main.size, {BLOCK}) + div(main.weight, {WEIGHT}) + 1").alias("wide"),
        F.expr(f"div(size - main.size, {BLOCK}) + div(weight - main.weight, {WEIGHT}) + 1").alias("high"),
    )
    m = member.join(group, "hub").withColumn("side", (F.col("component") != F.col("main")).cast("long"))
    m = m.withColumn("block", F.expr("pmod(xxhash64(doc_id), if(side = 0, wide, high))"))
    meets = F.expr("""if(side = 0, transform(sequence(0L, high - 1), x -> struct(block as i, x as j, 0L as only)),
        concat(transform(sequence(0L, wide - 1), x -> struct(x as i, block as j, 0L as only)),
         transform(filter(sequence(0L, high - 1), x -> x != block), x -> struct(least(x, block) as i, greatest(x, block) as j, 1L as only))))""")
    return m.withColumn("at", F.explode(meets)).select("hub", "at.i", "at.j", "at.only", "side", "block", "doc_id", "component", "counts")


class _Meeting:
    """The members of one block pair, and the pairs of different components that their R-trees can't rule out."""

    def __init__(self, spot, rows):
        self.spot = spot
        self.side, self.block, self.doc, self.component = (np.array(x, dtype=np.int64) for x in list(zip(*rows))[:4])
        self.label = np.unique(self.component, return_inverse=True)[1]
        self.points = unpack_counts([r[4] for r in rows])

    def pairs(self, t: Threshold):
        _, i, j, only = self.spot
        parts = [np.flatnonzero(self.block == x) for x in (i, j)] if only else [np.flatnonzero(self.side == x) for x in (0, 1)]
        trees = [RTree(self.points[p], self.label[p]) if len(p) else None for p in parts]
        meets = [(0, 1)] if only or i else [(0, 1), (1, 1)]
        for x, y in meets:
            if trees[x] and trees[y]:
                for a, b in tree_pairs(trees[x], trees[y], t):
                    yield parts[x][a], parts[y][b]


def _meetings(batches, width: int):
    """(spot, rows) of sorted batches."""
    spot, rows = None, []
    for b in batches:
        for *at, row in zip(*(c.to_pylist() for c in b.columns[:4]), zip(*(c.to_pylist() for c in b.columns[4 : 4 + width]))):
            if at != spot:
                if len(rows) > 1:
                    yield spot, rows
                spot, rows = at, []
            rows.append(row)
    if len(rows) > 1:
        yield spot, rows


def _near_others(blocks: DataFrame, t: Threshold) -> DataFrame:
    """Members that the count vectors let be linked with a member of another component: doc_id, place."""

    @released
    def bound(batches):
        for spot, rows in _meetings(batches, 5):
            meeting = _Meeting(spot, rows)
            near = np.zeros(len(rows), dtype=bool)
            for a, b in meeting.pairs(t):
                near[a] = near[b] = True
            at = np.flatnonzero(near)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x), pa.int64()) for x in spot] + [pa.array(x[at], pa.int64()) for x in (meeting.side, meeting.block, meeting.component, meeting.doc)], [*_SPOT, "side", "block", "component", "doc_id"])

    dealt = blocks.select(*_SPOT, "side", "block", "doc_id", "component", "counts").repartition(*_SPOT).sortWithinPartitions(*_SPOT)
    near = dealt.mapInArrow(bound, ", ".join(f"{c} long" for c in [*_SPOT, "side", "block", "component", "doc_id"]))
    return near.select("doc_id", F.struct(*_SPOT, "side", "block", "component").alias("place"))


def _forest(near: DataFrame, rows: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Links (a, b) that join the components of each block pair."""

    @released
    def join(batches):
        for spot, held in _meetings(batches, 5):
            sets = [np.frombuffer(h[4], np.uint64) for h in held]
            meeting = _Meeting(spot, [(side, block, doc, component, pack_counts(count_vector(s))) for (side, block, component, doc, _), s in zip(held, sets)])
            overlaps = Overlaps(sets)
            root = np.arange(meeting.label.max() + 1)
            links = []
            for a, b in meeting.pairs(t):
                open_ = root[meeting.label[a]] != root[meeting.label[b]]
                a, b = a[open_], b[open_]
                ok = overlaps.linked(a, b, t)
                for x, y in zip(a[ok].tolist(), b[ok].tolist()):
                    cx, cy = root[meeting.label[[x, y]]]
                    if cx != cy:
                        root[root == cy] = cx
                        links.append((int(meeting.doc[x]), int(meeting.doc[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    dealt = _dealt(near, rows, k).repartition(*_SPOT).sortWithinPartitions(*_SPOT)
    return dealt.select(*_SPOT, "side", "block", "component", "doc_id", "raw").mapInArrow(join, "a long, b long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, for every row; links are pairs with Jaccard similarity of at least num/den.

    Rows of one id are one node that has the links of all of them."""
    t = Threshold(num, den)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = materialize(_features(rows, k))
    known = features.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _row_components(rows, features, k, t)
    # rows are linked by a number of their own, ids by the links of their rows
    rows = materialize(rows.where("doc_id is not null").select("doc_id", F.monotonically_increasing_id().alias("no"), "text"))
    numbered, ids = rows.select(F.col("no").alias("doc_id"), "text"), rows.select("no", "doc_id")
    linked = materialize(_row_components(numbered, materialize(_features(numbered, k)), k, t).withColumnRenamed("doc_id", "no"))
    of_row = linked.where("no <> component_id").join(ids, "no").join(ids.select(F.col("no").alias("component_id"), F.col("doc_id").alias("other")), "component_id")
    found = components(of_row, "doc_id", "other")
    every = linked.join(ids, "no").select("doc_id", "n_shingles").unionByName(features.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles")))
    return every.join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _row_components(rows: DataFrame, features: DataFrame, k: int, t: Threshold) -> DataFrame:
    """jaccard_components of rows of which no two have one id."""
    spark = rows.sparkSession
    shingles = features.agg(F.sum("n")).first()[0] or 0
    stars = materialize(_stars(rows, k, t, max(32, 2 * shuffle_partitions(spark), shingles // BUCKET)))

    named = features.where("n > 0 and doc_id is not null")
    first = named.groupBy("set1", "set2").agg(F.min("doc_id").alias("a"))
    equal = named.join(first, ["set1", "set2"]).where("doc_id != a").select("a", F.col("doc_id").alias("b"))

    near = materialize(_within_bound(_pairs(stars), named, t))
    links = materialize(_verified(near, rows, k, t).unionByName(equal))
    found = materialize(components(links))

    others = materialize(_near_others(_blocks(stars, found, named), t))
    if not others.isEmpty():
        found = materialize(components(links.unionByName(materialize(_forest(others, rows, k, t)))))
    return features.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))

"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents are encoded, closed with an end id and, if longer than a sequence, cut into whole sequences behind a shorter
first piece. Packing depends on piece lengths only, of which there are at most ``capacity``: the histogram of lengths
(counts over all rows, at most ``capacity`` numbers) goes to the driver, where bins of equal content form a class with
a multiplicity. Best-fit decreasing makes the first classes. A local search then works on the underfull ones: it moves
a piece, exchanges one for one, or two for one, whenever that increases the summed squared fill, for as many copies as
both classes have, until no sequence can be spared or a sweep over all pairs of classes finds no exchange. The number of
classes follows the number of lengths, not the number of rows, so one global packing serves any number of documents.

Back on the executors, the rows of a length are numbered over all partitions (counts per partition and length, then
running sums), and the number says which bin and offset a row gets. A length with a third of all rows is dealt like
any other, since numbering is done within partitions.

Defined results: null text is empty (one piece holding the end id); repeated rows are packed as rows of their own;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, default_path
from .common import materialize, released, table

CAPACITY = 1024
END_ID = 2


# packing a histogram


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Counter:
    """Classes (lengths of a bin, descending) with their multiplicity."""
    by_free: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for free in range(length, capacity):
            while left and by_free[free]:
                bin_, copies = next(iter(by_free[free].items()))
                each = min(free // length, left)
                used = min(copies, left // each)
                by_free[free][bin_] -= used
                if not by_free[free][bin_]:
                    del by_free[free][bin_]
                by_free[free - each * length][bin_ + (length,) * each] += used
                left -= used * each
            if not left:
                break
        each = capacity // length
        if left >= each:
            by_free[capacity - each * length][(length,) * each] += left // each
            left %= each
        if left:
            by_free[capacity - left * length][(length,) * left] += 1
    out: Counter = Counter()
    for classes in by_free.values():
        out.update(classes)
    return out


class _Offer:
    """What a bin can give: sums of one and of two of its pieces, as sets and as bits of an integer, upwards and (from
    capacity) downwards."""

    def __init__(self, bin_: tuple, capacity: int):
        self.ones = sorted(set(bin_))
        self.twos = {x + y: (x, y) for x, y in [*combinations(self.ones, 2), *((x, x) for x, n in Counter(bin_).items() if n > 1)]}
        self.up_one, self.up_two = sum(1 << x for x in self.ones), sum(1 << x for x in self.twos)
        self.down_one, self.down_two = sum(1 << capacity - x for x in self.ones), sum(1 << capacity - x for x in self.twos)


_offer = lru_cache(maxsize=8192)(_Offer)


def _pieces(a: _Offer, b: _Offer, moved: int) -> tuple[tuple, tuple]:
    """Pieces of a and of b whose exchange brings so much more to b: a move, one for one, or two for one, either way."""
    if moved in a.ones:
        return (moved,), ()
    if -moved in b.ones:
        return (), (-moved,)
    for x in b.ones:
        if moved + x in a.ones:
            return (moved + x,), (x,)
        if moved + x in a.twos:
            return a.twos[moved + x], (x,)
    return next(((x,), b.twos[x - moved]) for x in a.ones if x - moved in b.twos)


def _exchange(a: tuple, b: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """The exchange between an emptier bin a and a fuller bin b that increases squared fill most, if any."""
    gap = sum(b) - sum(a)
    room_a, room_b = capacity - sum(a), capacity - sum(b)
    x, y = _offer(a, capacity), _offer(b, capacity)
    # bit capacity + m: some exchange brings m more to b
    reach, up = x.up_one << capacity | y.down_one, (x.up_one | x.up_two) << capacity
    for piece in y.ones:
        reach |= up >> piece
    for piece in x.ones:
        reach |= y.down_two << piece
    most = (reach >> capacity + 1 & (1 << room_b) - 1).bit_length()
    back = reach >> capacity - room_a & (1 << room_a) - 1
    least = (back & -back).bit_length() - 1 - room_a if back else 0  # more than the gap leaves b: the bins change places
    best = max(most, least, key=lambda m: m * (m + gap))
    if best * (best + gap) <= 0:
        return None
    best = _pieces(x, y, best)
    new_a, new_b = Counter(a), Counter(b)
    new_a.subtract(best[0])
    new_a.update(best[1])
    new_b.subtract(best[1])
    new_b.update(best[0])
    return tuple(sorted(new_a.elements(), reverse=True)), tuple(sorted(new_b.elements(), reverse=True))


def local_search(classes: Counter, capacity: int) -> Counter:
    """Exchange pieces between underfull bins until no bin can be spared or a sweep over all their pairs finds nothing.

    Each exchange increases the summed squared fill, so the search ends."""
    classes = Counter(classes)
    total = sum(sum(b) * n for b, n in classes.items())
    barren: set = set()  # pairs without an exchange, which depends on their pieces only
    while sum(classes.values()) > -(-total // capacity):
        under = sorted((b for b in classes if sum(b) < capacity), key=sum)
        changed = False
        for i, a in enumerate(under):
            for b in reversed(under[i:]):
                n = min(classes[a], classes[b]) if a != b else classes[a] // 2
                if not n or (a, b) in barren:
                    continue
                if not (found := _exchange(a, b, capacity)):
                    barren.add((a, b))
                    continue
                for old in (a, b):
                    classes[old] -= n
                for new in found:
                    if new:
                        classes[new] += n
                changed = True
                if not classes[a]:
                    break
        classes = +classes
        if not changed:
            break
        barren = {pair for pair in barren if pair[0] in classes and pair[1] in classes}
    return classes


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first numbers of its runs of rows, the sequence of each run's first row, and the offset."""
    classes = local_search(best_fit_decreasing(histogram, capacity), capacity)
    runs = defaultdict(lambda: ([], [], []))
    given: Counter = Counter()
    sequence = 0
    for bin_, copies in sorted(classes.items(), reverse=True):
        offset = 0
        for length in bin_:
            starts, sequences, offsets = runs[length]
            starts.append(given[length])
            sequences.append(sequence)
            offsets.append(offset)
            given[length] += copies
            offset += length
        sequence += copies
    return {k: tuple(np.array(x, dtype=np.int64) for x in v) for k, v in runs.items()}


# rows


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids; the first may be shorter, the others are full."""
    first = n - (max(0, n - 1) // capacity) * capacity
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the task that made the row)."""
    path = path or default_path()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @released
    def run(batches):
        c = codec(path)
        for b in batches:
            out = [[], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(c.encode(text), np.uint32(end_id)).astype("<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    for col, x in zip(out, (i, k, at, n, zlib.crc32(ids[at : at + n]))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    made = rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("part", F.spark_partition_id())


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to materialised pieces (length between 1 and capacity, part)."""
    counts = materialize(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = rows.sparkSession.sparkContext.broadcast(pack_histogram(histogram, capacity))  # size follows capacity, not rows
    before = Window.partitionBy("length").orderBy("part")
    first = counts.select("length", "part", (F.sum("n").over(before) - F.col("n")).alias("first"))
    # all starts of a part travel as one row, so that numbering needs no rows of a length together
    first = first.groupBy("part").agg(F.collect_list(F.struct("length", "first")).alias("firsts"))
    columns = [c for c in rows.columns if c != "part"]
    shape = rows.select(*columns).schema.add("sequence_id", "long").add("offset", "long")
    grouped = rows.withColumn("is_first", F.lit(1)).select("part", "is_first", F.lit(None).cast("array<struct<length:bigint,first:bigint>>").alias("firsts"), *columns)
    heads = first.select("part", F.lit(0).alias("is_first"), "firsts", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns))
    dealt = grouped.unionByName(heads).repartition("part").sortWithinPartitions("part", "is_first", "length", "doc_id", "piece", "ids_crc32")

    @released
    def number(batches):
        at: dict[int, int] = {}
        known = plan.value
        for b in batches:
            part_first, firsts = np.asarray(b.column(1)), b.column(2)
            lengths = b.column(columns.index("length") + 3).to_pylist()
            seq, off, keep = [], [], []
            for k, is_row in enumerate(part_first):
                if not is_row:
                    at = {x["length"]: x["first"] for x in firsts[k].as_py()}
                    continue
                length = lengths[k]
                starts, sequences, offsets = known[length]
                r = at[length]
                at[length] = r + 1
                j = int(np.searchsorted(starts, r, side="right")) - 1
                seq.append(int(sequences[j]) + r - int(starts[j]))
                off.append(int(offsets[j]))
                keep.append(k)
            kept = b.take(pa.array(keep, pa.int64())) if len(keep) < b.num_rows else b
            yield pa.RecordBatch.from_arrays([*kept.columns[3:], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*columns, "sequence_id", "offset"])

    return dealt.mapInArrow(number, shape)


def best_fit_pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces(df, id_col, text_col, path, capacity, end_id)), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))

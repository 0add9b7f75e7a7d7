"""Embedding near-duplicates by an epsilon grid order join.

Vectors of unit length are at a cosine of at least c exactly when their distance is at most eps = sqrt(2 - 2c). They
are turned to the principal axes of all vectors (a rotation, so distances stay; the moments are summed over all rows),
given cells of side eps on the leading axes, and sorted by cell. Intervals of that sequence become blocks with bounding
boxes over all axes. The join of the sequence with itself divides both intervals again and again (as joins of tables of
intervals) and skips two intervals whose boxes are more than eps apart; what is left are pairs of blocks, compared by a
matrix product in double precision.

Equal vectors are one class from the start, with its smallest id and its size, so any number of copies costs one
comparison. A pair of blocks returns the number of links of each class and a spanning forest of them, not the links, so
a group of near copies doesn't grow with its square. Only the moments come to the driver.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths don't link; repeated ids count as rows of their own, and a component
is named by the smallest id; a null id is a row without links; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, released, table
from .graph import components

COSINE = 0.9
#: Classes in a block and in a tile of it, and leading axes with grid cells.
BLOCK = 4096
TILE = 512
AXES = 6
#: Intervals of the sequence that make the next longer one.
FAN = 32


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(n, -1)


def _classes(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, class: a name or null), and the classes (class, dim, unit, rep, size)."""

    @released
    def run(batches):
        for b in batches:
            ends = b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py()
            flat, out = b.column(1).flatten().to_numpy(), []
            for lo, hi in zip(ends, ends[1:]):
                x = flat[lo:hi]
                top = np.abs(x).max(initial=0.0)
                if top:
                    x = x / top  # so that squares neither overflow nor vanish
                    out.append((x / np.sqrt(x @ x) + 0.0).astype("<f8").tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])

    finite = F.forall("v", lambda y: y.isNotNull() & (F.abs(y) < float("inf")))  # a NaN is larger than any number
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.select("vec_id", F.when(finite, F.col("v")).otherwise(F.array().cast("array<double>")).alias("v")).mapInArrow(run, "vec_id long, unit binary")
    rows = materialize(rows.withColumn("class", F.when(F.col("vec_id").isNotNull() & F.col("unit").isNotNull(), F.sha2("unit", 256))))
    classes = rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("unit").alias("unit"))
    return rows.select("vec_id", "class"), classes.withColumn("dim", F.expr("octet_length(unit) div 8"))


def _axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the classes' unit vectors, from moments summed over all of them."""

    @released
    def moments(batches):
        total = np.zeros((dim + 1, dim))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), b.num_rows)
                total[:dim] += x.T @ x
                total[dim] += x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    total, n = np.zeros((dim + 1, dim)), classes.count()
    parts = classes.select("unit").mapInArrow(moments, "m binary").coalesce(8)

    @released
    def add(batches):
        out = np.zeros((dim + 1, dim))
        for b in batches:
            for m in b.column(0).to_pylist():
                out += np.frombuffer(m).reshape(dim + 1, dim)
        yield pa.RecordBatch.from_pydict({"m": pa.array([out.tobytes()], pa.binary())})

    for r in parts.mapInArrow(add, "m binary").collect():
        total += np.frombuffer(r["m"]).reshape(dim + 1, dim)
    mean = total[dim] / max(1, n)
    _, axes = np.linalg.eigh(total[:dim] / max(1, n) - np.outer(mean, mean))
    return axes[:, ::-1]


def near_boxes(low1: np.ndarray, high1: np.ndarray, low2: np.ndarray, high2: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the boxes (rows) of both sides that are within eps of one another."""
    out = []
    for i in range(len(low1)):
        gap = np.maximum(0, np.maximum(low1[i] - high2, low2 - high1[i]))
        js = np.flatnonzero((gap * gap).sum(axis=1) <= eps * eps)
        out.append((np.full(len(js), i), js))
    return tuple(np.concatenate([o[c] for o in out]) for c in (0, 1))


def _intervals(nodes: DataFrame, parent: Column) -> DataFrame:
    """Nodes (node, low, high) by their parent interval: parent, nodes, lows and highs (packed), and the parent's box."""

    @released
    def run(batches):
        at, held = None, []

        def done():
            lows, highs = (np.array([np.frombuffer(h[k]) for h in held]) for k in (1, 2))
            raws = [np.array([h[0] for h in held], "<i8"), lows, highs, lows.min(axis=0), highs.max(axis=0)]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in raws)], ["parent", "nodes", "lows", "highs", "low", "high"])

        for b in batches:
            for up, *row in zip(*(c.to_pylist() for c in b.columns)):
                if up != at:
                    if held:
                        yield done()
                    at, held = up, []
                held.append(row)
        if held:
            yield done()

    rows = nodes.select(parent.alias("parent"), "node", "low", "high").repartition("parent").sortWithinPartitions("parent", "node")
    return materialize(rows.mapInArrow(run, "parent long, nodes binary, lows binary, highs binary, low binary, high binary"))


def _interval_pairs(blocks: DataFrame, partitions: int, eps: float) -> DataFrame:
    """Pairs (i <= j) of blocks whose boxes are within eps. Blocks of a partition are an interval of the sequence, FAN
    intervals in a row are a longer one; from the whole sequence downwards each pair of intervals is joined part by part,
    unless their boxes are too far apart."""
    levels = [_intervals(blocks.select(F.col("block").alias("node"), "low", "high"), F.shiftright("node", 32))]
    while partitions > 1:
        up = levels[-1].select(F.col("parent").alias("node"), "low", "high")
        levels.append(_intervals(up, F.expr(f"node div {FAN}")))
        partitions = -(-partitions // FAN)

    @released
    def expand(batches):
        for b in batches:
            for i, j, n1, l1, h1, n2, l2, h2 in zip(*(c.to_pylist() for c in b.columns)):
                n1, n2 = np.frombuffer(n1, "<i8"), np.frombuffer(n2, "<i8")
                boxes = [np.frombuffer(x).reshape(len(n), -1) for x, n in ((l1, n1), (h1, n1), (l2, n2), (h2, n2))]
                x, y = near_boxes(*boxes, eps)
                x, y = n1[x], n2[y]
                keep = (x <= y) | (i != j)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()), pa.array(y[keep], pa.int64())], ["i", "j"])

    side = lambda level, name, n: level.select(F.col("parent").alias(name), *(F.col(c).alias(c + n) for c in ("nodes", "lows", "highs")))
    pairs = blocks.sparkSession.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    for level in reversed(levels):
        both = pairs.join(side(level, "i", "1"), "i").join(side(level, "j", "2"), "j")
        both = both.select("i", "j", "nodes1", "lows1", "highs1", "nodes2", "lows2", "highs2")
        pairs = materialize(both.mapInArrow(expand, "i long, j long"))
    return pairs


def _forest(labels: np.ndarray, i: int, js: np.ndarray) -> list[int]:
    """Those of js that join a new part to i, one for each part; labels (of all nodes) are updated."""
    parts, first = np.unique(labels[js], return_index=True)
    new = parts != labels[i]
    if not new.any():
        return []
    labels[np.isin(labels, parts)] = labels[i]
    return js[first[new]].tolist()


def _compare(r1, s1, x, r2, s2, y, same: bool, axes: np.ndarray, cosine: float, eps: float):
    """Link counts of both sides' classes and a spanning forest of the links between two blocks.

    The blocks' sequences are halved further by their boxes, down to tiles that one matrix product compares.
    """
    tiles = [[slice(k, min(k + TILE, len(z))) for k in range(0, len(z), TILE)] for z in (x, y)]
    turned = [z @ axes for z in (x, y)]
    boxes = [np.array([[t[s].min(axis=0), t[s].max(axis=0)] for s in own]) for t, own in zip(turned, tiles)]
    counts = [np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)]
    labels, links = np.arange(len(x) + (0 if same else len(y))), []
    for a, left in enumerate(tiles[0]):
        for b, right in enumerate(tiles[1]):
            gap = np.maximum(0, np.maximum(boxes[0][a, 0] - boxes[1][b, 1], boxes[1][b, 0] - boxes[0][a, 1]))
            if same and b < a or gap @ gap > eps * eps:
                continue
            near = x[left] @ y[right].T >= cosine
            if same and a == b:
                np.fill_diagonal(near, False)
            for i in np.flatnonzero(near.any(axis=1)):
                js = np.flatnonzero(near[i]) + right.start
                i += left.start
                counts[0][i] += s2[js].sum()
                if not (same and a == b):
                    counts[1][js] += s1[i]
                links += [(int(r1[i]), int(r2[j if same else j - len(x)])) for j in _forest(labels, i, js if same else js + len(x))]
    if same:
        counts[0] += counts[1]
    return counts, links


def _joined(classes: DataFrame, dim: int, cosine: float, axes_used: int, block: int) -> DataFrame:
    """kind, a, b: kind 0: class rep a has b links to vectors of other classes; kind 1: a link between reps a and b."""
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    axes = _axes(classes, dim)

    @released
    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            turned = _matrix(b.column(2), b.num_rows) @ axes
            cells = np.floor(turned[:, :axes_used] / eps).astype(np.int64) + (1 << 20)
            order = [c.astype(">u4").tobytes() for c in cells]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.astype("<f8").tobytes() for x in turned], pa.binary()), pa.array(order, pa.binary())], ["rep", "size", "unit", "turned", "cell"])

    placed = classes.select("rep", "size", "unit").mapInArrow(place, "rep long, size long, unit binary, turned binary, cell binary")
    n = classes.count()
    partitions = max(1, -(-n // (4 * block)))
    placed = placed.repartitionByRange(partitions, "cell", "rep").sortWithinPartitions("cell", "rep")

    @released
    def blocks(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def done():
            nonlocal number
            reps, sizes, units, turned = ([x[k] for x in held] for k in range(4))
            t = np.frombuffer(b"".join(turned), "<f8").reshape(len(held), -1)
            number += 1
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "reps": pa.array([np.array(reps, "<i8").tobytes()], pa.binary()), "sizes": pa.array([np.array(sizes, "<i8").tobytes()], pa.binary()), "units": pa.array([b"".join(units)], pa.binary()), "low": pa.array([t.min(axis=0).tobytes()], pa.binary()), "high": pa.array([t.max(axis=0).tobytes()], pa.binary())})

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                held.append(row)
                if len(held) == block:
                    yield done()
                    held = []
        if held:
            yield done()

    made = materialize(placed.mapInArrow(blocks, "block long, reps binary, sizes binary, units binary, low binary, high binary"))
    pairs = _interval_pairs(made, partitions, eps).select(F.col("i").alias("block1"), F.col("j").alias("block2"))
    side = lambda s: made.select(*(F.col(c).alias(c + s) for c in ("block", "reps", "sizes", "units")))
    asked = pairs.repartition(max(1, pairs.count() // 4), "block1", "block2")
    both = asked.join(side("1"), "block1").join(side("2"), "block2").select("block1", "block2", "reps1", "sizes1", "units1", "reps2", "sizes2", "units2")

    @released
    def compare(batches):
        for b in batches:
            for k in range(b.num_rows):
                one, two, r1, s1, u1, r2, s2, u2 = (c[k].as_py() for c in b.columns)
                r1, s1, r2, s2 = (np.frombuffer(x, "<i8") for x in (r1, s1, r2, s2))
                x, y = (np.frombuffer(u, "<f8").reshape(len(r), -1) for u, r in ((u1, r1), (u2, r2)))
                counts, links = _compare(r1, s1, x, r2, s2, y, one == two, axes, cosine, eps)
                reps, found = r1[counts[0] > 0], counts[0][counts[0] > 0]
                if one != two:
                    reps, found = np.concatenate([reps, r2[counts[1] > 0]]), np.concatenate([found, counts[1][counts[1] > 0]])
                yield pa.RecordBatch.from_pydict({"kind": pa.array([0] * len(reps) + [1] * len(links), pa.int64()), "a": pa.array([*reps.tolist(), *(a for a, _ in links)], pa.int64()), "b": pa.array([*found.tolist(), *(b for _, b in links)], pa.int64())})

    return both.mapInArrow(compare, "kind long, a long, b long")


def cosine_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept, for every row."""
    spark = df.sparkSession
    rows, classes = _classes(df, id_col, vec_col)
    classes = materialize(classes)
    found = None
    for r in classes.select("dim").distinct().collect():
        part = _joined(classes.where(F.col("dim") == r["dim"]), int(r["dim"]), cosine, min(axes, int(r["dim"])), block)
        found = part if found is None else found.unionByName(part)
    found = materialize(found if found is not None else spark.createDataFrame([], "kind long, a long, b long"))
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    parts = components(found.where("kind = 1"))
    known = classes.select("class", "rep", "size").join(links, F.col("rep") == F.col("a"), "left").join(parts, F.col("rep") == F.col("id"), "left")
    known = known.select("class", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(known, "class", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_components(table(spark, sf_dir, "embeddings"))

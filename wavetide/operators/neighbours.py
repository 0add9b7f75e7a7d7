"""Exact nearest neighbours inside each signal, by cells around pivots.

Vectors belong to the cell of their nearest pivot, a vector of their signal. By the triangle inequality, vectors of two
cells are at least as far apart as their pivots, less both radii, and the vectors that lie nearest to the pivots bound the
k-th distance of a whole cell from above; cells that can't meet are left out. What meets does so in blocks: a block of one
side is held, blocks of the other pass by in the order of their bounds, and only the k best of each vector are kept. A cell
of any size is many blocks, and the blocks that one block meets are dealt to several tasks, so no task grows with a signal.

All distances of a signal (``distances``) come from blocks, too, one pair of blocks after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .signals import KEY

#: Vectors of a cell, about; most cells of a signal; vectors of a block; vectors of the other side that one task sees of a block.
CELL, CELLS, BLOCK, PART = 2048, 1024, 1024, 1 << 18
#: Distances that are worked on at once.
TILE = 1 << 15
#: Rounding of distances that a bound allows for, as a share.
SLACK = 1e-9


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, width or 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0.0)


class _Best:
    """The k nearest of the vectors of one block, over blocks of others that pass by."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, width: int, cosine: bool):
        self.ids, self.vectors, self.k, self.width, self.cosine = ids, vectors, k, width, cosine
        self.row, self.d, self.j = (np.empty(0, t) for t in (np.int64, float, np.int64))
        self.far = np.full(len(ids), np.inf)  # k-th Euclidean distance so far

    def meet(self, ids: np.ndarray, vectors: np.ndarray, least: float) -> None:
        if least > self.far.max() * (1 + SLACK) + SLACK:
            return
        near = _squares(self.vectors, vectors)
        scale = (self.vectors * self.vectors).sum(axis=1)[:, None] + (vectors * vectors).sum(axis=1)[None]
        error = 1e-13 * scale
        other = np.abs(self.ids[:, None] - ids[None]) >= self.width if self.width else None
        if other is not None:
            near[~other] = np.inf
        bound = np.minimum(self.far * self.far * (1 + SLACK), np.partition(near + error, self.k - 1, axis=1)[:, self.k - 1] if self.k < near.shape[1] else np.inf)
        row, col = np.nonzero((near - error <= bound[:, None]) & np.isfinite(near))
        gap = self.vectors[row] - vectors[col]
        d = np.sqrt((gap * gap).sum(axis=1))
        if self.cosine:
            d = np.clip(1.0 - (self.vectors[row] * vectors[col]).sum(axis=1), 0.0, 2.0)
        row, d, j = np.concatenate([self.row, row]), np.concatenate([self.d, d]), np.concatenate([self.j, ids[col]])
        order = np.lexsort((j, d, row))
        row, d, j = row[order], d[order], j[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.d, self.j = row[kept], d[kept], j[kept]
        full = place == self.k - 1
        self.far[row[full]] = np.sqrt(2 * d[full]) if self.cosine else d[full]


def nearest(a: DataFrame, b: DataFrame, k: int, metric: str = "euclidean", width: int = 0) -> DataFrame:
    """(signal_id, i, j, d): the k nearest frames of b (signal_id, j, w) for each frame of a (signal_id, i, v) of the same
    signal, ties to the smaller j. width: frames with |i - j| below it don't count.

    metric is euclidean or cosine (1 - cosine). Vectors that are null, empty or hold nulls or numbers that aren't finite have
    no neighbours and are none; nor do vectors without direction, for cosine. All vectors of a signal have one length.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        raise ValueError("k must be positive")
    cosine, want = metric == "cosine", k + max(0, 2 * width - 1)
    kind = a.schema[KEY].dataType.simpleString()
    fits = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    if cosine:
        unit = lambda v: F.transform(F.array(F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("size"))), lambda p: F.when(p["size"] > 0, F.transform(p["v"], lambda x: x / p["size"])))[0]
    else:
        unit = lambda v: v
    side = lambda df, s, number, v: df.select(KEY, F.lit(s).alias("side"), F.col(number).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v")).where(fits(F.col("v")) & F.col(KEY).isNotNull()).withColumn("v", unit(F.col("v"))).where("v is not null")
    both = side(a, 0, "i", "v").unionByName(side(b, 1, "j", "w"))

    # pivots: a share of the vectors of each signal, by the hash of their numbers
    sizes = both.groupBy(KEY).agg(F.sum("side").alias("n")).where("n > 0")
    sized = both.join(sizes, KEY)
    stride = f"greatest(1, div(n, least({CELLS}, greatest(1, div(n, {CELL})))))"
    chosen = F.when(F.expr(f"pmod(xxhash64(id, 11), {stride}) = 0 and {stride} < n"), F.col("v"))
    pivots = sized.where("side = 1").groupBy(KEY).agg(F.array_append(F.collect_list(chosen), F.min_by("v", F.xxhash64("id"))).alias("pivots"))
    pack = F.expr(f"pmod(xxhash64(id, side), div(n, {BLOCK}) + 1)").alias("pack")
    packed = sized.groupBy(KEY, pack).agg(F.collect_list(F.struct("side", "id", "v")).alias("rows")).join(pivots, KEY)

    def assign(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                rows, centres = batch.column("rows")[at].values, _matrix(batch.column("pivots")[at].values)
                x = _matrix(rows.field("v"))
                square = _squares(x, centres)
                cell = square.argmin(axis=1)
                gap = x - centres[cell]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(KEY)[at], len(x)), rows.field("side"), pa.array(cell.astype(np.int32)), rows.field("id"), rows.field("v"), pa.array(np.sqrt((gap * gap).sum(axis=1)))], [KEY, "side", "cell", "id", "v", "away"])

    placed = written(packed.mapInArrow(assign, f"{KEY} {kind}, side int, cell int, id long, v array<double>, away double"))
    cells = placed.groupBy(KEY, "side", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    sub = F.expr(f"pmod(xxhash64(id), div(n, {BLOCK}) + 1)").cast("int").alias("sub")
    blocks = placed.join(cells.drop("radius"), [KEY, "side", "cell"]).groupBy(KEY, "side", "cell", sub).agg(F.collect_list(F.struct("id", "v", "away")).alias("rows"))
    blocks = written(blocks)
    first = F.slice(F.sort_array(F.transform("rows", lambda x: x["away"])), 1, want)
    near = blocks.where("side = 1").select(KEY, "cell", first.alias("near")).groupBy(KEY, "cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, want).alias("near"))

    # which cells may meet: at most CELLS + 1 of a signal on either side
    left = cells.where("side = 0").groupBy(KEY).agg(F.collect_list(F.struct("cell", "radius")).alias("left"))
    right = cells.where("side = 1").join(near, [KEY, "cell"]).groupBy(KEY).agg(F.collect_list(F.struct("cell", "radius", "near")).alias("right"))

    def meet(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                l, r = batch.column("left")[at].values, batch.column("right")[at].values
                centres = _matrix(batch.column("pivots")[at].values)
                i, j = (x.field("cell").to_numpy() for x in (l, r))
                wide_i, wide_j = (x.field("radius").to_numpy() for x in (l, r))
                apart = np.sqrt(_squares(centres[i], centres[j]))
                slack = SLACK * (1 + apart)
                near, ends = r.field("near").flatten().to_numpy(), np.cumsum([len(x) for x in r.field("near")])
                of = np.searchsorted(ends, np.arange(len(near)), side="right")
                least = apart - wide_i[:, None] - wide_j[None]
                for x in range(len(i)):
                    reach = wide_i[x] + apart[x, of] + near
                    most = np.partition(reach, want - 1)[want - 1] if len(reach) >= want else np.inf
                    kept = np.flatnonzero(least[x] - slack[x] <= most)
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(KEY)[at], len(kept)), pa.array(np.full(len(kept), i[x], np.int32)), pa.array(j[kept]), pa.array(np.maximum(least[x, kept] - slack[x, kept], 0.0))], [KEY, "cell", "other", "least"])

    pairs = left.join(right, KEY).join(pivots, KEY).mapInArrow(meet, f"{KEY} {kind}, cell int, other int, least double")
    blocks = blocks.join(sizes.select(KEY, F.expr(f"cast(div(n, {PART}) + 1 as int)").alias("parts")), KEY)
    held = blocks.where("side = 0").select(KEY, "cell", "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1.0).alias("least"), "rows")
    subs = blocks.where("side = 0").groupBy(KEY, "cell").agg(F.max("sub").alias("subs"))
    passing = blocks.where("side = 1").select(KEY, F.col("cell").alias("other"), F.expr("cast(pmod(xxhash64(cell, sub), parts) as int)").alias("part"), "rows").join(pairs, [KEY, "other"]).join(subs, [KEY, "cell"])
    passing = passing.select(KEY, "cell", F.explode(F.sequence(F.lit(0), F.col("subs"))).alias("sub"), "part", "least", "rows")
    unit = [KEY, "cell", "sub", "part"]
    dealt = held.unionByName(passing).repartition(*unit).sortWithinPartitions(*unit, "least")

    def join(batches):
        now, best = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(now[0], batch.column(KEY).type), len(best.row)), pa.array(best.ids[best.row]), pa.array(best.j), pa.array(best.d)], [KEY, "i", "j", "d"])

        for batch in batches:
            for at, (*of, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in [*unit, "least"]))):
                rows = batch.column("rows")[at].values
                ids, x = rows.field("id").to_numpy(), _matrix(rows.field("v"))
                if least < 0:
                    if best is not None:
                        yield done()
                    now, best = of, _Best(ids, x, k, width, cosine)
                elif of == now:
                    best.meet(ids, x, least)
        if best is not None:
            yield done()

    found = dealt.mapInArrow(join, f"{KEY} {kind}, i long, j long, d double")
    top = found.groupBy(KEY, "i").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "j"))), 1, k).alias("top"))
    return top.select(KEY, "i", F.explode("top").alias("x")).select(KEY, "i", "x.j", "x.d")


def _dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column side by side, zeros where a row has no number, and where it has one."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    has = np.arange(sizes.max(initial=0)) < sizes[:, None]
    flat, x = column.flatten(), np.zeros(has.shape)
    x[has] = flat.fill_null(0.0).to_numpy()
    has[has] = flat.is_valid().to_numpy(zero_copy_only=False)
    return x, has


def _half_up(d: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does, halves away from zero."""
    size = np.abs(d) * 10.0**digits
    whole = np.floor(size)
    whole += size - whole >= 0.5
    return np.where(np.isfinite(whole), np.copysign(whole / 10.0**digits, d) + 0.0, d)


def _tile(x: np.ndarray, y: np.ndarray, both: np.ndarray | None, cosine: bool) -> np.ndarray:
    """Distances of the rows of x to the columns of y. Elements are added up in their order, whatever the blocks.

    both: (elements, rows of x, columns of y), the elements that both have; without it, all.
    """
    d, term = np.zeros((len(x), y.shape[1])), np.empty((len(x), y.shape[1]))
    for k in range(len(y)):
        if cosine:
            np.multiply(x[:, k, None], y[k], out=term)
        else:
            np.subtract(x[:, k, None], y[k], out=term)
            np.multiply(term, term, out=term)
        if both is not None:
            term[~both[k]] = 0.0
        d += term
    if not cosine:
        return np.sqrt(d, out=d)
    squares = lambda m: sum((m[k] * m[k] for k in range(len(m))), np.zeros(m.shape[1]))
    return 1.0 - d / np.sqrt(squares(x.T)[:, None] * squares(y))


def distances(a: DataFrame, b: DataFrame, metric: str = "euclidean", digits: int | None = None) -> DataFrame:
    """(signal_id, i, j, d): every frame of a (signal_id, i, v) with every frame of b (signal_id, j, w) of the same signal.

    metric is euclidean or cosine (1 - cosine). digits: d is rounded to them. Elements that one of two frames lacks don't
    count for euclidean; d is null where no element counts, and for cosine where one is missing. A frame without direction
    has NaN for cosine.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    cosine, kind = metric == "cosine", a.schema[KEY].dataType.simpleString()
    a, b = (df.select(KEY, F.col(i).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v")).where(F.col(KEY).isNotNull()) for df, i, v in ((a, "i", "v"), (b, "j", "w")))
    parts = [df.groupBy(KEY).agg(F.expr(f"div(count(1), {BLOCK}) + 1").alias("parts")) for df in (a, b)]

    def blocks(side: int, df: DataFrame) -> DataFrame:
        """Each block of one side, once for each block of the other."""
        own, other = ("x", "y")[side], ("x", "y")[1 - side]
        packed = df.join(parts[side], KEY).groupBy(KEY, F.expr("pmod(xxhash64(id), parts)").alias(own)).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
        return packed.join(parts[1 - side], KEY).select(KEY, own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(other), F.lit(side).alias("side"), "rows")

    pair = [KEY, "x", "y"]
    dealt = blocks(0, a).unionByName(blocks(1, b)).repartition(*pair).sortWithinPartitions(*pair, "side")

    def meet(batches):
        now, held = None, None
        for batch in batches:
            of_keys = batch.column(KEY)
            for at, (*of, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in [*pair, "side"]))):
                rows = batch.column("rows")[at].values
                if not side:
                    now, held = of, (rows.field("id"), *_dense(rows.field("v")))
                elif of == now:
                    (i, x, has), j, (y, other) = held, rows.field("id"), _dense(rows.field("v"))
                    full = has.all() and other.all() and x.shape[1] == y.shape[1]
                    if not full:
                        wide = max(x.shape[1], y.shape[1])
                        x, has, y, other = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, has, y, other))
                    y, step = np.ascontiguousarray(y.T), max(1, TILE // len(j))
                    for first in range(0, len(i), step):
                        rest = slice(first, first + step)
                        n, both = len(x[rest]), None if full else has[rest].T[:, :, None] & other.T[:, None]
                        with np.errstate(all="ignore"):
                            d = _tile(x[rest], y, both, cosine)
                            d = (d if digits is None else _half_up(d, digits)).ravel()
                        none = None if full else ((has[rest][:, None] != other[None]).any(axis=2) if cosine else ~both.any(axis=0)).ravel()
                        lists = lambda flat, n=n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(j)), flat)
                        yield pa.RecordBatch.from_arrays([pa.repeat(of_keys[at], n), i[rest], lists(pa.concat_arrays([j] * n)), lists(pa.array(d, mask=none))], [KEY, "i", "j", "d"])

    # a row of the other block's distances at a time: rows of single ones cost more on the way from Python than to work out
    rows = dealt.mapInArrow(meet, f"{KEY} {kind}, i long, j array<long>, d array<double>")
    return rows.select(KEY, "i", "j", F.posexplode("d").alias("at", "d")).select(KEY, "i", F.get("j", "at").alias("j"), "d")

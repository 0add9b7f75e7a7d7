"""Alignment of two long feature matrices, tile by tile along anti-diagonals.

Tiles of an anti-diagonal don't depend on each other, so each is a task; they pass on borders only, which are written to the
shared folder. With its costs a border says where each path entered the tile, so that the best path is followed from tile to
tile over borders, in one pass for each signal, and only the tiles on it are computed again for their cells. No task holds
more than a tile; a signal of n and m frames takes n * m / BLOCK numbers on disk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetide.kernels import alignment
from wavetide.kernels.sequence import cdist

from .long import _arrays, _matrix
from .shared import written
from .signals import KEY

#: Frames of a block; a tile has BLOCK x BLOCK cells.
BLOCK = 2048
_RIM = "right array<double>, bottom array<double>, right_from array<int>, bottom_from array<int>"


def _blocks(frames: DataFrame, at: str, size: int) -> DataFrame:
    """(signal_id, at, at_f): rows of size frames (signal_id, t, f)."""
    own = F.sort_array(F.collect_list(F.struct("t", "f")))
    return frames.groupBy(KEY, F.floor(F.col("t") / size).cast("int").alias(at)).agg(F.transform(own, lambda p: p["f"]).alias(f"{at}_f"))


def _costs(x: pa.ListScalar, y: pa.ListScalar, metric: str) -> np.ndarray:
    a, b = (np.stack(_arrays(v.values)) for v in (x, y))
    if metric == "cosine":
        return cdist(a, b, metric)
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):  # a feature at a time: no array of all differences
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(out)


def _borders(batch: pa.RecordBatch, at: int, cost: np.ndarray, subseq: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """The row above, the column to the left and the corner of a tile."""
    i, j = batch.column("i")[at].as_py(), batch.column("j")[at].as_py()
    n, m = cost.shape
    above, left = (np.asarray(batch.column(c)[at].values) if batch.column(c)[at].is_valid else None for c in ("above", "left"))
    if above is None:  # the first row of tiles
        above = np.append(0.0 if i == j == 0 and not subseq else np.inf, np.full(m, 0.0 if subseq else np.inf))
    return above[1:], np.full(n, np.inf) if left is None else left, float(above[0])


def align(a: DataFrame, b: DataFrame, subseq: bool = False, metric: str = "euclidean", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Dynamic time warping of frames a with frames b (both signal_id, t, f; t is 0, 1, ...): (signal_id, cost), and the
    path (signal_id, i, j).

    subseq: a is found within b, at the least cost. A signal that one side lacks has no rows.
    """
    kind = a.schema[KEY].dataType.simpleString()
    x, y = written(_blocks(a, "i", block)), written(_blocks(b, "j", block))
    most = [df.agg(F.max(c)).first()[0] for df, c in ((x, "i"), (y, "j"))]
    sizes = y.groupBy(KEY).agg(F.max("j").alias("last_j")).join(x.groupBy(KEY).agg(F.max("i").alias("last_i")), KEY)

    def fill(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                cost = _costs(batch.column("i_f")[at], batch.column("j_f")[at], metric)
                above, left, corner = _borders(batch, at, cost, subseq)
                d, _, entry = alignment.tile(cost, above, left, corner)
                own = [pa.array([v], pa.list_(t)) for v, t in ((d[:, -1], pa.float64()), (np.append(left[-1], d[-1]), pa.float64()), (entry[:, -1], pa.int32()), (entry[-1], pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, 1) for c in (KEY, "i", "j")] + own, [KEY, "i", "j", "right", "bottom", "right_from", "bottom_from"])

    tiles = []
    for s in range(most[0] + most[1] + 1) if None not in most else ():
        own = x.withColumn("j", F.lit(s) - F.col("i")).join(y, [KEY, "j"])
        if tiles:
            left = tiles[-1].select(KEY, "i", (F.col("j") + 1).alias("j"), F.col("right").alias("left"))
            above = tiles[-1].select(KEY, (F.col("i") + 1).alias("i"), "j", F.col("bottom").alias("above"))
            own = own.join(left, [KEY, "i", "j"], "left").join(above, [KEY, "i", "j"], "left")
        else:
            own = own.withColumn("left", F.lit(None).cast("array<double>")).withColumn("above", F.lit(None).cast("array<double>"))
        tiles.append(written(own.mapInArrow(fill, f"{KEY} {kind}, i int, j int, {_RIM}")))
    spark = a.sparkSession
    rims = spark.createDataFrame([], f"{KEY} {kind}, i int, j int, {_RIM}")
    for t in tiles:
        rims = rims.unionByName(t)
    rims = rims.join(sizes, KEY)

    # where the path ends: the last cell, or the cheapest of the last row
    last = rims.where("i = last_i" if subseq else "i = last_i and j = last_j").select(KEY, "j", F.slice("bottom", 2, block).alias("row"))
    low = F.array_min("row") if subseq else F.element_at("row", -1)
    place = F.when(F.lit(subseq), F.array_position("row", F.array_min("row")) - 1).otherwise(F.size("row") - 1).cast("int")
    ends = written(last.groupBy(KEY).agg(F.min(F.struct(low.alias("cost"), "j", place.alias("at"))).alias("end")))
    rims = rims.join(ends, KEY).select(KEY, "i", "j", "last_i", "end", "right_from", "bottom_from")

    def follow(batches):
        """Rims come by signal, from the last anti-diagonal back; a tile on the path tells the one before it."""
        key = now = None
        for batch in batches:
            out = []
            for at, (k, i, j, last_i, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in (KEY, "i", "j", "last_i", "end")))):
                if key is None or k != key:
                    key, now = k, (last_i, end["j"], None)
                if (i, j) != now[:2]:
                    continue
                right, bottom = (np.asarray(batch.column(c)[at].values) for c in ("right_from", "bottom_from"))
                n, m = len(right), len(bottom)
                cell = now[2] or ("bottom", end["at"])
                spot = (n - 1, m - 1) if cell[0] == "corner" else (n - 1, cell[1]) if cell[0] == "bottom" else (cell[1], m - 1)
                out.append((k, i, j, *spot))
                came = int(bottom[spot[1]] if spot[0] == n - 1 else right[spot[0]])
                now = (i - 1, j - 1, ("corner", 0)) if came == 0 else (i - 1, j, ("bottom", came - 1)) if came <= m else (i, j - 1, ("right", came - m - 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [batch.column(KEY).type, *[pa.int32()] * 4])], [KEY, "i", "j", "row", "col"])

    order = [KEY, F.desc(F.col("i") + F.col("j")), F.desc("i")]
    on_path = rims.repartition(KEY).sortWithinPartitions(*order).mapInArrow(follow, f"{KEY} {kind}, i int, j int, row int, col int")

    def trace(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                cost = _costs(batch.column("i_f")[at], batch.column("j_f")[at], metric)
                _, step, _ = alignment.tile(cost, *_borders(batch, at, cost, subseq))
                cells = np.array(alignment.path_in(step, batch.column("row")[at].as_py(), batch.column("col")[at].as_py()), np.int64)
                cells += np.array([batch.column("i")[at].as_py(), batch.column("j")[at].as_py()]) * block
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(KEY)[at], len(cells)), pa.array(cells[:, 0]), pa.array(cells[:, 1])], [KEY, "i", "j"])

    every = spark.createDataFrame([], f"{KEY} {kind}, i int, j int, {_RIM}")
    for t in tiles:
        every = every.unionByName(t)
    left = every.select(KEY, "i", (F.col("j") + 1).alias("j"), F.col("right").alias("left"))
    above = every.select(KEY, (F.col("i") + 1).alias("i"), "j", F.col("bottom").alias("above"))
    cells = on_path.join(left, [KEY, "i", "j"], "left").join(above, [KEY, "i", "j"], "left").join(x, [KEY, "i"]).join(y, [KEY, "j"])
    return ends.select(KEY, "end.cost"), cells.mapInArrow(trace, f"{KEY} {kind}, i long, j long")

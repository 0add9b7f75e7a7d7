"""Exact top-k search by inner product over a vector-approximation file.

Components are integers floor(scale * x). The file keeps for each vector one byte per dimension: the number of its cell
in a grid over that dimension's range. A cell's middle and width bound a score from both sides: with q's components and
the cells' half widths, q . middle - sum |q| half <= score <= q . middle + sum |q| half. One scan of the cells gives
each query its bounds; the k-th largest lower bound over all vectors drops those whose upper bound is less. Of the others
the exact vectors of the ``FIRST`` largest upper bounds of each query are read, then only those whose upper bound reaches
the k-th exact score so far, in descending order of upper bound until none can reach it.

Queries and vectors are packed in blocks and each block of queries meets each block of vectors once, so nothing grows
with a group. Equal vectors are one class with its k + 1 smallest ids (no query needs more, its own left out), so copies
tie without costing more than one.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, as query or as
candidate; vectors of different lengths don't meet; scores must fit 53 bits (components up to 2**23 with up to 128
dimensions do); a query never finds rows of its own id, and a repeated query id asks once; equal rows of one id are one
candidate; fewer candidates than k give fewer rows; ties go to the smaller id; null ids take no part; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, released, table

SCALE = 256
CELLS = 256
#: Vectors and queries in a block.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Exact vectors that each query reads before any others, for each of the k results.
FIRST = 4


def _integers(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, dim, x (int64 components, packed) of the rows that take part."""

    @released
    def run(batches):
        for b in batches:
            ends = b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py()
            x = np.floor(scale * b.column(1).flatten().to_numpy()).astype("<i8")
            out = [x[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(out, pa.binary())], ["vec_id", "dim", "x"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda y: y.isNotNull() & (F.abs(y) < float("inf")))  # a NaN is larger than any number
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite).mapInArrow(run, "vec_id long, dim long, x binary")


def _packed(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """block, n and each column packed, for blocks of at most size rows of a task."""

    @released
    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, [[] for _ in columns]

        def done():
            nonlocal number, held
            number += 1
            row = {"block": pa.array([number], pa.int64()), "n": pa.array([len(held[0])], pa.int64())}
            for c, values in zip(columns, held):
                row[c] = pa.array([b"".join(values) if isinstance(values[0], bytes) else np.array(values, "<i8").tobytes()], pa.binary())
            held = [[] for _ in columns]
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                for h, v in zip(held, row):
                    h.append(v)
                if len(held[0]) == size:
                    yield done()
        if held[0]:
            yield done()

    return rows.select(*columns).mapInArrow(run, "block long, n long, " + ", ".join(f"{c} binary" for c in columns))


def _grid(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least component and cell width of each dimension, over all rows."""

    @released
    def run(batches):
        low, high = None, None
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(b.num_rows, dim)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"d": pa.array(range(dim), pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    got = rows.select("x").mapInArrow(run, "d long, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    low, high = (np.array([r[k] for r in got], dtype=np.int64) for k in ("low", "high"))
    return low, np.maximum(1, -(-(high - low + 1) // CELLS))


def _search(queries: DataFrame, classes: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, class, score for the classes that may hold one of a query's k best."""
    low, width = _grid(classes, dim)

    @released
    def approximate(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8").reshape(b.num_rows, dim)
                cells = ((x - low) // width).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in cells], pa.binary()), b.column(2)], ["class", "cells", "room"])

    # room: how many of the class's ids a query can use besides its own
    file = classes.select("class", "x", F.size("ids").cast("long").alias("room")).mapInArrow(approximate, "class binary, cells binary, room long")
    file = materialize(_packed(file, ["class", "cells", "room"], BLOCK).withColumnRenamed("block", "vectors").withColumnRenamed("n", "m"))
    asked = materialize(_packed(queries, ["vec_id", "x"], QUERY_BLOCK).withColumnRenamed("block", "queries"))
    both = _pairs(asked, file).join(asked, "queries").join(file, "vectors").select("n", "vec_id", "x", "m", "class", "cells", "room")

    @released
    def scan(batches):
        for b in batches:
            for r in range(b.num_rows):
                n, ids, x, m, names, cells, room = (c[r].as_py() for c in b.columns)
                ids, q = np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i8").reshape(n, dim).astype(np.float64)
                names = np.frombuffer(names, f"S{len(names) // m}")
                room = np.frombuffer(room, "<i8")
                middle = np.frombuffer(cells, np.uint8).reshape(m, dim) * width.astype(np.float64) + low + (width - 1) / 2
                slack = np.abs(q) @ ((width - 1) / 2) + 1e-6 * np.abs(q).sum(axis=1) + 1e-6
                score = q @ middle.T
                out = [[], [], [], []]
                best = min(m, k + 1)
                for i in range(n):
                    # the k-th lower bound of this block, a class counted for the ids it has besides the query
                    top = np.argpartition(score[i], m - best)[m - best :]
                    top = top[np.argsort(-score[i][top])]
                    have = np.cumsum(np.maximum(room[top] - 1, 0)) >= k
                    some = np.arange(1, best + 1) - 1 >= k  # at most one class is the query's own
                    done = np.flatnonzero(have | some)
                    floor = score[i][top[done[0]]] - slack[i] if len(done) else -np.inf
                    live = np.flatnonzero(score[i] + slack[i] >= floor)
                    out[0] += [int(ids[i])] * len(live)
                    out[1] += names[live].tolist()
                    out[2] += (score[i][live] + slack[i]).tolist()
                    out[3] += [floor] * len(live)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([c.ljust(32, b"\0") for c in out[1]], pa.binary()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], ["query_id", "class", "upper", "floor"])

    bounds = materialize(both.mapInArrow(scan, "query_id long, class binary, upper double, floor double"))
    # a floor holds for all blocks: k candidates of one block reach it
    floors = bounds.groupBy("query_id").agg(F.max("floor").alias("floor"))
    live = materialize(bounds.drop("floor").join(floors, "query_id").where("upper >= floor").select("query_id", "class", "upper"))
    asks = queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))

    @released
    def exact(batches):
        query, best, kth = None, [], -np.inf
        for b in batches:
            out = [[], [], []]
            for i, upper, q, x, ids in zip(*(c.to_pylist() for c in b.columns)):
                if i != query:
                    query, best, kth = i, [], -np.inf
                if upper < kth:  # nor can any later one reach the k-th score
                    continue
                s = int(np.frombuffer(q, "<i8") @ np.frombuffer(x, "<i8"))
                for c in ids:
                    if c != i:
                        out[0].append(i)
                        out[1].append(c)
                        out[2].append(s)
                        best.append(s)
                best = sorted(best)[-k:]
                kth = best[0] if len(best) == k else -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["query_id", "vec_id", "score"])

    def read(some: DataFrame) -> DataFrame:
        rows = some.join(asks, "query_id").join(classes.select("class", "x", "ids"), "class").select("query_id", "upper", "q", "x", "ids")
        return rows.repartition("query_id").sortWithinPartitions("query_id", F.col("upper").desc()).mapInArrow(exact, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("upper").desc(), F.col("class").desc()))
    first = materialize(live.withColumn("nth", nth).where(F.col("nth") <= FIRST * k).drop("nth"))
    top = materialize(read(first))
    least = best(top).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("kth"))
    behind = first.groupBy("query_id").agg(F.min(F.struct("upper", "class")).alias("last"))
    rest = live.join(behind, "query_id").where(F.struct("upper", "class") < F.col("last")).join(least, "query_id", "left")
    rest = rest.where(F.coalesce((F.col("found") < k) | (F.col("upper") >= F.col("kth")), F.lit(True))).select("query_id", "class", "upper")
    return best(top.unionByName(read(rest))).select("query_id", "rank", "vec_id", "score")


def _pairs(asked: DataFrame, file: DataFrame) -> DataFrame:
    """Each block of queries with each block of vectors: numbers of blocks only."""
    numbered = asked.select("queries", F.row_number().over(Window.orderBy("queries")).cast("long").alias("q"))
    blocks = asked.count()
    every = file.select("vectors").where(F.lit(blocks > 0)).withColumn("q", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(blocks).cast("long"))))
    return every.join(numbered, "q").select("queries", "vectors").repartition("queries", "vectors")


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = df.sparkSession
    rows = _integers(df, id_col, vec_col, scale)
    named = rows.withColumn("class", F.unhex(F.sha2("x", 256)))
    # the k + 1 smallest ids of each class; the rank filter runs before the exchange, too
    nth = F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))
    few = named.select("class", "vec_id", "dim", "x").dropDuplicates(["class", "vec_id"]).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = materialize(few.groupBy("class").agg(F.first("dim").alias("dim"), F.first("x").alias("x"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = _integers(queries, id_col, vec_col, scale).groupBy("vec_id").agg(F.min(F.struct("dim", "x")).alias("v"))
    asked = materialize(asked.select("vec_id", "v.dim", "v.x"))
    out = None
    for r in asked.select("dim").distinct().orderBy("dim").collect():
        part = _search(asked.where(F.col("dim") == r["dim"]), classes.where(F.col("dim") == r["dim"]), int(r["dim"]), k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))

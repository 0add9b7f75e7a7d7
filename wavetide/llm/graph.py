"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released

_EDGES = "u long, v long"
#: Links that one task contracts at once.
_CHUNK = 250_000


@released
def _contract(batches):
    """Replace the links of a chunk by links of each member to the smallest id it reaches within the chunk."""

    def stars(parent: dict[int, int]):
        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    parent: dict[int, int] = {}
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for x in (u, v):
                parent.setdefault(x, x)
            while parent[u] != u:
                parent[u] = parent[parent[u]]
                u = parent[u]
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            parent[max(u, v)] = min(u, v)
        if len(parent) >= 2 * _CHUNK:
            yield stars(parent)
            parent = {}
    if parent:
        yield stars(parent)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. Ids without links don't appear.

    Links are contracted within chunks of tasks, then large-star and small-star steps alternate until the rest fits one
    chunk or nothing changes; each round is written to the shared folder, and nothing but a count and a checksum reaches
    the driver.
    """
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    e = materialize(e.mapInArrow(_contract, _EDGES))
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38, 0))"))).first()
        if state[0] <= _CHUNK:
            e = materialize(e.coalesce(1).mapInArrow(_contract, _EDGES))
            break
        if state == seen:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        step = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialize(step.where("u != v").mapInArrow(_contract, _EDGES).distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

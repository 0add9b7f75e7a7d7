"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Rows lie in source partitions (a hash of the id, so that a lost executor finds the same ones again). For partitions of
n_p rows and shards of fixed sizes, the numbers of rows that each partition sends to each shard in a uniformly random
permutation follow a multivariate hypergeometric law; the driver draws that matrix (partitions x shards integers, which
depends on the number of partitions, not on rows). Each partition permutes its rows locally and deals them by its line
of the matrix, the exchange brings each shard's rows together, and each shard permutes its rows again. Everything but
the draw is DataFrame code.

Law: ``rows``: shard sizes are at most one apart. Copies of a text are dealt like any other rows, so a group of equal
texts spreads evenly. Defined results: null text has no bytes (size 16, crc 0); null and repeated ids are rows like any
other; an empty table gives an empty result; only id and text are read, whatever else the table holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SEED = 20240611
#: Rows that a source partition and a part of a shard hold on average.
ROWS_PER_PARTITION = 20_000
#: Source partitions at most, which bounds the matrix on the driver; beyond, a partition's sort spills.
MAX_PARTITIONS = 8192


def communication_matrix(counts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """counts: rows of each partition. Rows that it sends to each shard; column sums are at most one apart."""
    total = sum(counts)
    left = np.full(shards, total // shards, dtype=np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        rest = n
        pool = int(left.sum())
        for s in range(shards):  # one conditional hypergeometric draw for each shard
            if rest == 0:
                break
            own = int(left[s])
            k = rest if pool == own else int(_hypergeometric(rng, own, pool - own, rest))
            out[p, s], pool, rest = k, pool - own, rest - k
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """numpy's sampler takes populations under a billion; beyond, the draw is halved by recursion on the urn."""
    if good == 0:
        return 0
    if good + bad < 1_000_000_000:
        return rng.hypergeometric(good, bad, draws)
    half = draws // 2
    if half == 0:
        return int(rng.integers(0, good + bad) < good)
    first = _hypergeometric(rng, good, bad, half)
    return first + _hypergeometric(rng, good - first, bad - (half - first), draws - half)


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, seed: int = SEED, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark = df.sparkSession
    n = df.select(F.lit(1)).count()
    parts = min(MAX_PARTITIONS, max(1, -(-n // rows_per_partition)))
    pieces = max(1, -(-n // (shards * rows_per_partition)))
    # by text, too: rows of one id, or without any, aren't one part
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("string"))
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts))
    counts = {r["part"]: r["count"] for r in df.groupBy(part.alias("part")).count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    bounds = spark.createDataFrame([(p, np.cumsum(matrix[p]).tolist()) for p in range(parts)], "part long, bounds array<long>")

    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        part.alias("part"),
        F.xxhash64(key, F.lit(seed + 1)).alias("first"),
        F.xxhash64(key, F.lit(seed + 2)).alias("second"),
    )
    ties = ["doc_id", "text_crc32", "size"]
    local = Window.partitionBy("part").orderBy("first", *ties)
    dealt = rows.withColumn("at", F.row_number().over(local).cast("long")).join(bounds, "part")
    dealt = dealt.select("doc_id", "size", "text_crc32", "second", F.size(F.filter("bounds", lambda b: b < F.col("at"))).alias("shard"))

    # the second permutation: pieces of a shard by ranges of the hash, so that no task holds a whole shard
    dealt = dealt.withColumn("piece", F.pmod(F.shiftrightunsigned("second", 33), F.lit(pieces)))
    starts = dealt.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("rows"))
    starts = starts.select("shard", "piece", (F.sum("rows").over(Window.partitionBy("shard").orderBy("piece")) - F.col("rows")).alias("start"))
    inner = Window.partitionBy("shard", "piece").orderBy("second", *ties)
    out = dealt.withColumn("inner", F.row_number().over(inner))
    if pieces > 1:
        out = out.join(starts, ["shard", "piece"])
    else:
        out = out.withColumn("start", F.lit(0))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inner") - 1).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

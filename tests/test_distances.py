"""All distances of a signal: in blocks, spread over tasks, and as their SQL has them for odd vectors."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetide import registry
from wavetide.operators import neighbours

ODD = {
    "euclidean": [None, [], [1.0], [1.0, None, 3.0, 4.0], [None, None, None, None], [float("inf"), 0.0, 0.0, 1.0], [3e-5, 0.0, 0.0, 0.0]],
    "cosine": [None, [0.0, 0.0, 0.0, 0.0], [1e-30, 0.0, 0.0, 0.0], [-1.0, -2.0, -3.0, -4.0], [1.0, 2.0, 3.0, 4.0]],
}
METRICS = pytest.mark.parametrize("metric", ["euclidean", "cosine"])


@pytest.fixture
def folder(spark, tmp_path):
    def make(vectors):
        rows = [(i // 2 if i % 7 else i, v, i % 3 or None if i > 20 else 1) for i, v in enumerate(vectors)]  # ids repeat; some labels are null
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return make


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "TILE", 8)


def text(rows):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else repr(x) for x in row) for row in rows)


@METRICS
@pytest.mark.parametrize("blocks", [False, True])
def test_odd_vectors_equal_sql(spark, folder, request, metric, blocks):
    if blocks:
        request.getfixturevalue("small_blocks")
    rng = np.random.default_rng(3)
    at = folder(ODD[metric] + rng.normal(size=(30, 4)).round(2).tolist())
    got = registry.queries()[f"cdist_{metric}"](spark, at).select("signal_id", "i", "j", "d").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}/embeddings.parquet/*.parquet')")
    assert text(got) == text(con.execute(registry.oracle_sql()[f"cdist_{metric}"]).fetchall()) and len(got) > 100


@METRICS
def test_one_signal_is_many_tasks_and_blocks_change_no_bit(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(7, i, x) for i, x in enumerate(rng.normal(size=(41, 5)).tolist())], "signal_id int, i long, v array<double>").coalesce(1)
    run = lambda: neighbours.distances(v, v.withColumnsRenamed({"i": "j", "v": "w"}), metric)
    whole = run().collect()
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "TILE", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = run().select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r[:4] for r in spread) == sorted(map(tuple, whole)) and len(whole) == 41 * 41
    assert len({r["task"] for r in spread}) == 4

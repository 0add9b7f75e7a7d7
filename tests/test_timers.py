"""Streams with timers: a gap is given up by event time, and the state of idle signals goes."""

import datetime as dt

import numpy as np
import pytest

from wavetide.kernels import dsp
from wavetide.streaming import timers

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def provider(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(spark, batches, path, name, **times):
    """Rows out, and the number of rows in the state after each batch."""
    kind = "signal_id long, n long, v double, ts timestamp"
    spark.createDataFrame([], kind).write.parquet(path)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    query = timers.timed_deemphasis(stream, 0.9, late="0 seconds", **times).writeStream.outputMode("append").format("memory").queryName(name).start()
    held = []
    try:
        for rows in batches:
            spark.createDataFrame([(k, n, v, START + dt.timedelta(seconds=s)) for k, n, v, s in rows], kind).coalesce(1).write.mode("append").parquet(path)
            query.processAllAvailable()
            held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        query.stop()
    return spark.table(name).toPandas(), held


def test_a_gap_is_given_up_by_time(provider, tmp_path):
    y = [float((k * 37) % 11) for k in range(12)]
    sample = lambda n, s: (1, n, y[n], s)
    batches = [
        [sample(n, n) for n in range(4)],
        [sample(n, n) for n in (6, 7)],  # 4 and 5 are missing: held
        [sample(5, 8), sample(4, 8)],  # they come in time
        [sample(n, n) for n in (10, 11)],  # 8 and 9 are missing
        [(2, 0, 1.0, 40)],  # another signal moves the watermark past the wait
        [(2, 1, 1.0, 41)],
    ]
    got, _ = run(provider, batches, str(tmp_path / "in"), "timed_gap", wait_ms=10_000, idle_ms=10**9)
    one = got[got.signal_id == 1].sort_values("n")
    assert one.n.tolist() == [*range(8), 10, 11]
    assert np.allclose(one.v, dsp.deemphasis(np.array(y[:8] + y[10:]), 0.9))
    assert np.allclose(got[got.signal_id == 2].sort_values("n").v, [1.0, 1.9])


def test_idle_signals_leave_the_state(provider, tmp_path):
    batches = [[(k, 0, 1.0, k % 3) for k in range(20)], [(99, 0, 1.0, 5)], [(99, 1, 1.0, 200)], [(99, 2, 1.0, 201)], [(3, 0, 2.0, 202)]]
    got, held = run(provider, batches, str(tmp_path / "in"), "timed_idle", wait_ms=1000, idle_ms=60_000)
    assert held[0] > held[-2] and held[-2] <= held[0] / 5
    assert got[(got.signal_id == 3)].v.tolist() == [1.0, 2.0]  # begins anew
    assert np.allclose(got[got.signal_id == 99].sort_values("n").v, dsp.deemphasis(np.ones(3), 0.9))

"""Streams give what the batch operators give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavetide.kernels import dsp
from wavetide.operators import signals as S
from wavetide.queries.base import long, table, wide
from wavetide.streaming import frames as st


def _run(query_df, name, spark, mode="append"):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).toPandas()


@pytest.fixture()
def source(spark, data, tmp_path):
    x = long(spark, data).where("signal_id < 6").withColumn("n", F.col("n").cast("long"))
    for k, part in enumerate(((0, 20), (20, 21), (21, 60), (60, 1000))):  # micro-batches in order
        x.where((F.col("n") >= part[0]) & (F.col("n") < part[1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_frames(spark, data, source):
    got = _run(st.stream_frames(source, 16, 4), "frames_out", spark).sort_values(["signal_id", "t"])
    want = S.frame(wide(spark, data).where("signal_id < 6"), 16, 4).toPandas().sort_values(["signal_id", "t"])
    assert got["f"].map(list).tolist() == want["f"].map(list).tolist()


def test_stream_filters(spark, data, source):
    got = _run(st.stream_preemphasis(source), "pre_out", spark).sort_values(["signal_id", "n"])["v"].to_numpy()
    want = S.preemphasis(long(spark, data).where("signal_id < 6")).toPandas().sort_values(["signal_id", "n"])["v"].to_numpy()
    assert len(got) == len(want) and abs(got - want).max() < 1e-9


def _batches(spark, rows, path, parts):
    for part in parts:
        spark.createDataFrame([rows[k] for k in part], "signal_id long, n long, v double").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("signal_id long, n long, v double").option("maxFilesPerTrigger", 1).parquet(path)


def test_filters_wait_for_late_samples(spark, tmp_path):
    y = [float((k * 37) % 11) for k in range(30)]
    rows = [(1, k, v) for k, v in enumerate(y)]
    parts = [range(0, 5), range(8, 12), [5, 7], [6, *range(12, 20)], range(20, 30)]
    got = _run(st.stream_deemphasis(_batches(spark, rows, str(tmp_path / "in"), parts), ahead=10), "late_out", spark).sort_values("n")
    assert got["n"].tolist() == list(range(30)) and np.allclose(got["v"], dsp.deemphasis(np.array(y)))
    got = _run(st.stream_preemphasis(_batches(spark, rows, str(tmp_path / "gap"), [range(0, 5), range(8, 30), [6, 7]])), "gap_out", spark).sort_values("n")
    assert got["n"].tolist() == [*range(5), *range(8, 30)]  # without waiting the gap is given up, and what comes later is late


def test_stream_pcen(spark, tmp_path):
    s = np.random.default_rng(3).random((20, 4))
    rows = [(7, t, f.tolist()) for t, f in enumerate(s)]
    kind = "signal_id long, t long, f array<double>"
    for lo, hi in ((0, 6), (6, 7), (7, 20)):
        spark.createDataFrame(rows[lo:hi], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(st.stream_pcen(stream, sr=64.0, hop_length=4), "pcen_out", spark).sort_values("t")
    assert np.allclose(np.array(got["f"].tolist()), dsp.pcen(s, sr=64.0, hop_length=4))


def test_functions_in_sql(spark):
    from wavetide.functions import sql

    sql.register(spark)
    spark.createDataFrame([(1, [1.0, 2.0, 4.0, 8.0, 16.0]), (2, [3.0]), (3, None)], "signal_id long, y array<double>").createOrReplaceTempView("wt_signals")
    got = spark.sql("SELECT signal_id, t, f FROM wt_signals, LATERAL wt_frames(y, 3, 2) ORDER BY t").collect()
    assert [(r["signal_id"], r["t"], r["f"]) for r in got] == [(1, 0, [1.0, 2.0, 4.0]), (1, 1, [4.0, 8.0, 16.0])]
    got = {r["signal_id"]: r for r in spark.sql("SELECT signal_id, wt_rms(y) AS rms, wt_preemphasis(y) AS p, wt_deemphasis(wt_preemphasis(y)) AS d FROM wt_signals").collect()}
    assert got[1]["rms"] == pytest.approx((341 / 5) ** 0.5) and got[1]["p"] == pytest.approx([1.0, 1.03, 2.06, 4.12, 8.24])
    assert got[1]["d"] == pytest.approx([1.0, 2.0, 4.0, 8.0, 16.0]) and got[3]["rms"] is None and got[3]["p"] is None


def test_windows_close_behind_the_watermark(spark, data, tmp_path):
    x = table(spark, data, "events")
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(x.schema).parquet(str(tmp_path / "in"))
    got = _run(st.windowed(stream), "windows_out", spark)
    want = st.windowed(x).toPandas()
    assert 0 < len(got) <= len(want)
    merged = pd.merge(got.assign(w=got["window"].map(str)), want.assign(w=want["window"].map(str)), on=["w", "event_type"])
    assert len(merged) == len(got) and (merged["n_x"] == merged["n_y"]).all()


def test_wav_round_trip(spark, tmp_path):
    from wavetide.sources.wav import read_wav, write_wav

    df = spark.createDataFrame([(1, [0.0, 0.5, -0.5, 0.25]), (2, [0.1] * 10)], "signal_id long, y array<double>")
    write_wav(df, f"file://{tmp_path}/w", sr=100)
    got = {r["name"]: r for r in read_wav(spark, f"file://{tmp_path}/w").collect()}
    assert got["1.wav"]["y"] == [0.0, 0.5, -0.5, 0.25] and got["2.wav"]["n"] == 10 and got["2.wav"]["sr"] == 100.0


def test_grouped_kernels_take_samples_as_they_are(spark, data):
    from wavetide.operators import kernels as K

    samples = long(spark, data)
    got = K.apply_grouped(samples, lambda v: dsp.stft(v, 16, 4, center=False).real ** 2, ("v",), "frames").toPandas().sort_values(["signal_id", "t"])
    want = K.apply(wide(spark, data), lambda v: dsp.stft(v, 16, 4, center=False).real ** 2, ("y",), "frames").toPandas().sort_values(["signal_id", "t"])
    assert got["f"].map(list).tolist() == want["f"].map(list).tolist() and len(got)
    odd = spark.createDataFrame([(None, 1, 2.0), (None, 0, None), (5, 0, 1.0)], "signal_id long, n long, v double")
    rows = {r.signal_id: r.y for r in K.apply_grouped(odd, lambda v: v, ("v",), "signal").collect()}
    assert rows[5] == [1.0] and np.isnan(rows[None][0]) and rows[None][1] == 2.0


def test_frames_as_a_table_function_of_sql(spark, data):
    from wavetide.functions import sql

    sql.register(spark)
    wide(spark, data).createOrReplaceTempView("signals_of_users")
    got = spark.sql("SELECT signal_id, t, f FROM wt_frame_table(TABLE(SELECT CAST(signal_id AS BIGINT) AS signal_id, y FROM signals_of_users), 16, 4)").toPandas().sort_values(["signal_id", "t"])
    want = S.frame(wide(spark, data), 16, 4).toPandas().sort_values(["signal_id", "t"])
    assert got["f"].map(list).tolist() == want["f"].map(list).tolist()
    none = "SELECT CAST(1 AS BIGINT) AS signal_id, CAST(NULL AS array<double>) AS y"
    assert spark.sql(f"SELECT * FROM wt_frame_table(TABLE({none}), 4, 2)").count() == 0

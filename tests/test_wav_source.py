"""The data source of WAV files: ranges of bytes, headers alone, codings, and a sink that commits."""

import io
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetide.operators import long as L
from wavetide.sources import wav_source as W


def riff(fmt: bytes, data: bytes, before: bytes = b"") -> bytes:
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + before + struct.pack("<4sI", b"data", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def layout(coding, channels, rate, bits):
    return struct.pack("<HHIIHH", coding, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)


@pytest.fixture
def source(spark):
    spark.dataSource.register(W.WavSource)
    return spark


def test_chunks_of_byte_ranges_are_the_signal(source, tmp_path):
    y = np.random.default_rng(1).integers(-30000, 30000, (5003, 2)).astype("<i2")
    with wave.open(str(tmp_path / "long.wav"), "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(y.tobytes())
    (tmp_path / "short.WAV").write_bytes(riff(layout(1, 1, 100, 8), bytes([128, 255, 0]), struct.pack("<4sI3sx", b"LIST", 3, b"abc")))
    (tmp_path / "_writing-x").mkdir()
    (tmp_path / "_writing-x" / "half.wav").write_bytes(b"RIFF")
    df = source.read.format("wav").option("chunk", 100).option("range", 1500).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 15
    rows = df.orderBy("name", "chunk").collect()
    got = [r for r in rows if r.name == "long.wav"]
    assert [r.chunk for r in got] == list(range(51)) and (got[0].sr, got[0].channels, got[0].n, got[0].duration) == (8000.0, 2, 5003, 5003 / 8000)
    assert np.array_equal(np.concatenate([r.y for r in got]), (y / 32768).mean(axis=1))
    assert [r.y for r in rows if r.name == "short.WAV"] == [[0.0, 127 / 128, -1.0]]
    signals = df.where("name = 'long.wav'").select(F.col("name").alias("signal_id"), "chunk", "y")
    frames = L.stft(signals, 64, 16, size=100).count()  # chunks go straight into the operators for long signals
    assert frames == 1 + 5003 // 16


@pytest.mark.parametrize("coding, bits, raw, want", [(1, 24, b"\x00\x00\x40\x00\x00\x80\xff\xff\xff", [0.5, -1.0, -1 / (1 << 23)]), (1, 32, struct.pack("<2i", 1 << 30, -(1 << 31)), [0.5, -1.0]), (3, 32, struct.pack("<2f", 0.25, -1), [0.25, -1.0]), (3, 64, struct.pack("<2d", 0.1, 3), [0.1, 3.0])])
def test_codings(source, tmp_path, coding, bits, raw, want):
    (tmp_path / "a.wav").write_bytes(riff(layout(coding, 1, 44100, bits), raw))
    assert source.read.format("wav").load(str(tmp_path)).first().y == want


def test_headers_take_a_few_bytes_of_a_large_file(source, tmp_path):
    class Counted(io.FileIO):
        read_ = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.read_ += len(out)
            return out

    size = 1_000_000_000
    head = riff(layout(1, 1, 16000, 16), b"")[:-4] + struct.pack("<I", size)
    with open(tmp_path / "big.wav", "wb") as f:  # a file with a hole: nothing is stored
        f.write(head)
        f.truncate(len(head) + size)
    with Counted(tmp_path / "big.wav") as f:
        h = W.read_header(f, os.path.getsize(tmp_path / "big.wav"), "big.wav")
    assert (h.rate, h.n) == (16000, size // 2) and Counted.read_ < 100
    row = W.audio_info(source, str(tmp_path)).first()
    assert (row.name, row.n, row.duration) == ("big.wav", size // 2, size / 2 / 16000)


def test_other_formats_are_named(tmp_path):
    for raw, said in ((b"fLaC\0\0\0\0\0\0\0\0", "FLAC"), (b"OggS\0\0\0\0\0\0\0\0", "Ogg"), (b"hello world..", "not a WAV"), (riff(layout(85, 1, 8000, 16), b"ab"), "coding 85"), (b"RIFF\0\0\0\0WAVE", "no samples")):
        with pytest.raises(ValueError, match=said):
            W.read_header(io.BytesIO(raw), len(raw), "x.wav")


def test_a_job_is_published_as_a_whole(source, tmp_path):
    y = {str(k): np.sin(np.arange(50) * k / 10) for k in range(7)}
    df = source.createDataFrame([(k, v.tolist()) for k, v in y.items()] + [("none", None)], "signal_id string, y array<double>").repartition(3)
    df.write.format("wav").option("sr", 500).mode("append").save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(f"{k}.wav" for k in [*y, "none"])
    back = {r.name: r for r in source.read.format("wav").load(str(tmp_path)).collect()}
    assert all(np.allclose(back[f"{k}.wav"].y, v, atol=1 / 32768) and back[f"{k}.wav"].sr == 500 for k, v in y.items())
    fail = F.udf(lambda k: 1 / 0 if k == "3" else k, "string")
    with pytest.raises(Exception):
        df.select(fail("signal_id").alias("signal_id"), F.lit(None).cast("array<double>").alias("y")).write.format("wav").mode("append").save(str(tmp_path))
    seen = lambda: sorted(x for x in os.listdir(tmp_path) if not x.startswith("_"))  # noqa: E731  a task may outlive its job
    assert seen() == sorted(f"{k}.wav" for k in [*y, "none"]) and source.read.format("wav").load(str(tmp_path)).count() == 8
    df.where("signal_id = '2'").write.format("wav").option("sr", 500).mode("overwrite").save(str(tmp_path))
    assert seen() == ["2.wav"]

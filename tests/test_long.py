"""Chunked signals against the kernels on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetide.kernels import dsp, recursion
from wavetide.operators import long as L


def chunks_of(spark, signals, size):
    rows = [(k, c, y[c * size : (c + 1) * size].tolist()) for k, y in signals.items() for c in range(-(-len(y) // size))]
    return spark.createDataFrame(rows, "signal_id long, chunk long, y array<double>").repartition(7)


def whole(df, size):
    out = {}
    for r in df.orderBy("signal_id", "chunk").collect():
        assert r.chunk * size == len(out.setdefault(r.signal_id, []))
        out[r.signal_id] += r.y
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(2)
    return {k: rng.normal(size=n).cumsum() for k, n in enumerate((5000, 300, 64, 63, 65, 17, 1, 128))}


@pytest.mark.parametrize("size", [64, 10])
@pytest.mark.parametrize("args", [dict(n_fft=64, hop_length=16), dict(n_fft=32, hop_length=40), dict(n_fft=16, hop_length=5, win_length=12, window="hamming", pad_mode="reflect"), dict(n_fft=16, hop_length=16, center=False), dict(n_fft=64, hop_length=7, pad_mode="edge")])
def test_stft_and_back_equal_the_kernels_bit_for_bit(spark, signals, size, args):
    frames = L.stft(chunks_of(spark, signals, size), size=size, **args)
    rows = frames.orderBy("signal_id", "t").collect()
    spectra = {}
    for k, y in signals.items():
        got = np.array([np.array(r.re) + 1j * np.array(r.im) for r in rows if r.signal_id == k])
        try:
            want = dsp.stft(y, **args)
        except ValueError:  # shorter than a frame
            assert not len(got)
            continue
        assert [r.t for r in rows if r.signal_id == k] == list(range(len(want))) and np.array_equal(got, want)
        spectra[k] = want
    back = {k: v for k in args if (v := args[k]) is not None and k not in ("pad_mode",)}
    got = whole(L.istft(frames, size=size, **back), size)
    for k, d in spectra.items():
        want = dsp.istft(d, **back)
        assert np.array_equal(got.get(k, want[:0]), want)


def test_frames_and_preemphasis(spark, signals):
    df = chunks_of(spark, signals, 64)
    rows = L.frame(df, 20, 6, 64).where("signal_id = 0").orderBy("t").collect()
    assert np.array_equal([r.f for r in rows], dsp.frame(signals[0], 20, 6))
    got = whole(L.preemphasis(df, 0.9, 64), 64)
    assert all(np.array_equal(got[k], dsp.preemphasis(y, 0.9)) for k, y in signals.items())


def sections_one_by_one(sos, x):
    y = np.array(x, float)
    for b0, b1, b2, a0, a1, a2 in sos:
        z0 = z1 = 0.0
        for k, v in enumerate(y):
            y[k] = (b0 * v) / a0 + z0
            z0, z1 = (b1 * v - a1 * y[k]) / a0 + z1, (b2 * v - a2 * y[k]) / a0
    return y


@pytest.mark.parametrize("fan", [3, 512])
def test_recursions_equal_the_sequential_filter(spark, signals, monkeypatch, fan):
    monkeypatch.setattr(L.chunk_states, "__defaults__", (fan,))  # with 3, states go through a tree of five levels
    sos = dsp.elliptic_bandpass(0.2, 0.4, 1.0, 40.0, 2)
    df = chunks_of(spark, signals, 64)
    got, plain = whole(L.sosfilt(df, sos), 64), whole(L.deemphasis(df), 64)
    for k, y in signals.items():
        want, held = sections_one_by_one(sos, y), 0.0
        assert np.abs(got[k] - want).max() <= 1e-12 * max(1, np.abs(y).max())
        for n, v in enumerate(y):
            held = v + 0.97 * held
            assert abs(plain[k][n] - held) <= 1e-11 * max(1, np.abs(y).max())


def test_pcen_of_many_frames(spark):
    s = np.abs(np.random.default_rng(4).normal(size=(500, 5)))
    df = spark.createDataFrame([("x", t, row.tolist()) for t, row in enumerate(s)], "signal_id string, t long, f array<double>").repartition(3)
    got = L.pcen(df, size=16, sr=64, hop_length=4, gain=0.8).orderBy("t").collect()
    assert np.abs(np.array([r.f for r in got]) - dsp.pcen(s, sr=64, hop_length=4, gain=0.8)).max() < 1e-12


def test_blocks_of_a_filter_equal_single_steps():
    x = np.random.default_rng(5).normal(size=400)
    for sos in (dsp.elliptic_bandpass(0.1, 0.15, 1.0, 50.0, 3), dsp.semitone_filterbank()[0][3]):
        assert np.abs(dsp.sosfilt(sos, x)[0] - sections_one_by_one(sos, x)).max() < 1e-12
    a = np.array([[0.5, 0.1], [0.2, 0.3]])
    before, n, own = recursion.through(a, [2, 3], [np.array([1.0, 0]), np.array([0, 1.0])], np.array([1.0, 1.0]))
    assert n == 5 and np.allclose(before[1], a @ a @ [1, 1] + [1, 0]) and np.allclose(own, a @ a @ a @ [1, 0] + [0, 1])


def test_samples_and_chunks(spark, signals):
    df = chunks_of(spark, signals, 10)
    back = L.chunked(L.samples_of(df, 10), 64)
    assert all(np.array_equal(y, signals[k]) for k, y in whole(back, 64).items())
    empty = df.limit(0)
    assert not L.stft(empty, 16, size=10).collect() and not L.sosfilt(empty, [[1, 0, 0, 1, 0, 0]]).collect()
    assert df.select(F.max("chunk")).first()[0] == 499

"""Kernels that SQL doesn't say, against their definitions written out or what they must keep."""

import math

import numpy as np
import pytest

from wavetide.kernels import dsp, features, sequence
from wavetide.operators import kernels as K
from wavetide.plans import banks

SR = 1000.0


@pytest.fixture(scope="module")
def y():
    t = np.arange(1500) / SR
    return np.sin(2 * np.pi * 110 * t) + 0.5 * np.sin(2 * np.pi * 220 * t + 1) + 0.01 * np.random.default_rng(5).normal(size=len(t))


def stretched_phases(d, rate, hop):
    """Phase vocoder, a frame and a bin at a time."""
    n_fft, times = 2 * (d.shape[1] - 1), np.arange(0, len(d), rate)
    out, phase = np.zeros((len(times), d.shape[1]), complex), np.angle(d[0])
    for k, at in enumerate(times):
        a, b, part = d[int(at)], d[min(int(at) + 1, len(d) - 1)], at - int(at)
        for m in range(d.shape[1]):
            out[k, m] = ((1 - part) * abs(a[m]) + part * abs(b[m])) * np.exp(1j * phase[m])
            due = 2 * np.pi * hop * m / n_fft
            turn = np.angle(b[m]) - np.angle(a[m]) - due
            phase[m] += due + turn - 2 * np.pi * round(turn / (2 * np.pi))
    return out


@pytest.mark.parametrize("rate", [0.8, 1.25, 2.0])
def test_time_stretch_is_a_phase_vocoder(y, rate):
    got = dsp.time_stretch(y, rate, 64, 16)
    want = dsp.istft(stretched_phases(dsp.stft(y, 64, 16), rate, 16), 16, n_fft=64)
    n = round(len(y) / rate)
    want = np.pad(want, (0, max(0, n - len(want))))[:n]
    assert len(got) == n and np.allclose(got, want, atol=1e-6)


def test_pitch_shift_keeps_the_length_and_moves_the_tone(y):
    got = dsp.pitch_shift(y, SR, 5, n_fft=256)
    rate = 2 ** (-5 / 12)
    assert np.allclose(got, dsp.fix_length(dsp.resample(dsp.time_stretch(y, rate, 256), SR / rate, SR), len(y)))
    peak = np.argmax(np.abs(np.fft.rfft(got[200:1200] * np.hanning(1000))))
    assert len(got) == len(y) and abs(peak - 110 * 2 ** (5 / 12)) <= 1.5


def test_scale_transform_of_a_cubic_is_exact():
    """The spline of a cubic is the cubic."""
    n, n_fmt, t_min = 40, 32, 0.5
    x = np.arange(n) / n
    f = lambda v: 2 * v**3 - v**2 + 0.3 * v + 1
    grid = [max(t_min / n, min(x[-1], (t_min / n) ** (1 - k / (n_fmt + 1)))) for k in range(n_fmt)]
    want = [sum(f(g) * math.sqrt(g) * np.exp(-2j * np.pi * k * m / n_fmt) for m, g in enumerate(grid)) * math.sqrt(n) / n_fmt for k in range(n_fmt // 2 + 1)]
    assert np.allclose(dsp.fmt(f(x), t_min, n_fmt), want, atol=1e-9)


def test_constant_q_comes_back(y):
    args = dict(sr=SR, hop_length=16, fmin=55.0, bins_per_octave=24)
    c = features.cqt(y, n_bins=72, **args)
    back = features.icqt(c, length=len(y), **args)
    inner = slice(300, 1200)
    assert np.corrcoef(y[inner], back[inner])[0, 1] > 0.99 and 0.8 < back[inner].std() / y[inner].std() < 1.2


def test_griffinlim_of_a_constant_q_comes_nearer(y):
    args = dict(sr=SR, hop_length=16, fmin=55.0, bins_per_octave=12)
    c = np.abs(features.cqt(y, n_bins=36, **args))

    def away(n_iter):
        again = np.abs(features.cqt(features.griffinlim_cqt(c, n_iter=n_iter, length=len(y), init_phase="zeros", **args), n_bins=36, **args))
        return np.linalg.norm(again[5:-5] - c[5 : 5 + len(again) - 10]) / np.linalg.norm(c)

    assert away(16) < away(1) and away(16) < 0.5


def test_variable_q_chroma_sums_pitch_classes(spark, y):
    v = np.abs(features.vqt(y, SR, 16, 55.0, 24, 10.0, 12))
    df = spark.createDataFrame([(1, v.tolist())], "signal_id long, S array<array<double>>")
    got = np.array([r.f for r in K.chroma_vqt(df, fmin=55.0).orderBy("t").collect()])
    want = np.zeros((len(v), 12))
    for k in range(24):  # 55 Hz is an A, the tenth of the classes from C
        want[:, (k + 9) % 12] += v[:, k]
    assert np.allclose(got, want / want.max(axis=1, keepdims=True))


def test_mel_and_cepstra_to_audio_are_chains(spark, y):
    s = np.abs(dsp.stft(y, 64, 16)) ** 2
    m = s @ banks.mel(SR, 64, 12).T
    lines = features.mel_to_stft(m, SR, 64)
    assert np.allclose(lines**2 @ banks.mel(SR, 64, 12).T, m, rtol=0.05, atol=0.05 * m.max()) and (lines >= 0).all()
    df = spark.createDataFrame([(1, m.tolist(), features.mfcc(dsp.power_to_db(m), 12).tolist())], "signal_id long, S array<array<double>>, C array<array<double>>")
    got = K.mel_to_audio(df, sr=SR, n_fft=64, n_iter=3, hop_length=16, init_phase="zeros").first().y
    assert np.allclose(got, dsp.griffinlim(lines, n_fft=64, n_iter=3, hop_length=16, init_phase="zeros"))
    cepstra = df.select("signal_id", df.C.alias("S"))
    got = K.mfcc_to_audio(cepstra, n_mels=12, sr=SR, n_fft=64, n_iter=3, hop_length=16, init_phase="zeros").first().y
    m = features.mfcc_to_mel(features.mfcc(dsp.power_to_db(m), 12), 12)
    assert np.allclose(got, dsp.griffinlim(features.mel_to_stft(m, SR, 64), n_fft=64, n_iter=3, hop_length=16, init_phase="zeros"), atol=1e-6)


def mirrored(i, n):
    return min(-i, n - 1) if i < 0 else i if i < n else max(0, 2 * n - 2 - i)


def test_paths_are_the_best_of_turned_diagonals():
    rec = np.random.default_rng(1).random((9, 9))
    best = np.full((9, 9), -np.inf)
    for ratio in 2.0 ** np.linspace(-1, 1, 4):
        f = banks.diagonal_filter("hann", 5, float(ratio))
        for i in range(9):
            for j in range(9):
                best[i, j] = max(best[i, j], sum(f[a, b] * rec[mirrored(i + a - 2, 9), mirrored(j + b - 2, 9)] for a in range(5) for b in range(5)))
    assert np.allclose(sequence.path_enhance(rec, 5, n_filters=4), np.maximum(best, 0))


def test_a_filter_along_lags(spark):
    rec = np.random.default_rng(2).random((6, 6))
    df = spark.createDataFrame([(1, rec.tolist())], "signal_id long, S array<array<double>>")
    got = np.array([r.f for r in K.timelag_filter(df, fn=lambda x: sequence.median_filter_2d(x, (1, 3))).orderBy("t").collect()])
    lag = np.zeros((12, 6))
    for j in range(6):
        for i in range(6):
            lag[(i - j) % 12, j] = rec[i, j]
    smooth = np.array([[np.median([lag[a, mirrored(j + k, 6)] for k in (-1, 0, 1)]) for j in range(6)] for a in range(12)])
    assert np.allclose(got, [[smooth[(i - j) % 12, j] for j in range(6)] for i in range(6)])


def test_segments_are_cut_into_runs():
    data = np.repeat(np.arange(8.0), [3, 2, 4, 1, 5, 2, 2, 3])[:, None]
    assert sequence.subsegment(data, [10, 17], 2).tolist() == [0, 5, 10, 15, 17, 19]
    assert sequence.subsegment(data, [], 8).tolist() == [0, 3, 5, 9, 10, 15, 17, 19]


@pytest.mark.parametrize("knight", [True, False])
def test_alignment_scores_and_their_path(knight):
    rng = np.random.default_rng(3)
    for _ in range(20):
        sim = np.maximum(0, rng.normal(size=(7, 8)))
        score, path = sequence.rqa(sim, 0.5, 0.3, knight)
        moves, want, from_ = [(1, 1), (1, 2), (2, 1)] if knight else [(1, 1)], sim.copy(), {}
        for i in range(1, 7):
            for j in range(1, 8):
                ways = [(i - a, j - b) for a, b in moves if i >= a and j >= b]
                value = [want[w] - (0 if sim[i, j] > 0 else 0.5 if sim[w] > 0 else 0.3) for w in ways]
                best = max(range(len(ways)), key=lambda k: (value[k], -k))
                want[i, j] = value[best] + sim[i, j] if sim[i, j] > 0 else max(0, value[best])
                if sim[i, j] > 0 or want[i, j] > 0:
                    from_[i, j] = ways[best]
        assert np.allclose(score, want)
        at = tuple(map(int, np.unravel_index(np.argmax(want), want.shape)))
        cells = [at]
        while cells[-1] in from_:
            cells.append(from_[cells[-1]])
        if sim[cells[-1]] <= 0:  # the path ends where nothing is similar
            cells.pop()
        assert path == cells[::-1]


def test_splines_solve_the_full_system():
    rng = np.random.default_rng(8)
    for n in (4, 5, 6, 40):
        x, v = np.sort(rng.random(n)), rng.normal(size=n)
        h, slope = np.diff(x), np.diff(v) / np.diff(x)
        a, r = np.zeros((n, n)), np.zeros(n)
        a[0, :3], a[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2], r[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * (slope[i] - slope[i - 1])
        m, at = np.linalg.solve(a, r), np.linspace(x[0], x[-1], 50)
        k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        u, w = x[k + 1] - at, at - x[k]
        want = (m[k] * u**3 + m[k + 1] * w**3) / (6 * h[k]) + (v[k] / h[k] - m[k] * h[k] / 6) * u + (v[k + 1] / h[k] - m[k + 1] * h[k] / 6) * w
        assert np.allclose(dsp.cubic_spline(x, v, at), want, atol=1e-9)

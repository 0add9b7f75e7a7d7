"""Compositions and the semitone filters' powers against their definitions, written out."""

import math

import numpy as np
import pytest

from wavetide.kernels import compositions as C
from wavetide.kernels import dsp, features, rhythm, sequence

SR = 2000.0


@pytest.fixture(scope="module")
def y():
    rng = np.random.default_rng(9)
    t = np.arange(6000) / SR
    tones = sum(np.sin(2 * np.pi * f * t) * (t % 0.5 < w) for f, w in ((220, 0.3), (330, 0.2), (440, 0.1)))
    return tones * np.where(t < 1.5, 1.0, 0.4) + 0.05 * rng.normal(size=len(t))


def median(values):
    v = sorted(values)
    return v[len(v) // 2] if len(v) % 2 else (v[len(v) // 2 - 1] + v[len(v) // 2]) / 2


def plain_filter(s, neighbors, width):
    n, out = len(s), []
    neighbors = min(neighbors, max(1, n - 1))
    norm = [math.sqrt(sum(v * v for v in row)) or 1.0 for row in s]
    for i in range(n):
        scored = []
        for j in range(n):
            if abs(i - j) <= width and n > 2 * width + 1:
                continue
            scored.append((-sum(a * b for a, b in zip(s[i], s[j])) / (norm[i] * norm[j]), j))
        chosen = [j for _, j in sorted(scored)[:neighbors]] or [i]
        out.append([median([s[j][k] for j in chosen]) for k in range(len(s[0]))])
    return np.array(out)


@pytest.mark.parametrize("n, neighbors, width", [(30, 5, 2), (12, 20, 1), (4, 3, 2), (1, 3, 1)])
def test_median_of_similar_frames(n, neighbors, width):
    s = np.abs(np.random.default_rng(n).normal(size=(n, 6)))
    assert np.allclose(C.nn_filter_median(s, neighbors, width), plain_filter(s.tolist(), neighbors, width), atol=1e-12)


def test_beat_frames_and_their_medians():
    assert C.robust_beat_frames([3.4, 3.5, 9, 20, 50], 30).tolist() == [0, 3, 4, 9, 20, 30]
    assert C.robust_beat_frames([5, 6], 40).tolist() == [0, 5, 10, 15, 20, 25, 30, 35, 40]
    assert C.robust_beat_frames([], 10).tolist() == [0, 3, 6, 9, 10]
    s = np.random.default_rng(1).normal(size=(10, 2))
    assert np.allclose(C.sync_median(s, [3, 7, 7]), [[median(s[a:b, k].tolist()) for k in range(2)] for a, b in ((0, 3), (3, 7), (7, 10))])


def test_vocal_separation(y):
    full = np.abs(dsp.stft(y, 256, 64))
    front, back = C.separate_vocals(y, 200.0, 256, 64)
    shared = np.minimum(full, plain_filter(full.tolist(), 12, 3))
    rest = full - shared
    for got, x, other in ((front, rest, 10 * shared), (back, shared, 2 * rest)):
        assert np.allclose(got, full * x**2 / np.maximum(x**2 + other**2, 1e-300), atol=1e-9)


def test_music_sync(y):
    chroma = lambda x: (lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300))(np.abs(dsp.stft(x, 512, 128)) ** 2 @ features.banks.chroma(SR, 512, 12, 0.0).T)
    a, b = chroma(y), chroma(dsp.time_stretch(y, 1.32, 256, 64))
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = math.dist(a[i], b[j]) + min(d[i, j], d[i + 1, j], d[i, j + 1])
    path = C.sync_path(y, SR, 512, 128, stretch_fft=256, stretch_hop=64)
    assert path[0] == (len(a) - 1, len(b) - 1) and path[-1] == (0, 0)
    assert sum(math.dist(a[i], b[j]) for i, j in path) == pytest.approx(d[-1, -1], abs=1e-9)


def test_enhanced_chroma(y):
    got = C.enhanced_chroma(y, SR, 256, 64, n_octaves=2, fmin=110.0)
    d = dsp.stft(y, 256, 64)
    size = np.abs(d)
    harm, perc = sequence.median_filter_2d(size, (31, 1)), sequence.median_filter_2d(size, (1, 31))
    harmonic = dsp.istft(d * harm**2 / np.maximum(harm**2 + (8 * perc) ** 2, 1e-300), 64, length=len(y))
    c = features.chroma_audio(harmonic, SR, 64, 110.0, n_octaves=2, bins_per_octave=36)
    c = np.minimum(c, plain_filter(c.tolist(), min(8, max(2, len(c) // 4)), 2))
    want = [[median([c[min(max(t + x, 0), len(c) - 1), k] for x in range(-4, 5)]) for k in range(12)] for t in range(len(c))]
    assert np.allclose(got, want, atol=1e-9)


def test_structure(y):
    found = C.structure(y, SR, 256, 64, k=4)
    power = np.abs(dsp.stft(y, 256, 64)) ** 2
    chroma = features.chroma_stft(power, SR, 256, norm=2.0)
    beats = C.robust_beat_frames(rhythm.beat_track(rhythm.onset_envelope(y, SR, 256, 64), SR, 64, 112.0, trim=False)[1], len(chroma))
    synced = C.sync_median(chroma, beats)
    first = sequence.agglomerative(synced, 4)  # of the chroma itself, not of its recurrence plot
    assert found["borders"].tolist() == sorted({0, len(chroma), *beats[first].tolist()})
    assert found["beats"].tolist() == beats.tolist() and np.allclose(found["chroma"], synced)
    assert found["recurrence"].shape == found["paths"].shape == (len(synced),) * 2 and np.allclose(np.diag(found["recurrence"]), 1)


def test_superflux_and_presets(y):
    mel = np.abs(dsp.stft(y, 256, 64)) ** 2 @ features.banks.mel(SR, 256, 24, fmin=30.0, fmax=900.0).T
    db = 10 * np.log10(np.maximum(1e-10, mel))
    db = np.maximum(-80, db - db.max())
    ref = np.stack([db[:, max(0, k - 1) : k + 2].max(axis=1) for k in range(24)], axis=1)
    flux = np.concatenate([[0, 0], np.maximum(0, db[2:] - ref[:-2]).mean(axis=1)])
    env = (flux - flux.min()) / (flux - flux.min()).max()
    want, last = [], -99
    for i, v in enumerate(env):
        if v == env[max(0, i - 3) : i + 3].max() and v >= env[max(0, i - 3) : i + 5].mean() + 0.05 and i > last + 4:
            want.append(i)
            last = i
    assert C.superflux(y, SR, 256, 64, 24, 30.0, 900.0).tolist() == want and want
    half = dsp.resample(y, SR, SR / 2, "linear")
    levels = 10 * np.log10(np.maximum(1e-10, np.abs(dsp.stft(half, 256, 64)) ** 2 @ features.banks.mel(SR / 2, 256, 16).T))
    assert np.allclose(C.preset(y, SR, 256, 64, SR / 2, 16), np.maximum(-80, levels - levels.max()))


@pytest.mark.parametrize("center", [True, False])
def test_semitone_powers(center):
    sr, win, hop = 22050.0, 512, 128
    t = np.arange(3000) / sr
    y = np.sin(2 * np.pi * 440 * t) + 0.1 * np.random.default_rng(2).normal(size=3000)
    got = dsp.iirt(y, sr, win, hop, center)
    padded = np.concatenate([np.zeros(256), y, np.zeros(256)]) if center else y  # before it is resampled and filtered
    n = 1 + (len(padded) - win) // hop
    assert got.shape == (n, 85)
    banks, rates = dsp.semitone_filterbank()
    for k in (0, 40, 50, 84):
        x = dsp.sosfiltfilt(banks[k], padded if rates[k] == sr else dsp.resample(padded, sr, rates[k]))
        scale = sr / rates[k]
        for f in (0, 1, n // 2, n - 1):
            a, b = math.floor(f * hop / scale + 0.5), math.floor(win / scale + 0.5)
            assert got[f, k] == pytest.approx(scale * (x[a : a + b] ** 2).sum(), rel=1e-9, abs=1e-12)
    assert dsp.iirt(y[:100], sr, win, hop, False).shape == (1, 85)

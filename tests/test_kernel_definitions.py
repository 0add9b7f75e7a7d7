"""Kernels against their definitions, written out plainly."""

import math

import numpy as np
import pytest

from wavetide.functions import notation
from wavetide.kernels import dsp, features, rhythm, sequence
from wavetide.plans import banks

SR = 22050


def sine(hz, seconds=1.0, sr=SR):
    return np.sin(2 * np.pi * hz * np.arange(int(seconds * sr)) / sr)


@pytest.mark.parametrize("midi", [28, 44, 57, 69, 84, 99, 106])
def test_constant_q_gain_of_a_unit_sine_is_the_same_in_each_octave(midi):
    hz = 440.0 * 2.0 ** ((midi - 69) / 12)
    lengths, _ = banks.wavelet_lengths(banks.cqt_frequencies(84, features.C1), SR)
    c = np.abs(features.cqt(sine(hz, 2.0)))
    assert int(np.argmax(c[len(c) // 2])) == midi - 24
    assert c[len(c) // 2, midi - 24] == pytest.approx(math.sqrt(lengths[midi - 24]) / 2, rel=0.01)


def test_low_octaves_are_transformed_at_a_lower_rate():
    y = sine(110.0, 2.0)
    c = features.cqt(y, fmin=55.0, n_bins=24, hop_length=512)
    freqs = banks.cqt_frequencies(24, 55.0)
    lengths, cutoff = banks.wavelet_lengths(freqs, SR)
    halvings = min(math.ceil(math.log2(SR / 2 / cutoff)) - 2, 9 - 2 + 1)
    assert halvings >= 3 and np.abs(c[len(c) // 2, 12]) == pytest.approx(math.sqrt(lengths[12]) / 2, rel=0.01)


def test_pseudo_constant_q_weighs_wavelets_by_the_transform():
    freqs = banks.cqt_frequencies(12, 880.0)
    basis, lengths = banks.wavelet(freqs, SR)
    n = max(basis.shape[1], 1024)
    want = []
    for row, length in zip(basis, lengths):
        spectrum = np.fft.fft(np.pad(row, (0, n - len(row))) * length / n)[: n // 2 + 1]
        size = np.sort(np.abs(spectrum))
        least = size[np.flatnonzero(np.cumsum(size) / size.sum() >= 0.01)[0]]
        want.append(np.where(np.abs(spectrum) >= least, np.abs(spectrum), 0))
    y = sine(1000.0, 0.5)
    got = features.pseudo_cqt(y, fmin=880.0, n_bins=12)
    assert np.allclose(got, np.abs(dsp.stft(y, n, 512)) @ np.array(want).T / math.sqrt(n))


def test_salience_keeps_maxima_of_the_weighted_sum():
    rng = np.random.default_rng(1)
    s, freqs = rng.random((5, 20)), np.arange(20.0) * 10
    got = features.salience(s, freqs, [1, 2], [1.0, 3.0], fill_value=-1.0)
    for t in range(5):
        total = [0.25 * s[t, k] + 0.75 * (s[t, 2 * k] if 2 * k < 20 else -1.0) for k in range(20)]
        peaks = [k for k in range(1, 20) if total[k] > total[k - 1] and (k == 19 or total[k] >= total[k + 1])]
        assert np.allclose(got[t], [total[k] if k in peaks else 0.0 for k in range(20)])


def test_griffinlim_from_zero_phase():
    s = np.abs(dsp.stft(sine(440.0, 0.2) + 0.3 * sine(900.0, 0.2), 256, 64))
    now = before = s.astype(complex)
    for k in range(3):
        again = dsp.stft(dsp.istft(now, 64), 256, 64)
        turn = again / np.abs(again)
        if k:
            turn = turn - 0.5 * np.where(before == 0, 1.0, before / np.where(before == 0, 1.0, np.abs(before)))
            turn = turn / np.abs(turn)
        before, now = now, s * turn
    assert np.allclose(dsp.griffinlim(s, 3, 64, momentum=0.5, init_phase="zeros"), dsp.istft(now, 64))


def test_mirror_stops_at_the_other_end():
    x = np.arange(1.0, 6.0)[:, None]
    assert sequence.pad_reflect(x, 7, 0)[:, 0].tolist() == [5, 5, 5, 5, 4, 3, 2, 1, 2, 3, 4, 5, 4, 3, 2, 1, 1, 1, 1]
    s = np.random.default_rng(2).random((4, 3))
    at = lambda i, n: min(-i, n - 1) if i < 0 else i if i < n else max(0, 2 * n - 2 - i)
    want = [[np.median([s[at(i + a, 4), at(j + b, 3)] for a in range(-4, 5) for b in range(-2, 3)]) for j in range(3)] for i in range(4)]
    assert np.allclose(sequence.median_filter_2d(s, (9, 5)), want)


def differences(x, low, high):
    d = [sum(v * v for v in x)]
    energy = np.cumsum(x**2)
    out, total = [], 0.0
    for k in range(1, high + 1):
        value = 2 * (d[0] - float(x[k:] @ x[:-k])) - energy[k - 1]
        total += value
        out.append(value / (total / k))
    return np.array(out[low - 1 :])


def test_yin_of_noisy_tones():
    rng = np.random.default_rng(3)
    y = sine(5.0, 6.0, 64) + 0.2 * rng.normal(size=384)
    got = features.yin(y, 2.0, 16.0, 64.0, 128, 32, center=False)
    for t, f0 in enumerate(got):
        x = differences(y[32 * t : 32 * t + 128], 4, 32)
        troughs = [i for i in range(len(x) - 1) if x[i] < (x[i - 1] if i else np.inf) and (x[i] < x[1] if i == 0 else x[i] <= x[i + 1]) and x[i] < 0.1]
        at = troughs[0] if troughs else int(np.argmin(x))
        shift = 0.0
        if 0 < at < len(x) - 1:
            a, b = x[at + 1] + x[at - 1] - 2 * x[at], (x[at + 1] - x[at - 1]) / 2
            shift = 0.0 if abs(b) >= abs(a) else -b / a
        assert f0 == pytest.approx(64.0 / (4 + at + shift))
    with pytest.raises(ValueError):
        features.yin(y, 0.1, 16.0, 64.0, 128, 32)


def test_pyin_follows_a_tone():
    f0, voiced, prob = features.pyin(sine(440.0), 65.0, 2093.0)
    assert voiced[4:-4].all() and np.allclose(f0[4:-4], 440.0, rtol=0.006) and (prob[4:-4] > 0.9).all()


def test_tempogram_ramps():
    env = np.array([3.0, 1.0, 4.0, 1.0, 5.0, 8.0])
    pad = [3.0 * i / 4 for i in range(4)] + env.tolist() + [8.0 * (4 - i) / 4 for i in range(4)]
    w = banks.get_window("hann", 8)
    for t, row in enumerate(rhythm.tempogram(env, 8, norm=None)):
        x = np.array(pad[t : t + 8]) * w
        assert np.allclose(row, [x[k:] @ x[: 8 - k] for k in range(8)])


def test_the_largest_tempo_counts():
    tg = np.zeros((1, 8))
    tg[0, 2] = 1.0
    bpm = banks.tempo_frequencies(8, 4, 64.0)
    got, score = rhythm._scores(tg, 64.0, 4, 120.0, 1.0, float(bpm[2]))
    assert np.isfinite(score[0, 2]) and not np.isfinite(score[0, 1]) and got[2] == bpm[2]


def test_beats_without_a_tempo_or_onsets():
    for env, bpm in ((np.ones(9), 0.0), (np.ones(9), -3.0), (np.zeros(9), 120.0), (np.empty(0), None)):
        tempo, beats = rhythm.beat_track(env, bpm=bpm)
        assert tempo == 0.0 and len(beats) == 0


def test_factors_without_negative_values():
    v = np.random.default_rng(4).random((7, 9))
    w, h = sequence.nmf(v, 3, max_iter=12, tol=0.0)
    u, d, vt = np.linalg.svd(v, full_matrices=False)
    a, b = np.zeros((7, 3)), np.zeros((3, 9))
    for j in range(3):
        x, y = u[:, j], vt[j]
        sides = [(np.abs(x), np.abs(y))] if j == 0 else [(np.maximum(z * x, 0), np.maximum(z * y, 0)) for z in (1, -1)]
        p, q = max(sides, key=lambda s: np.linalg.norm(s[0]) * np.linalg.norm(s[1]))
        size = np.linalg.norm(p) * np.linalg.norm(q)
        a[:, j], b[j] = np.sqrt(d[j] * size) * p / np.linalg.norm(p), np.sqrt(d[j] * size) * q / np.linalg.norm(q)
    eps = np.finfo(float).eps
    a, b = np.maximum(a, np.sqrt(eps) * v.mean()), np.maximum(b, np.sqrt(eps) * v.mean())
    for _ in range(12):
        b = np.maximum(eps, b * (a.T @ v) / (a.T @ a @ b + eps))
        a = np.maximum(eps, a * (v @ b.T) / (a @ b @ b.T + eps))
    assert np.allclose(w, a) and np.allclose(h, b)


def test_widths_below_half_the_frames():
    x = np.random.default_rng(5).random((9, 2))
    sequence.recurrence_matrix(x, k=2, width=3)
    for width in (0, 4):
        with pytest.raises(ValueError):
            sequence.recurrence_matrix(x, k=2, width=width)


def test_frames_without_links_have_no_component():
    rec = np.zeros((4, 4))
    rec[0, 1] = rec[1, 0] = 1.0
    out = sequence.laplacian_components(rec, 4)
    assert np.allclose(np.linalg.norm(out, axis=1), 1.0)
    assert sequence.laplacian_components(rec, 2, median_rows=3).shape == (4, 2)


def test_only_the_first_of_equal_peaks_makes_a_pulse():
    env = np.zeros(64)
    env[::8] = 1.0
    pulse = rhythm.plp(env, 64.0, 4, 16, 60.0, 400.0)
    assert pulse.max() == 1.0 and pulse.min() >= 0.0 and len(pulse) == 64


#: Intervals and their names.
INTERVALS = {1.0: "C", 1.5: "G", 1.25: "E^5", 1.2: "Eb_5", 1.75: "Bb^7", 1.220703125: "Eb^625", 1.0546875: "Db^5", 1.992187: "C^85", 1.627604: "Ab^625"}


@pytest.mark.parametrize("ratio", INTERVALS)
def test_interval_names(ratio):
    assert notation.interval_to_fjs(ratio, unicode=False) == INTERVALS[ratio]


def test_features_of_signals_equal_those_of_their_spectra():
    y = sine(452.0, 1.0) + 0.5 * sine(678.0, 1.0)
    s = np.abs(dsp.stft(y, 2048))
    tuning = features.estimate_tuning_audio(y)
    assert tuning == features.estimate_tuning(s) and 0.3 < tuning < 0.6
    c = np.abs(features.cqt(y, n_bins=84, tuning=tuning))
    assert np.allclose(c, np.abs(features.cqt(y, n_bins=84, tuning=None)))
    assert np.allclose(features.chroma_audio(y, bins_per_octave=12), features.chroma_cqt(c, bins_per_octave=12))
    assert np.allclose(features.chroma_cens_audio(y, bins_per_octave=12, win_len_smooth=5), features.chroma_cens(features.chroma_cqt(c, norm=None, bins_per_octave=12), win_len_smooth=5))
    assert np.allclose(features.spectral_contrast_audio(y), features.spectral_contrast(np.abs(dsp.stft(y, 2048, 512)), banks.fft_frequencies(SR, 2048)))
    assert np.allclose(features.hybrid_cqt(y, tuning=None), features.hybrid_cqt(y, tuning=tuning))


@pytest.mark.parametrize("a, b", [(2, 18), (1, 1), (5, 2), (1, 7)])
def test_beta_distribution_of_whole_parameters_is_a_polynomial(a, b):
    """For whole a and b the function is a binomial tail."""
    from fractions import Fraction
    from math import comb

    for k in range(0, 101, 4):
        x = Fraction(k, 100)
        want = sum(comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a, a + b))
        assert abs(features.beta_cdf(np.array([k / 100]), a, b)[0] - float(want)) < 1e-14


def test_beta_distribution_of_halves():
    x = np.linspace(0, 1, 101)
    assert np.abs(features.beta_cdf(x, 0.5, 0.5) - 2 / np.pi * np.arcsin(np.sqrt(x))).max() < 1e-13
    assert np.abs(features.beta_cdf(x, 2.5, 1.0) - x**2.5).max() < 1e-13


def test_nnls_meets_the_conditions_of_optimality():
    rng = np.random.default_rng(11)
    for m, n in ((30, 8), (8, 12), (40, 25), (6, 1)):
        a, b = rng.normal(size=(m, n)), rng.normal(size=(m, 20))
        if n > 2:
            a[:, 1] = a[:, 0]  # dependent columns
        x = features.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-8 and np.abs(slope * x).max() < 1e-8
    assert not features.nnls(np.eye(3), -np.ones((3, 2))).any() and features.nnls(np.zeros((4, 2)), np.ones((4, 1))).tolist() == [[0.0], [0.0]]

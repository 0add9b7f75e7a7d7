"""Kernels against independent statements of the same thing: round trips, naive sums, known answers."""

import numpy as np
import pytest

from wavetide.functions import notation
from wavetide.kernels import dsp, features, rhythm, sequence
from wavetide.plans import banks

RNG = np.random.default_rng(0)


def test_stft_equals_naive_sums():
    y = RNG.normal(size=60)
    d = dsp.stft(y, 16, 4, center=False)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    for t in (0, 5, len(d) - 1):
        for k in (0, 3, 8):
            assert np.isclose(d[t, k], (y[4 * t : 4 * t + 16] * w * np.exp(-2j * np.pi * k * np.arange(16) / 16)).sum())


@pytest.mark.parametrize("n_fft,hop", [(256, 64), (512, 128), (128, 32)])
def test_istft_inverts_stft(n_fft, hop):
    y = RNG.normal(size=hop * 40)
    assert np.allclose(dsp.istft(dsp.stft(y, n_fft, hop), hop, length=len(y)), y)


def test_stft_refuses_short_signals_and_unknown_windows():
    with pytest.raises(ValueError):
        dsp.stft(np.zeros(4), 16, 4, center=False)
    with pytest.raises(ValueError):
        banks.get_window("nosuch", 8)


def test_windows():
    assert np.allclose(banks.get_window("hann", 4), [0, 0.5, 1, 0.5])
    assert np.allclose(banks.get_window("kaiser", 8), banks.get_window("hann", 8))
    assert np.allclose(banks.get_window("triangle", 8), banks.get_window("bartlett", 8))


def test_tones_resample_and_keep_their_pitch():
    y = dsp.tone(440, length=22050)
    assert np.abs(dsp.resample(y, 22050, 8000)[100:300] - dsp.tone(440, sr=8000, length=8000)[100:300]).max() < 1e-6
    assert len(dsp.resample(y, 22050, 8000, "linear")) == 8000
    assert np.allclose(features.yin(y, 65, 2093)[5:30], 440, atol=0.5)
    assert np.abs(features.cqt(y)).mean(axis=0).argmax() == 45
    assert abs(features.estimate_tuning(np.abs(dsp.stft(y)))) <= 0.02


def test_pyin_finds_a_voiced_tone():
    f0, voiced, prob = features.pyin(dsp.tone(440, length=8000), 200, 800, resolution=0.5)
    assert voiced[3:8].all() and np.allclose(f0[3:8], 440, rtol=0.03) and (prob[3:8] > 0.5).all()


def test_elliptic_filters_pass_their_band():
    banks_, rates = dsp.semitone_filterbank()
    sos, rate = banks_[45], rates[45]

    def gain(f):
        z = np.exp(-2j * np.pi * f / rate)
        return abs(np.prod([(s[0] + s[1] * z + s[2] * z * z) / (s[3] + s[4] * z + s[5] * z * z) for s in sos]))

    centre = banks.mr_frequencies()[0][45]
    assert 0.88 < gain(centre) < 1.01 and gain(centre * 1.2) < 0.01 and gain(centre / 1.2) < 0.01


def test_sosfilt_state_carries_over():
    sos = dsp.elliptic_bandpass(0.2, 0.4, 1.0, 40.0, 2)
    x = RNG.normal(size=100)
    whole, _ = dsp.sosfilt(sos, x)
    a, z = dsp.sosfilt(sos, x[:37])
    b, _ = dsp.sosfilt(sos, x[37:], z)
    assert np.allclose(np.concatenate([a, b]), whole)
    y, _ = dsp.sosfilt(sos, np.ones(50), dsp.sosfilt_zi(sos))
    assert np.allclose(y, y[0])


def test_deemphasis_inverts_preemphasis():
    y = RNG.normal(size=50)
    assert np.allclose(dsp.deemphasis(dsp.preemphasis(y)), y)


def test_trim_and_split_find_the_loud_part():
    y = np.concatenate([np.zeros(4000), dsp.tone(440, length=4000), np.zeros(4000)])
    (a, b), spans = dsp.trim(y, frame_length=512, hop_length=128), dsp.split(y, frame_length=512, hop_length=128)
    assert abs(a - 4000) < 512 and abs(b - 8000) < 512 and len(spans) == 1
    assert dsp.trim(np.zeros(4000)) in ((0, 0), (0, 4000))


def test_viterbi_against_all_paths():
    from itertools import product

    p, a = RNG.random((3, 5)), banks.transition_loop(3, 0.6)
    path, logp = sequence.viterbi(p, a)
    score = lambda s: np.log(1 / 3) + sum(np.log(p[s[t], t]) for t in range(5)) + sum(np.log(a[s[t], s[t + 1]]) for t in range(4))
    best = max(product(range(3), repeat=5), key=score)
    assert tuple(path) == best and np.isclose(logp, score(best))


def test_viterbi_known_answer():
    prob = np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]])
    assert sequence.viterbi(prob, np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([0.6, 0.4]))[0].tolist() == [0, 0, 1]


def test_dtw_of_a_stretched_sequence_costs_nothing():
    x, y = np.array([[1.0], [2], [3], [4], [5]]), np.array([[1.0], [2], [2], [3], [4], [5]])
    d, path = sequence.dtw_backtrack(x, y)
    assert d[-1, -1] == 0 and path[0] == (4, 5) and path[-1] == (0, 0)


def test_agglomerative_and_recurrence():
    x = np.repeat([[0.0], [5.0], [1.0]], 4, axis=0)
    assert sequence.agglomerative(x, 3).tolist() == [0, 4, 8]
    data = RNG.normal(size=(20, 4))
    rec = sequence.recurrence_matrix(data, k=3, mode="distance", sym=True)
    assert np.allclose(rec, rec.T) and (np.diag(rec) == 0).all()
    assert np.allclose(sequence.lag_to_recurrence(sequence.recurrence_to_lag(rec)), rec)


def test_decompositions():
    s = RNG.random((12, 30))
    w, h = sequence.nmf(s, 12)
    assert (w >= 0).all() and (h >= 0).all() and np.linalg.norm(s - w @ h) / np.linalg.norm(s) < 0.4
    a, b = sequence.hpss(s, 5)
    assert np.allclose(a + b, s)


def test_nnls_finds_a_planted_answer():
    a, x = RNG.random((20, 6)), np.maximum(0, RNG.normal(size=(6, 3)))
    assert np.allclose(features.nnls(a, a @ x), x, atol=1e-8)


def test_mfcc_inverse_and_dct():
    m = RNG.normal(size=(4, 10))
    db = features.mfcc(m, 10)
    assert np.allclose(dsp.power_to_db(features.mfcc_to_mel(db, 10), top_db=None), m)
    c = banks.dct_basis(8, 8)
    assert np.allclose(c @ c.T, np.eye(8))


def test_onsets_tempo_and_beats_of_clicks():
    y = dsp.clicks(np.arange(0, 8, 0.5), length=8 * 22050)
    env = rhythm.onset_envelope(y)
    found = rhythm.onset_detect(env)
    assert abs(len(found) - 15) <= 1
    assert abs(rhythm.tempo(env) - 120) < 4
    bpm, beats = rhythm.beat_track(env)
    assert np.abs(np.diff(beats) * 512 / 22050 - 0.5).max() < 0.06
    assert rhythm.plp(env).max() == 1.0


def test_events_and_intervals():
    assert rhythm.match_events([1, 6, 9], [0, 5, 10]).tolist() == [0, 1, 2] and rhythm.match_events([2], [1, 3]).tolist() == [1]
    assert rhythm.match_intervals(np.array([[3.0, 4.0]]), np.array([[5.0, 6.0], [0.0, 2.0]]), strict=False).tolist() == [1]
    assert rhythm.match_intervals(np.array([[3, 5], [1, 4], [4, 5]]), np.array([[0, 2], [1, 3], [4, 5], [6, 7]])).tolist() == [2, 1, 2]
    with pytest.raises(ValueError):
        rhythm.match_intervals(np.array([[10, 11]]), np.array([[0, 2]]))
    assert rhythm.peak_pick(np.array([0, 1, 0, 0, 2, 0, 1.5, 0]), 1, 2, 1, 2, 0.1, 2).tolist() == [1, 4]


def test_notation():
    assert notation.key_to_notes("F#:maj")[5] == "E♯" and notation.key_to_notes("Cb:maj")[11] == "C♭"
    assert notation.key_to_degrees("D:dor") == [2, 4, 5, 7, 9, 11, 0]
    assert notation.mela_to_degrees(72) == [0, 3, 4, 6, 7, 10, 11] and notation.mela_to_degrees("kanakangi") == [0, 1, 2, 5, 7, 8, 9]
    assert notation.fifths_to_note("C", 6, unicode=False) == "F#" and notation.fifths_to_note("C", -2, unicode=False) == "Bb"
    assert notation.interval_to_fjs(5 / 4) == "E⁵" and notation.interval_to_fjs(3 / 2) == "G"
    with pytest.raises(ValueError):
        notation.key_to_notes("H:maj")


def test_intervals():
    assert np.allclose(banks.plimit_intervals([3], 3), np.sort([1, 3 / 2, 4 / 3]))
    assert np.allclose(banks.pythagorean_intervals(3), [1, 9 / 8, 3 / 2])
    assert np.allclose(banks.interval_frequencies(3, 100.0, np.array([1.0, 1.5])), [100, 150, 200])


def test_banks():
    m = banks.mel(22050, 2048)
    assert m.shape == (128, 1025) and (m >= 0).all() and (m.sum(axis=1) > 0).all()
    c = banks.chroma(22050, 2048)
    assert c.shape == (12, 1025)
    assert np.abs(dsp.stft(dsp.tone(440, length=22050))).mean(axis=0).dot(c.T).argmax() == 9
    t = banks.transition_local(5, 3, wrap=True)
    assert np.allclose(t.sum(axis=1), 1)


def test_rqa_follows_a_diagonal_with_a_gap():
    sim = np.zeros((6, 6))
    for i in (0, 1, 2, 4, 5):
        sim[i, i] = 1.0
    score, path = sequence.rqa(sim, gap_onset=0.5, gap_extend=0.5)
    assert score[5, 5] == score.max() == 4.5 and path[0] == (0, 0) and path[-1] == (5, 5)
    assert sequence.rqa(np.zeros((3, 3)))[1] == []

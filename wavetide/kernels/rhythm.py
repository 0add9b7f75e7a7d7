"""Onsets, tempo and beats of one onset envelope or mel spectrogram (frames, bins)."""

from __future__ import annotations

import math

import numpy as np

from wavetide.plans import banks
from wavetide.plans.banks import SR, TINY

from . import dsp, features


def localmax(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x)
    out = np.zeros(x.shape, bool)
    out[1:-1] = (x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])
    if len(x) > 1:
        out[-1] = x[-1] > x[-2]
    return out


def localmin(x: np.ndarray) -> np.ndarray:
    return localmax(-np.asarray(x, float))


def maximum_filter1d(s: np.ndarray, size: int, axis: int = -1) -> np.ndarray:
    """Over size // 2 neighbours on both sides, so an even size acts as the next odd one."""
    half = size // 2
    if half == 0:
        return s
    wide = [(0, 0)] * s.ndim
    wide[axis] = (half, half)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(s, wide, constant_values=-np.inf), 2 * half + 1, axis=axis)
    return view.max(axis=-1)


def peak_pick(x: np.ndarray, pre_max: int, post_max: int, pre_avg: int, post_avg: int, delta: float, wait: int) -> np.ndarray:
    if min(pre_max, pre_avg, delta, wait) < 0 or post_max < 1 or post_avg < 1:
        raise ValueError("windows must be at least 0 before and 1 after; delta and wait at least 0")
    out, last = [], -math.inf
    for i, v in enumerate(x):
        if v == x[max(0, i - pre_max) : i + post_max].max() and v >= x[max(0, i - pre_avg) : i + post_avg].mean() + delta and i > last + wait:
            out.append(i)
            last = i
    return np.array(out, int)


def onset_strength_multi(mel_db: np.ndarray, lag: int = 1, max_size: int = 1, detrend: bool = False, center_shift: int = 0, channels=None, aggregate: str = "mean") -> np.ndarray:
    """(frames, bands) from mel levels; center_shift: frames that centring delays."""
    if lag < 1 or max_size < 1:
        raise ValueError("lag and max_size must be positive")
    if aggregate not in ("mean", "median"):
        raise ValueError("aggregate is mean or median")
    ref = maximum_filter1d(mel_db, max_size, axis=1)
    flux = np.maximum(0.0, mel_db[lag:] - ref[:-lag])
    edges = [0, mel_db.shape[1]] if channels is None else list(channels)
    gather = np.mean if aggregate == "mean" else np.median
    x = np.stack([gather(flux[:, a:b], axis=1) for a, b in zip(edges, edges[1:])], axis=1)
    x = np.pad(x, ((lag + center_shift, 0), (0, 0)))
    if detrend:
        y, state = np.empty_like(x), np.zeros(x.shape[1])
        before = np.zeros(x.shape[1])  # a first-order filter that blocks constants
        for k, row in enumerate(x):
            state = row - before + 0.99 * state
            y[k], before = state, row
        x = y
    return x[: len(mel_db)]


def onset_strength(mel_db: np.ndarray, **params) -> np.ndarray:
    return onset_strength_multi(mel_db, **params)[:, 0]


def onset_envelope(y, sr: float = SR, n_fft: int = 2048, hop_length: int = 512, n_mels: int = 128, center: bool = True, **params) -> np.ndarray:
    power = np.abs(dsp.stft(y, n_fft, hop_length, center=center)) ** 2
    mel_db = dsp.power_to_db(features.melspectrogram(power, sr, n_fft, n_mels=n_mels))
    return onset_strength(mel_db, center_shift=n_fft // (2 * hop_length) if center else 0, **params)


def onset_defaults(sr: float, hop_length: int) -> dict:
    unit = sr / hop_length
    return {"pre_max": int(0.03 * unit), "post_max": 1, "pre_avg": int(0.10 * unit), "post_avg": int(0.10 * unit) + 1, "wait": int(0.03 * unit), "delta": 0.07}


def onset_detect(env: np.ndarray, sr: float = SR, hop_length: int = 512, backtrack: bool = False, normalize: bool = True, energy: np.ndarray | None = None, **picks) -> np.ndarray:
    env = np.asarray(env, float)
    if not env.any() or not np.isfinite(env).all():
        return np.empty(0, int)
    if normalize:
        env = env - env.min()
        env = env / (env.max() + TINY)
    found = peak_pick(env, **{**onset_defaults(sr, hop_length), **{k: v for k, v in picks.items() if v}})
    return onset_backtrack(found, env if energy is None else energy) if backtrack else found


def onset_backtrack(events, energy) -> np.ndarray:
    e = np.asarray(energy, float)
    low = np.concatenate([[0], 1 + np.flatnonzero((e[1:-1] <= e[:-2]) & (e[1:-1] < e[2:]))])
    return low[np.searchsorted(low, np.asarray(events), side="right") - 1]


def match_events(source, target, left: bool = True, right: bool = True) -> np.ndarray:
    """Number of the nearest target for each source; of two as near, the one not below. Without left or right, targets
    below or above don't count; where none is left, the smallest target is taken."""
    s, t = np.asarray(source, float), np.asarray(target, float)
    if not len(s) or not len(t):
        raise ValueError("events are needed on both sides")
    order = np.argsort(t, kind="stable")
    u = t[order]
    above = np.searchsorted(u, s, side="left")
    below = above - 1
    up = np.where(above < len(u), u[np.minimum(above, len(u) - 1)] - s, np.inf)
    up = up if right else np.where(up == 0, up, np.inf)
    down = np.where(below >= 0, s - u[np.maximum(below, 0)], np.inf) if left else np.full(len(s), np.inf)
    best = np.where(down < up, below, np.where(np.isinf(up), 0, above))
    return order[best]


def match_intervals(source: np.ndarray, target: np.ndarray, strict: bool = True) -> np.ndarray:
    """Number of the target with the largest overlap share; without strict, else the nearest one, the one before first."""
    if not len(source) or not len(target):
        raise ValueError("intervals are needed on both sides")
    out = []
    for a, b in np.asarray(source, float):
        both = np.minimum(b, target[:, 1]) - np.maximum(a, target[:, 0])
        if (both >= 0).any():
            union = np.maximum(b, target[:, 1]) - np.minimum(a, target[:, 0])
            out.append(int(np.argmax(np.where(both >= 0, both / np.where(union > 0, union, 1.0), -1.0))))
        elif strict:
            raise ValueError("an interval overlaps none of the targets")
        else:
            out.append(int(np.lexsort((target[:, 0] > b, -both))[0]))
    return np.array(out, int)


# tempo


def tempogram(env, win_length: int = 384, center: bool = True, window: str = "hann", norm: float | None = np.inf) -> np.ndarray:
    """(frames, lags): local autocorrelation."""
    env = np.asarray(env, float)
    if win_length < 1:
        raise ValueError("win_length must be positive")
    n = len(env)
    half = win_length // 2
    ramp = np.arange(half) / max(1, half)  # from zero up to the edge, and from the edge's value down
    x = np.concatenate([env[0] * ramp, env, env[-1] * (1 - ramp)]) if center else env
    frames = dsp.frame(x, win_length, 1)[: n if center else None] * banks.get_window(window, win_length)
    size = 1 << (2 * win_length - 1).bit_length()
    auto = np.fft.irfft(np.abs(np.fft.rfft(frames, size, axis=1)) ** 2, size, axis=1)[:, :win_length]
    return features.normalize(auto, norm)


def _scores(tg: np.ndarray, sr: float, hop_length: int, start_bpm: float, std_bpm: float, max_tempo: float | None) -> tuple[np.ndarray, np.ndarray]:
    if start_bpm <= 0:
        raise ValueError("start_bpm must be positive")
    bpm = banks.tempo_frequencies(tg.shape[1], hop_length, sr)
    with np.errstate(divide="ignore", invalid="ignore"):
        prior = -0.5 * ((np.log2(bpm) - math.log2(start_bpm)) / std_bpm) ** 2
    prior[0] = -np.inf
    if max_tempo is not None:
        prior[bpm > max_tempo] = -np.inf
    return bpm, np.log1p(1e6 * tg) + prior


def tempo(env, sr: float = SR, hop_length: int = 512, start_bpm: float = 120.0, std_bpm: float = 1.0, ac_size: float = 8.0, max_tempo: float | None = 320.0, aggregate: bool = True) -> float:
    """Without aggregate the first frame alone decides."""
    tg = tempogram(env, max(1, int(ac_size * sr / hop_length)))
    tg = tg.mean(axis=0, keepdims=True) if aggregate else tg[:1]
    bpm, score = _scores(tg, sr, hop_length, start_bpm, std_bpm, max_tempo)
    return float(bpm[np.argmax(score[0])])


def tempo_frames(env, sr: float = SR, hop_length: int = 512, start_bpm: float = 120.0, std_bpm: float = 1.0, ac_size: float = 8.0, max_tempo: float | None = 320.0) -> np.ndarray:
    tg = tempogram(env, max(1, int(ac_size * sr / hop_length)))
    bpm, score = _scores(tg, sr, hop_length, start_bpm, std_bpm, max_tempo)
    return bpm[np.argmax(score, axis=1)]


def fourier_tempogram(env, win_length: int = 384, center: bool = True, window: str = "hann") -> np.ndarray:
    return dsp.stft(env, win_length, 1, center=center, window=window)


#: Multiples of the tempo that tempogram_ratio looks at.
RATIOS = (4, 8 / 3, 3, 2, 4 / 3, 3 / 2, 1, 2 / 3, 3 / 4, 1 / 2, 1 / 3, 3 / 8, 1 / 4)


def tempogram_ratio(tg: np.ndarray, sr: float = SR, hop_length: int = 512, factors=RATIOS, start_bpm: float = 120.0, std_bpm: float = 1.0, max_tempo: float | None = 320.0, fill_value: float = 0.0) -> np.ndarray:
    bpm, score = _scores(tg, sr, hop_length, start_bpm, std_bpm, max_tempo)
    return features.f0_harmonics(tg, bpm[np.argmax(score, axis=1)], bpm, factors or RATIOS, fill_value)


def beat_track(env, sr: float = SR, hop_length: int = 512, start_bpm: float = 120.0, tightness: float = 100.0, trim: bool = True, bpm: float | None = None) -> tuple[float, np.ndarray]:
    env = np.asarray(env, float)
    if tightness <= 0:
        raise ValueError("tightness must be positive")
    if not len(env) or env.max() == 0:
        return 0.0, np.empty(0, int)
    bpm = tempo(env, sr, hop_length, start_bpm) if bpm is None else bpm
    if not bpm > 0 or not np.isfinite(bpm):
        return 0.0, np.empty(0, int)
    period = max(1, int(np.rint(60.0 * sr / hop_length / bpm)))
    x = env / ((env.std(ddof=1) if len(env) > 1 else 0.0) + TINY)
    t = np.arange(-period, period + 1)
    n = len(x)
    local = np.convolve(x, np.exp(-0.5 * (t * 32.0 / period) ** 2), "full")[period : period + n]
    lags = np.arange(int(np.rint(period / 2.0)), 2 * period + 1)
    cost = tightness * (np.log(np.maximum(lags, 1)) - math.log(period)) ** 2
    back, value, begun = np.full(n, -1), np.zeros(n), False
    for i in range(n):
        ok = lags[(lags <= i) & (lags > 0)]
        value[i] = local[i]
        if len(ok):
            score = value[i - ok] - cost[ok - lags[0]]
            k = int(np.argmax(score))
            value[i] += score[k]
        begun = begun or local[i] >= 0.01 * local.max()
        if begun and len(ok):
            back[i] = i - ok[k]
    peaks = localmax(value)
    high = np.flatnonzero(peaks & (value >= 0.5 * np.median(value[peaks]))) if peaks.any() else np.array([n - 1])
    beats = [int(high[-1])] if len(high) else [n - 1]
    while back[beats[-1]] >= 0:
        beats.append(int(back[beats[-1]]))
    beats = np.array(beats[::-1])
    if len(beats):
        smooth = np.convolve(local[beats], [0.0, 0.5, 1.0, 0.5, 0.0])[2 : n + 2]
        loud = np.flatnonzero(local > (0.5 * math.sqrt(float((smooth**2).mean())) if trim else 0.0))
        beats = beats[(beats >= loud[0]) & (beats <= loud[-1])] if len(loud) else beats[:0]
    return float(bpm), beats


def plp(env, sr: float = SR, hop_length: int = 512, win_length: int = 384, tempo_min: float | None = 30.0, tempo_max: float | None = 300.0) -> np.ndarray:
    if tempo_min is not None and tempo_max is not None and tempo_max <= tempo_min:
        raise ValueError("tempo_max must exceed tempo_min")
    ft = fourier_tempogram(env, win_length)
    bpm = banks.fourier_tempo_frequencies(sr, win_length, hop_length)
    barred = np.zeros(len(bpm), bool)
    if tempo_min is not None:
        barred |= bpm < tempo_min
    if tempo_max is not None:
        barred |= bpm > tempo_max
    ft = np.where(barred, 0.0, ft)
    peak = np.argmax(np.log1p(1e6 * np.abs(ft)), axis=1)  # the first of equal ones
    ft = np.where(np.arange(ft.shape[1]) == peak[:, None], ft, 0.0)
    unit = ft / (TINY**0.5 + np.abs(ft).max(axis=1, keepdims=True))
    pulse = np.maximum(0.0, dsp.istft(unit, 1, n_fft=win_length, length=len(env)))
    return features.normalize(pulse, np.inf)


def sync(data: np.ndarray, idx, aggregate: str = "mean") -> np.ndarray:
    """Aggregates of data (frames, features) between boundaries; frames before the first are dropped; the median is the
    upper middle."""
    bounds = [*np.asarray(idx, int).tolist(), len(data)]
    parts = [data[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]
    how = {"mean": lambda x: x.mean(axis=0), "median": lambda x: np.sort(x, axis=0)[len(x) // 2], "min": lambda x: x.min(axis=0), "max": lambda x: x.max(axis=0)}[aggregate]
    return np.array([how(p) for p in parts])


def axis_sort(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns in the order of their largest entry's row, and that order."""
    order = np.argsort(np.argmax(s, axis=0), kind="stable")
    return s[:, order], order


def cyclic_gradient(x: np.ndarray, edge_order: int = 1) -> np.ndarray:
    x = np.asarray(x, float)
    return np.gradient(np.concatenate([x[-edge_order:], x, x[:edge_order]]), edge_order=edge_order)[edge_order:-edge_order]

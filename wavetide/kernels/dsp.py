"""Short-time transforms, resampling, filters and effects of one signal."""

from __future__ import annotations

import functools
import math

import numpy as np

from wavetide.kernels.recursion import section, state_filter
from wavetide.plans.banks import SR, TINY, _centred, fft_frequencies, get_window, mr_frequencies

# framing


def pad_signal(y: np.ndarray, left: int, right: int, mode: str = "constant") -> np.ndarray:
    """Constant, edge and reflect are honoured; the other modes pad with zeros."""
    if mode in ("edge", "reflect") and len(y) > (1 if mode == "reflect" else 0):
        return np.pad(y, (left, right), mode=mode)
    return np.pad(y, (left, right))


def frame(y: np.ndarray, frame_length: int, hop_length: int) -> np.ndarray:
    """(frames, frame_length); the tail is dropped."""
    if len(y) < frame_length or hop_length < 1:
        raise ValueError("the signal is shorter than a frame, or hop_length isn't positive")
    return np.lib.stride_tricks.sliding_window_view(y, frame_length)[::hop_length]


def fix_length(y: np.ndarray, size: int) -> np.ndarray:
    return y[:size] if len(y) >= size else np.pad(y, (0, size - len(y)))


# Fourier


#: Most samples of a frame whose spectrum reassigned takes from the sums of the definition.
SHORT = 32


@functools.lru_cache(maxsize=8)
def _waves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines of each sample and bin of a frame, the last sample first."""
    return tuple(np.array([[f(2 * math.pi * k * i / n) for k in range(n // 2 + 1)] for i in reversed(range(n))]) for f in (math.cos, math.sin))


def fourier_sums(frames: np.ndarray) -> np.ndarray:
    """Spectrum of each row by the sums of the definition, from the last sample to the first, which is how the SQL of short
    frames comes to add them up: the last digits are the same, too."""
    waves, out = _waves(frames.shape[1]), np.empty((len(frames), frames.shape[1] // 2 + 1), complex)
    for at in range(0, len(frames), 4096):
        x = frames[at : at + 4096, ::-1, None]
        out.real[at : at + 4096], out.imag[at : at + 4096] = (x * waves[0]).sum(axis=1), -(x * waves[1]).sum(axis=1)
    return out


def stft(y, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window="hann", center: bool = True, pad_mode: str = "constant", sums: bool = False) -> np.ndarray:
    """(frames, 1 + n_fft/2) complex. sums: by fourier_sums, for short frames whose last digits matter."""
    win_length = win_length or n_fft
    hop = hop_length or max(1, win_length // 4)
    w = _centred(get_window(window, win_length), n_fft)
    y = pad_signal(np.asarray(y, float), n_fft // 2, n_fft // 2, pad_mode) if center else np.asarray(y, float)
    x = frame(y, n_fft, hop) * w
    return fourier_sums(x) if sums else np.fft.rfft(x, axis=1)


def istft(d: np.ndarray, hop_length: int | None = None, win_length: int | None = None, n_fft: int | None = None, window="hann", center: bool = True, length: int | None = None) -> np.ndarray:
    n_fft = n_fft or 2 * (d.shape[1] - 1)
    win_length = win_length or n_fft
    hop = hop_length or max(1, win_length // 4)
    w = _centred(get_window(window, win_length), n_fft)
    y = np.zeros(n_fft + hop * (len(d) - 1))
    power = np.zeros_like(y)
    for t, x in enumerate(np.fft.irfft(d, n_fft, axis=1) * w):
        y[t * hop : t * hop + n_fft] += x
        power[t * hop : t * hop + n_fft] += w * w
    y = np.where(power > TINY, y / np.where(power > TINY, power, 1.0), y)
    if center:
        y = y[n_fft // 2 : len(y) - n_fft // 2]
    return y if length is None else fix_length(y, length)


def magphase(d: np.ndarray, power: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    m = np.abs(d)
    return m**power, np.where(m == 0, 1.0, d / np.where(m == 0, 1.0, m))


def power_to_db(s, ref=1.0, amin: float = 1e-10, top_db: float | None = 80.0) -> np.ndarray:
    """ref: a number, or a function of s. top_db is below the largest level of the whole matrix."""
    ref = abs(ref(s) if callable(ref) else ref)
    db = 10 * np.log10(np.maximum(amin, s)) - 10 * np.log10(max(amin, ref))
    return db if top_db is None or not np.size(db) else np.maximum(db, db.max() - top_db)


def amplitude_to_db(s, ref=1.0, amin: float = 1e-5, top_db: float | None = 80.0) -> np.ndarray:
    ref = ref(s) if callable(ref) else ref
    return power_to_db(np.square(s), ref * ref, amin * amin, top_db)


def db_to_power(db, ref: float = 1.0):
    return ref * 10.0 ** (np.asarray(db) * 0.1)


def phase_vocoder(d: np.ndarray, rate: float, hop_length: int | None = None, n_fft: int | None = None) -> np.ndarray:
    if rate <= 0:
        raise ValueError("rate must be positive")
    n_fft = n_fft or 2 * (d.shape[1] - 1)
    hop = hop_length or n_fft // 4
    advance = np.linspace(0, np.pi * hop, d.shape[1])
    at = np.arange(math.ceil(len(d) / rate)) * rate
    low = at.astype(int)
    low = np.minimum(low, len(d) - 1)
    high = np.minimum(low + 1, len(d) - 1)
    part = (at - low)[:, None]
    size = (1 - part) * np.abs(d[low]) + part * np.abs(d[high])
    turn = np.fmod(np.angle(d[high]) - np.angle(d[low]) - advance + np.pi, 2 * np.pi) - np.pi  # the remainder keeps its sign
    phase = np.angle(d[0]) + np.concatenate([np.zeros((1, d.shape[1])), np.cumsum(advance + turn[:-1], axis=0)])
    return size * np.exp(1j * phase)


def griffinlim(s: np.ndarray, n_iter: int = 32, hop_length: int | None = None, win_length: int | None = None, n_fft: int | None = None, window="hann", center: bool = True, length: int | None = None, pad_mode: str = "constant", momentum: float = 0.99, init_phase: str | None = "random", random_state: int = 0) -> np.ndarray:
    if momentum < 0:
        raise ValueError("momentum must not be negative")
    n_fft = n_fft or 2 * (s.shape[1] - 1)
    turn = np.random.default_rng(random_state).random(s.shape) if init_phase == "random" else np.zeros(s.shape)
    now = before = s * np.exp(2j * np.pi * turn)
    args = dict(hop_length=hop_length, win_length=win_length, window=window, center=center)

    def unit(z: np.ndarray, other) -> np.ndarray:
        size = np.abs(z)
        return np.where(size > TINY, z / np.where(size > TINY, size, 1.0), other)

    for k in range(n_iter):
        again = stft(istft(now, n_fft=n_fft, length=length, **args), n_fft=n_fft, pad_mode=pad_mode, **args)
        again = again[: len(s)] if len(again) >= len(s) else np.pad(again, ((0, len(s) - len(again)), (0, 0)))
        turn = unit(again, 1.0)
        if momentum > 0 and k:
            turn = turn - momentum * unit(before, 1.0)
            turn = unit(turn, turn)
        before, now = now, s * turn
    return istft(now, n_fft=n_fft, length=length, **args)


def pcen(s: np.ndarray, **params) -> np.ndarray:
    """The smoother starts at one."""
    return pcen_steps(s, **params)[0]


def pcen_steps(s: np.ndarray, state: np.ndarray | None = None, sr: float = SR, hop_length: int = 512, gain: float = 0.98, bias: float = 2.0, power: float = 0.5, time_constant: float = 0.4, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Per-channel energy normalization of the next frames, and the smoother behind them."""
    t = time_constant * sr / hop_length
    b = (math.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
    smooth, state = np.empty_like(s, dtype=float), np.ones(s.shape[1]) if state is None else state
    for k, x in enumerate(s):
        state = b * x + (1 - b) * state
        smooth[k] = state
    level = np.exp(-gain * (math.log(eps) + np.log1p(smooth / eps)))
    if power == 0:
        return np.log1p(s * level), state
    if bias == 0:
        return np.exp(power * (np.log(np.maximum(s, TINY)) + np.log(level))), state
    return bias**power * np.expm1(power * np.log1p(s * level / bias)), state


def reassigned(y, sr: float = SR, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window="hann", center: bool = True, reassign_frequencies: bool = True, reassign_times: bool = True, ref_power: float = 1e-6, fill_nan: bool = False, clip: bool = True, pad_mode: str = "constant") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, times and magnitudes, each (frames, bins)."""
    win_length = win_length or n_fft
    hop = hop_length or win_length // 4
    w = _centred(get_window(window, win_length), n_fft)
    slope = (np.roll(w, -1) - np.roll(w, 1)) / 2.0
    y = np.asarray(y, float)
    x = frame(pad_signal(y, n_fft // 2, n_fft // 2, pad_mode) if center else y, n_fft, hop)
    # differences of nearly equal numbers follow: where a bin is weak, the last bits of its sums reach the digits that count
    s, sd, st = map(fourier_sums if n_fft <= SHORT else np.fft.rfft, (x * w, x * slope, x * w * (np.arange(n_fft) - n_fft // 2)))
    power = s.real**2 + s.imag**2
    size, safe = np.sqrt(power), np.where(power == 0, 1.0, power)
    f0 = np.broadcast_to(fft_frequencies(sr, n_fft), s.shape)
    t0 = np.broadcast_to(((np.arange(len(s)) * hop + (0 if center else n_fft // 2)) / sr)[:, None], s.shape)
    weak = size < math.sqrt(ref_power)
    f = np.where(weak, np.nan, f0 - (sd.imag * s.real - sd.real * s.imag) / safe * sr / (2 * np.pi)) if reassign_frequencies else f0
    t = np.where(weak, np.nan, t0 + (st.real * s.real + st.imag * s.imag) / safe / sr) if reassign_times else t0
    if fill_nan:
        f, t = np.where(np.isnan(f), f0, f), np.where(np.isnan(t), t0, t)
    if clip:
        f, t = np.clip(f, 0, sr / 2.0), np.clip(t, 0, len(y) / sr)
    return f, t, size


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic interpolation."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    # second derivatives: three diagonals, once the end conditions have taken the first and the last one out
    low, mid, up, r = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    mid[0], up[0] = mid[0] + h[0] * (h[0] + h[1]) / h[1], h[1] - h[0] ** 2 / h[1]
    mid[-1], low[-1] = mid[-1] + h[-1] * (h[-1] + h[-2]) / h[-2], h[-2] - h[-1] ** 2 / h[-2]
    m = np.empty(n)
    for i in range(1, n - 2):
        part = low[i] / mid[i - 1]
        mid[i] -= part * up[i - 1]
        r[i] -= part * r[i - 1]
    m[n - 2] = r[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (r[i] - up[i] * m[i + 2]) / mid[i]
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v


def fmt(y, t_min: float = 0.5, n_fmt: int | None = None, kind: str = "cubic", beta: float = 0.5, over_sample: float = 1.0) -> np.ndarray:
    """Scale transform: the signal on an exponential grid, then Fourier."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 3 or t_min <= 0 or n_fmt is not None and n_fmt < 3:
        raise ValueError("three samples or more and a positive t_min are needed")
    if n_fmt is None:
        n_fmt = math.ceil(over_sample * (math.log(n - 1) - math.log(t_min)) / (math.log(n - 1) - math.log(n - 2)))
    x = np.arange(n) / n
    grid = np.exp(math.log(t_min / n) * (1.0 - np.arange(n_fmt) / (n_fmt + math.ceil(over_sample))))
    grid = np.clip(grid, t_min / n, x[-1])
    z = np.interp(grid, x, y) if kind == "linear" else cubic_spline(x, y, grid)
    return np.fft.rfft(z * grid**beta) * math.sqrt(n) / n_fmt


# resampling and simple analysis

#: Zero crossings, Kaiser beta and rolloff of the quality presets.
KAISER = {"kaiser_vhq": (96, 16.0, 0.975), "kaiser_hq": (64, 14.0, 0.95), "kaiser_mq": (32, 10.0, 0.92), "kaiser_lq": (16, 8.0, 0.86), "kaiser_fast": (8, 6.0, 0.80)}


def resample(y, orig_sr: float, target_sr: float, res_type: str = "kaiser_hq", fix: bool = True, scale: bool = False) -> np.ndarray:
    y = np.asarray(y, float)
    if orig_sr <= 0 or target_sr <= 0:
        raise ValueError("sampling rates must be positive")
    if orig_sr == target_sr or not len(y):
        return y
    ratio = target_sr / orig_sr
    n = math.ceil(len(y) * ratio)
    if res_type == "linear":
        out = np.interp(np.arange(n) / ratio, np.arange(len(y)), y)
    elif res_type in ("fft", "scipy"):
        f = np.fft.rfft(y)
        keep = min(len(f), n // 2 + 1)
        g = np.zeros(n // 2 + 1, complex)
        g[:keep] = f[:keep]
        out = np.fft.irfft(g, n) * n / len(y)
    else:
        zeros, beta, rolloff = KAISER.get({"kaiser": "kaiser_hq", "kaiser_best": "kaiser_hq"}.get(res_type, res_type), KAISER["kaiser_hq"])
        cut = rolloff * min(1.0, ratio)
        half = zeros / cut
        at = np.arange(n) / ratio
        taps = np.arange(-math.ceil(half), math.ceil(half) + 1)
        out = np.empty(n)
        for lo in range(0, n, 4096):  # bounded memory for long signals
            part = at[lo : lo + 4096]
            index = np.floor(part).astype(int)[:, None] + taps
            x = part[:, None] - index
            w = np.where(np.abs(x) <= half, np.i0(beta * np.sqrt(np.maximum(0, 1 - (x / half) ** 2))) / np.i0(beta), 0.0)
            v = np.where((index >= 0) & (index < len(y)), y[np.clip(index, 0, len(y) - 1)], 0.0)
            out[lo : lo + 4096] = (v * w * cut * np.sinc(cut * x)).sum(axis=1)
    out = fix_length(out, n) if fix else out
    return out / math.sqrt(ratio) if scale else out


def autocorrelate(y, max_size: int | None = None) -> np.ndarray:
    y = np.asarray(y, float)
    n = len(y)
    most = n if max_size is None else min(n, max_size)
    if not n:
        return y
    size = 1 << max(1, (2 * n - 1).bit_length())
    return np.fft.irfft(np.abs(np.fft.rfft(y, size)) ** 2, size)[:most]


def lpc(y, order: int) -> np.ndarray:
    """Burg's method: coefficients with a leading one."""
    y = np.asarray(y, float)
    if order < 1 or len(y) <= order:
        raise ValueError("order must be positive and below the signal's length")
    a = np.array([1.0])
    fwd, bwd = y[1:], y[:-1]
    den = fwd @ fwd + bwd @ bwd
    for i in range(order):
        k = -2.0 * (bwd @ fwd) / (den + TINY)
        a = np.append(a, 0.0)
        a = a + k * a[::-1]
        fwd, bwd = fwd + k * bwd, bwd + k * fwd
        den = (1 - k * k) * den - bwd[-1] ** 2 - fwd[0] ** 2
        fwd, bwd = fwd[1:], bwd[:-1]
    return a


def tone(frequency: float, sr: float = SR, length: int | None = None, duration: float | None = None, phi: float | None = None) -> np.ndarray:
    n = _samples(sr, length, duration)
    return np.cos(2 * np.pi * frequency * np.arange(n) / sr + (-np.pi / 2 if phi is None else phi))


def chirp(fmin: float, fmax: float, sr: float = SR, length: int | None = None, duration: float | None = None, linear: bool = False, phi: float | None = None) -> np.ndarray:
    n = _samples(sr, length, duration)
    duration = n / sr if duration is None else duration
    t, phi = np.arange(n) / sr, -np.pi / 2 if phi is None else phi
    if linear:
        return np.cos(2 * np.pi * (fmin * t + 0.5 * (fmax - fmin) / duration * t * t) + phi)
    r = math.log(fmax / fmin)
    return np.cos(2 * np.pi * fmin * duration / r * np.expm1(r * t / duration) + phi)


def _samples(sr: float, length: int | None, duration: float | None) -> int:
    if length is None and duration is None:
        raise ValueError("length or duration is needed")
    return int(duration * sr) if length is None else length


def clicks(times, sr: float = SR, click_freq: float = 1000.0, click_duration: float = 0.1, length: int | None = None) -> np.ndarray:
    n = math.ceil(sr * click_duration)
    click = np.linspace(1, 0, n) ** 2 * np.sin(2 * np.pi * click_freq * np.arange(n) / sr)
    at = np.floor(np.asarray(times, float) * sr).astype(int)
    out = np.zeros(length if length is not None else (at.max() + n if len(at) else 0))
    for p in at[at < len(out)]:
        out[p : p + n] += click[: len(out) - p]
    return out


def zero_crossings(y, threshold: float = 1e-10, ref_magnitude: float | None = None, pad: bool = True, zero_pos: bool = True) -> np.ndarray:
    y = np.asarray(y, float)
    threshold = threshold * (1.0 if ref_magnitude is None else ref_magnitude)
    y = np.where(np.abs(y) <= threshold, 0.0, y)
    sign = np.signbit(y) & (y != 0) if zero_pos else np.sign(y)
    return np.concatenate([[pad], sign[1:] != sign[:-1]]) if len(y) else np.zeros(0, bool)


# second-order sections


def sosfilt(sos, x, zi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The filtered signal and the state behind it, (sections, 2)."""
    y, state = np.array(x, float), np.zeros((len(sos), 2)) if zi is None else np.array(zi, float)
    for s, row in enumerate(sos):
        y, state[s] = state_filter(*section(*row), y, state[s])
    return y, state


def sosfilt_zi(sos) -> np.ndarray:
    """State in which a constant one stays constant."""
    out, gain = [], 1.0
    for b0, b1, b2, a0, a1, a2 in sos:
        dc = (b0 + b1 + b2) / (a0 + a1 + a2)
        z1 = b2 / a0 - a2 / a0 * dc
        z0 = b1 / a0 - a1 / a0 * dc + z1
        out.append((gain * z0, gain * z1))
        gain *= dc
    return np.array(out)


def sosfiltfilt(sos, x) -> np.ndarray:
    x = np.asarray(x, float)
    n = min(3 * (2 * len(sos) - 1), len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    zi = sosfilt_zi(sos)
    y = sosfilt(sos, ext, zi * ext[0])[0][::-1]
    y = sosfilt(sos, y, zi * y[0])[0][::-1]
    return y[n : len(y) - n]


def _ellipk(m: float) -> float:
    a, b = 1.0, math.sqrt(1 - m)
    while abs(a - b) > 1e-15 * a:
        a, b = (a + b) / 2, math.sqrt(a * b)
    return math.pi / (2 * a)


def _ellipj(u: float, m: float) -> tuple[float, float, float]:
    """sn, cn, dn by descending means."""
    a, c, b = [1.0], [math.sqrt(m)], math.sqrt(1 - m)
    while abs(c[-1]) > 1e-16 and len(a) < 40:
        a.append((a[-1] + b) / 2)
        c.append((a[-2] - b) / 2)
        b = math.sqrt(a[-2] * b)
    phi = 2 ** (len(a) - 1) * a[-1] * u
    for k in range(len(a) - 1, 0, -1):
        phi = (phi + math.asin(max(-1.0, min(1.0, c[k] / a[k] * math.sin(phi))))) / 2
    sn, cn = math.sin(phi), math.cos(phi)
    return sn, cn, math.sqrt(1 - m * sn * sn)


def elliptic_prototype(order: int, ripple: float, stop: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of an analogue low-pass filter with its edge at one."""
    eps2 = 10 ** (0.1 * ripple) - 1
    k1 = eps2 / (10 ** (0.1 * stop) - 1)
    q1 = math.exp(-math.pi * _ellipk(1 - k1) / _ellipk(k1))
    q = q1 ** (1.0 / order)
    top = sum(q ** (i * (i + 1)) for i in range(8))
    bottom = 1 + 2 * sum(q ** (i * i) for i in range(1, 9))
    m = 16 * q * (top / bottom) ** 4
    k = _ellipk(m)
    sn, cn, dn = (np.array(v) for v in zip(*(_ellipj(j * k / order, m) for j in range(1 - order % 2, order, 2))))
    zeros = 1j / (math.sqrt(m) * sn[np.abs(sn) > 1e-14])
    zeros = np.concatenate([zeros, zeros.conj()])
    low, high = 0.0, _ellipk(1 - k1)  # the real parameter v0 where sc(v0 | 1-k1) = 1/eps
    for _ in range(200):
        mid = (low + high) / 2
        s, c, _ = _ellipj(mid, 1 - k1)
        low, high = (mid, high) if s < c / math.sqrt(eps2) else (low, mid)
    v0 = k * low / (order * _ellipk(k1))
    sv, cv, dv = _ellipj(v0, 1 - m)
    poles = -(cn * dn * sv * cv + 1j * sn * dv) / (1 - (dn * sv) ** 2)
    if order % 2:
        pairs = poles[np.abs(poles.imag) > 1e-14 * np.abs(poles)]
        poles = np.concatenate([poles, pairs.conj()])
    else:
        poles = np.concatenate([poles, poles.conj()])
    gain = float((np.prod(-poles) / np.prod(-zeros)).real) / (1.0 if order % 2 else math.sqrt(1 + eps2))
    return zeros, poles, gain


def elliptic_order(passband: float, stopband: tuple[float, float], edges: tuple[float, float], ripple: float, stop: float) -> int:
    """Least order that meets a band-pass specification; edges and stopband in warped frequencies."""
    lo, hi = edges
    nat = min(abs((s * s - lo * hi) / (s * (lo - hi))) for s in stopband)
    k1 = (10 ** (0.1 * ripple) - 1) / (10 ** (0.1 * stop) - 1)
    m = (1.0 / nat) ** 2
    return math.ceil(_ellipk(m) * _ellipk(1 - k1) / (_ellipk(1 - m) * _ellipk(k1)))


def elliptic_bandpass(low: float, high: float, ripple: float, stop: float, order: int) -> np.ndarray:
    """Second-order sections; edges as shares of the Nyquist frequency."""
    z, p, k = elliptic_prototype(order, ripple, stop)
    w1, w2 = (4 * math.tan(math.pi * x / 2) for x in (low, high))
    width, centre = w2 - w1, math.sqrt(w1 * w2)
    split = lambda r: np.concatenate([r * width / 2 + np.sqrt((r * width / 2) ** 2 - centre**2 + 0j), r * width / 2 - np.sqrt((r * width / 2) ** 2 - centre**2 + 0j)])
    degree = len(p) - len(z)
    z, p, k = np.concatenate([split(z), np.zeros(degree)]), split(p), k * width**degree
    k = k * float((np.prod(4 - z) / np.prod(4 - p)).real)
    z, p = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))]), (4 + p) / (4 - p)
    return sections(z, p, k)


def sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """Pair conjugate poles, nearest the unit circle last, each with the nearest zeros."""
    pairs = sorted((x for x in p if x.imag > 1e-12), key=abs)
    real = sorted(x.real for x in p if abs(x.imag) <= 1e-12)
    quads = [(1.0, -2 * x.real, abs(x) ** 2, x) for x in pairs]
    for i in range(0, len(real), 2):
        own = real[i : i + 2]
        quads.insert(0, (1.0, -sum(own), own[0] * own[1] if len(own) == 2 else 0.0, complex(own[0])))
    up, flat = [x for x in z if x.imag > 1e-12], sorted(x.real for x in z if abs(x.imag) <= 1e-12)
    out = []
    for a0, a1, a2, pole in reversed(quads):
        if up and (not flat or min(abs(x - pole) for x in up) <= min(abs(x - pole) for x in flat)):
            x = up.pop(int(np.argmin([abs(x - pole) for x in up])))
            b = (1.0, -2 * x.real, abs(x) ** 2)
        elif len(flat) >= 2:
            r = [flat.pop(int(np.argmin([abs(x - pole) for x in flat]))) for _ in range(2)]
            b = (1.0, -(r[0] + r[1]), r[0] * r[1])
        elif flat:
            b = (1.0, -flat.pop(), 0.0)
        elif up:
            x = up.pop()
            b = (1.0, -2 * x.real, abs(x) ** 2)
        else:
            b = (1.0, 0.0, 0.0)
        out.append([*b, a0, a1, a2])
    out = np.array(out[::-1])
    out[0, :3] *= k
    return out


def semitone_filterbank(center_freqs=None, tuning: float = 0.0, sample_rates=None, q: float = 25.0, passband_ripple: float = 1.0, stopband_attenuation: float = 50.0) -> tuple[list[np.ndarray], np.ndarray]:
    freqs, rates = mr_frequencies(tuning) if center_freqs is None else (np.asarray(center_freqs, float), np.asarray(sample_rates, float))
    out = []
    for f, sr in zip(freqs, rates):
        width = f / q
        edges = [(f + s * width / 2) / (sr / 2) for s in (-1, 1)]
        stops = [(f + s * width) / (sr / 2) for s in (-1, 1)]
        warp = [math.tan(math.pi * x / 2) for x in (*edges, *stops)]
        order = elliptic_order(1.0, (warp[2], warp[3]), (warp[0], warp[1]), passband_ripple, stopband_attenuation)
        out.append(elliptic_bandpass(edges[0], edges[1], passband_ripple, stopband_attenuation, order))
    return out, rates


def iirt(y, sr: float = SR, win_length: int = 2048, hop_length: int | None = None, center: bool = True, tuning: float = 0.0, pad_mode: str = "constant") -> np.ndarray:
    """Short-time power of 85 semitone filters, (frames, 85)."""
    hop = hop_length or win_length // 4
    y = np.asarray(y, float)
    banks, rates = semitone_filterbank(tuning=tuning)
    y = pad_signal(y, win_length // 2, win_length // 2, pad_mode) if center else y
    at_rate = {r: y if abs(r - sr) < 1e-6 else resample(y, sr, r) for r in np.unique(rates)}
    n = max(1, 1 + (len(y) - win_length) // hop)
    out = np.zeros((n, len(banks)))
    for k, (sos, rate) in enumerate(zip(banks, rates)):
        x = sosfiltfilt(sos, at_rate[rate]) if len(at_rate[rate]) > 1 else at_rate[rate]
        scale = sr / rate
        starts = np.floor(np.arange(n) * (hop / scale) + 0.5).astype(int)
        power = np.concatenate([[0.0], np.cumsum(x * x)])
        ends = np.minimum(starts + int(win_length / scale + 0.5), len(x))
        out[:, k] = np.maximum(power[ends] - power[np.minimum(starts, len(x))], 0.0) * scale
    return out


# effects


def time_stretch(y, rate: float, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window="hann", center: bool = True) -> np.ndarray:
    d = stft(y, n_fft, hop_length, win_length, window, center)
    d = phase_vocoder(d, rate, hop_length or (win_length or n_fft) // 4, n_fft)
    return istft(d, hop_length, win_length, n_fft, window, center, length=round(len(y) / rate))


def pitch_shift(y, sr: float, n_steps: float, bins_per_octave: int = 12, res_type: str = "kaiser_hq", n_fft: int = 2048, hop_length: int | None = None) -> np.ndarray:
    rate = 2.0 ** (-n_steps / bins_per_octave)
    return fix_length(resample(time_stretch(y, rate, n_fft, hop_length), sr / rate, sr, res_type), len(y))


def nonsilent(y, top_db: float = 60.0, ref: float = -1.0, frame_length: int = 2048, hop_length: int = 512) -> np.ndarray:
    y = pad_signal(np.asarray(y, float), frame_length // 2, frame_length // 2)
    power = (frame(y, frame_length, hop_length) ** 2).mean(axis=1)
    return power_to_db(power, power.max() if ref < 0 else ref * ref, top_db=None) > -top_db


def trim(y, top_db: float = 60.0, ref: float = -1.0, frame_length: int = 2048, hop_length: int = 512) -> tuple[int, int]:
    on = np.flatnonzero(nonsilent(y, top_db, ref, frame_length, hop_length))
    return (int(on[0]) * hop_length, min(len(y), (int(on[-1]) + 1) * hop_length)) if len(on) else (0, 0)


def split(y, top_db: float = 60.0, ref: float = -1.0, frame_length: int = 2048, hop_length: int = 512) -> list[tuple[int, int]]:
    on = nonsilent(y, top_db, ref, frame_length, hop_length).astype(int)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return [(int(a) * hop_length, min(len(y), int(b) * hop_length)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def preemphasis(y, coef: float = 0.97) -> np.ndarray:
    y = np.asarray(y, float)
    return np.concatenate([y[:1], y[1:] - coef * y[:-1]])


def deemphasis(y, coef: float = 0.97) -> np.ndarray:
    return state_filter([[coef]], [coef], [1.0], 1.0, y, np.zeros(1))[0]


def remix(y, intervals, align_zeros: bool = True) -> np.ndarray:
    y = np.asarray(y, float)
    zeros = np.append(np.flatnonzero(zero_crossings(y)), len(y))
    snap = lambda p: int(zeros[np.argmin(np.abs(zeros - p))]) if align_zeros else int(p)
    parts = [y[snap(a) : snap(b)] for a, b in intervals]
    return np.concatenate(parts) if parts else y[:0]


def buf_to_float(raw: bytes, n_bytes: int = 2) -> np.ndarray:
    if n_bytes == 1:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    if n_bytes not in (2, 4):
        raise ValueError("n_bytes is 1, 2 or 4")
    return np.frombuffer(raw, f"<i{n_bytes}") / float(1 << (8 * n_bytes - 1))

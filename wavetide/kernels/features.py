"""Constant-Q transforms, spectral and rhythm features, pitch. Matrices are (frames, bins)."""

from __future__ import annotations

import math

import numpy as np

from wavetide.plans import banks
from wavetide.plans.banks import SR, TINY

from . import dsp

C1 = 440.0 * 2.0 ** (-45 / 12)


def normalize(s: np.ndarray, norm: float | None = np.inf, axis: int = -1, threshold: float | None = None, fill: bool | None = None) -> np.ndarray:
    s = np.asarray(s, float)
    if norm is None:
        return s
    if not np.isfinite(s).all():
        raise ValueError("the input isn't finite")
    size = np.abs(s)
    if norm == np.inf:
        size = size.max(axis=axis, keepdims=True)
    elif norm == -np.inf:
        size = size.min(axis=axis, keepdims=True)
    elif norm == 0:
        if fill is True:
            raise ValueError("norm 0 can't be filled")
        size = (size > 0).sum(axis=axis, keepdims=True).astype(float)
    elif norm > 0:
        size = (size**norm).sum(axis=axis, keepdims=True) ** (1.0 / norm)
    else:
        raise ValueError("unsupported norm")
    small = size < (TINY if threshold is None else threshold)
    if fill is None:
        return s / np.where(small, 1.0, size)
    out = s / np.where(small, np.nan, size)
    n = s.shape[axis]
    even = 0.0 if not fill else 1.0 if math.isinf(norm) else n ** (-1.0 / norm)
    return np.where(np.isnan(out), even, out)


# constant-Q


def sparsify_complex(x: np.ndarray, quantile: float = 0.01) -> np.ndarray:
    """Drop each row's entries below the one at which the smallest ones together reach the given share of its magnitude."""
    size = np.abs(x)
    ascending = np.sort(size, axis=1)
    total = ascending.sum(axis=1, keepdims=True)
    reached = np.cumsum(ascending, axis=1) >= quantile * total
    least = np.take_along_axis(ascending, np.argmax(reached, axis=1)[:, None], axis=1)
    return np.where((size >= least) & (total > 0), x, 0.0)


def sparsify_rows(x: np.ndarray, quantile: float = 0.01) -> np.ndarray:
    """Zero a row's entries below the value at the given quantile."""
    if not 0 <= quantile < 1:
        raise ValueError("quantile must be in [0, 1)")
    s = np.sort(x, axis=1)
    at = s[:, min(x.shape[1] - 1, int(quantile * x.shape[1]))][:, None]
    return np.where(x < at, 0.0, x)


def _lowest(y, sr: float, fmin: float | None, tuning: float | None, bins_per_octave: int) -> float:
    """The lowest filter's frequency; without a tuning, the signal's own is estimated."""
    tuning = estimate_tuning_audio(y, sr, bins_per_octave=bins_per_octave) if tuning is None else tuning
    return (C1 if fmin is None else fmin) * 2.0 ** (tuning / bins_per_octave)


def _relative(freqs: np.ndarray, bins_per_octave: int) -> np.ndarray:
    """Relative bandwidths; a single filter has that of equal steps."""
    step = 2 ** (2 / bins_per_octave)
    return banks.relative_bandwidth(freqs) if len(freqs) > 1 else np.array([(step - 1) / (step + 1)])


def _filters(freqs, sr, window, filter_scale, norm, sparsity, gamma, alpha, hop_length: int | None = None) -> tuple[np.ndarray, int, np.ndarray]:
    """Half spectra of the wavelets, the size of their transform (at least twice the hop, where one is given) and the
    wavelets' lengths; a wavelet weighs its length over that size."""
    basis, lengths = banks.wavelet(freqs, sr, window, filter_scale, True, norm, gamma, alpha)
    n_fft = basis.shape[1] if hop_length is None else max(basis.shape[1], 2 ** (1 + math.ceil(math.log2(hop_length))))
    spectrum = np.fft.fft(basis * (lengths / n_fft)[:, None], n_fft, axis=1)[:, : n_fft // 2 + 1]
    return (sparsify_complex(spectrum, sparsity) if sparsity > 0 else spectrum), n_fft, lengths


def vqt(y, sr: float = SR, hop_length: int = 512, fmin: float | None = None, n_bins: int = 84, gamma: float | None = None, bins_per_octave: int = 12, tuning: float | None = 0.0, filter_scale: float = 1.0, norm: float | None = 1.0, sparsity: float = 0.01, window: str = "hann", scale: bool = True) -> np.ndarray:
    """(frames, n_bins) complex; octaves from the top, halving the rate where the hop allows, and before the first one
    where no filter needs the high frequencies."""
    y = np.asarray(y, float)
    fmin = _lowest(y, sr, fmin, tuning, bins_per_octave)
    freqs = banks.cqt_frequencies(n_bins, fmin, bins_per_octave)
    alpha = _relative(freqs, bins_per_octave)
    lengths, cutoff = banks.wavelet_lengths(freqs, sr, window, filter_scale, gamma, alpha)
    if cutoff > sr / 2:
        raise ValueError("the highest filter passes the Nyquist frequency")
    octaves, per = math.ceil(n_bins / bins_per_octave), min(bins_per_octave, n_bins)
    twos = (hop_length & -hop_length).bit_length() - 1
    early = min(max(0, math.ceil(math.log2(sr / 2 / cutoff)) - 2), max(0, twos - octaves + 1))
    if early:
        if len(y) < 1 << early:
            raise ValueError("the signal is too short for so many octaves")
        y = dsp.resample(y, 1 << early, 1, "kaiser_hq", scale=True) * (1.0 if scale else math.sqrt(1 << early))
        sr, hop_length = sr / (1 << early), hop_length >> early
        lengths, _ = banks.wavelet_lengths(freqs, sr, window, filter_scale, gamma, alpha)
    out, now, rate, hop = [], y, sr, hop_length
    for i in range(octaves):
        part = slice(n_bins - per * (i + 1) if n_bins - per * (i + 1) > 0 else 0, n_bins - per * i)
        spectrum, n_fft, _ = _filters(freqs[part], rate, window, filter_scale, norm, sparsity, gamma, alpha[part])
        d = dsp.stft(now, n_fft, hop, window="rectangular")
        out.append((part, d @ spectrum.T * math.sqrt(sr / rate)))
        if hop % 2 == 0 and i + 1 < octaves:
            hop, rate, now = hop // 2, rate / 2, dsp.resample(now, 2, 1, "kaiser_hq", scale=True)
    n = min(len(x) for _, x in out)
    c = np.zeros((n, n_bins), complex)
    for part, x in out:
        c[:, part] = x[:n]
    return c / np.sqrt(lengths) if scale else c


def cqt(y, **params) -> np.ndarray:
    return vqt(y, gamma=0.0, **params)


def pseudo_cqt(y, sr: float = SR, hop_length: int = 512, fmin: float | None = None, n_bins: int = 84, bins_per_octave: int = 12, tuning: float | None = 0.0, filter_scale: float = 1.0, norm: float | None = 1.0, sparsity: float = 0.01, window: str = "hann", scale: bool = True) -> np.ndarray:
    fmin = _lowest(y, sr, fmin, tuning, bins_per_octave)
    freqs = banks.cqt_frequencies(n_bins, fmin, bins_per_octave)
    spectrum, n_fft, lengths = _filters(freqs, sr, window, filter_scale, norm, sparsity, 0.0, _relative(freqs, bins_per_octave), hop_length)
    c = np.abs(dsp.stft(y, n_fft, hop_length)) @ np.abs(spectrum).T
    return c / math.sqrt(n_fft) if scale else c * np.sqrt(lengths / n_fft)


def hybrid_cqt(y, sr: float = SR, hop_length: int = 512, fmin: float | None = None, n_bins: int = 84, bins_per_octave: int = 12, tuning: float | None = 0.0, **params) -> np.ndarray:
    fmin = _lowest(y, sr, fmin, tuning, bins_per_octave)
    freqs = banks.cqt_frequencies(n_bins, fmin, bins_per_octave)
    lengths, _ = banks.wavelet_lengths(freqs, sr, alpha=_relative(freqs, bins_per_octave))
    pseudo = 2.0 ** np.ceil(np.log2(lengths)) < 2 * hop_length
    full = int((~pseudo).sum())
    parts = []
    if full:
        parts.append(np.abs(cqt(y, sr=sr, hop_length=hop_length, fmin=fmin, n_bins=full, bins_per_octave=bins_per_octave, **params)))
    if full < n_bins:
        parts.append(pseudo_cqt(y, sr=sr, hop_length=hop_length, fmin=freqs[full], n_bins=n_bins - full, bins_per_octave=bins_per_octave, **params))
    n = min(map(len, parts))
    return np.concatenate([p[:n] for p in parts], axis=1)


def icqt(c: np.ndarray, sr: float = SR, hop_length: int = 512, fmin: float | None = None, bins_per_octave: int = 12, tuning: float = 0.0, filter_scale: float = 1.0, norm: float | None = 1.0, sparsity: float = 0.01, window: str = "hann", scale: bool = True, length: int | None = None) -> np.ndarray:
    """Each octave's bins through the conjugate basis, overlap-added and brought back to the signal's rate."""
    n_bins = c.shape[1]
    freqs = banks.cqt_frequencies(n_bins, (C1 if fmin is None else fmin) * 2.0 ** (tuning / bins_per_octave), bins_per_octave)
    alpha = _relative(freqs, bins_per_octave)
    lengths, _ = banks.wavelet_lengths(freqs, sr, window, filter_scale, 0.0, alpha)
    if length is not None:
        c = c[: math.ceil((length + lengths.max()) / hop_length)]
    octaves = math.ceil(n_bins / bins_per_octave)
    rates = [(sr, hop_length)]  # from the top octave down
    for _ in range(octaves - 1):
        rate, hop = rates[-1]
        rates.append((rate / 2, hop // 2) if hop % 2 == 0 else (rate, hop))
    total = np.zeros(0)
    for i in range(octaves):  # octaves are counted from the lowest bin
        part = slice(bins_per_octave * i, min(n_bins, bins_per_octave * (i + 1)))
        rate, hop = rates[octaves - 1 - i]
        spectrum, n_fft, _ = _filters(freqs[part], rate, window, filter_scale, norm, sparsity, 0.0, alpha[part])
        power = (np.abs(spectrum) ** 2).sum(axis=1)
        gain = np.where(power > 0, n_fft / lengths[part] / np.where(power > 0, power, 1.0), 0.0)
        x = c[:, part] * (np.sqrt(lengths[part]) if scale else 1.0)
        d = x * gain @ spectrum.conj()
        y = dsp.istft(d, hop, n_fft=n_fft, window="rectangular")
        y = dsp.resample(y, rate, sr, "kaiser_hq", scale=False) if rate != sr else y
        n = max(len(total), len(y))
        total = dsp.fix_length(total, n) + dsp.fix_length(y, n)
    return total if length is None else dsp.fix_length(total, length)


def griffinlim_cqt(c: np.ndarray, n_iter: int = 32, sr: float = SR, hop_length: int = 512, fmin: float | None = None, bins_per_octave: int = 12, length: int | None = None, momentum: float = 0.99, init_phase: str | None = "random", random_state: int = 0) -> np.ndarray:
    if momentum < 0:
        raise ValueError("momentum must not be negative")
    turn = np.random.default_rng(random_state).random(c.shape) if init_phase == "random" else np.zeros(c.shape)
    angles, before = np.exp(2j * np.pi * turn), np.zeros(c.shape, complex)
    args = dict(sr=sr, hop_length=hop_length, fmin=fmin, bins_per_octave=bins_per_octave)
    for _ in range(n_iter):
        again = cqt(icqt(c * angles, length=length, **args), n_bins=c.shape[1], **args)
        again = again[: len(c)] if len(again) >= len(c) else np.pad(again, ((0, len(c) - len(again)), (0, 0)))
        angles = again - momentum / (1 + momentum) * before
        size = np.abs(angles)
        angles = np.where(size > TINY, angles / np.where(size > TINY, size, 1.0), 1.0)
        before = again
    return icqt(c * angles, length=length, **args)


# harmonics


def interp_harmonics(x: np.ndarray, freqs: np.ndarray, harmonics, fill_value: float = 0.0) -> np.ndarray:
    """(frames, harmonics * bins): each frame at h times every frequency."""
    out = [[np.interp(h * freqs, freqs, row, fill_value, fill_value) for h in harmonics] for row in x]
    return np.array(out).reshape(len(x), -1)


def f0_harmonics(x: np.ndarray, f0: np.ndarray, freqs: np.ndarray, harmonics, fill_value: float = 0.0) -> np.ndarray:
    keep = np.isfinite(freqs)
    order = np.argsort(freqs[keep])
    grid = freqs[keep][order]
    return np.array([np.interp(np.asarray(harmonics) * f, grid, row[keep][order], fill_value, fill_value) for row, f in zip(x, f0)])


def salience(s: np.ndarray, freqs: np.ndarray, harmonics, weights=None, filter_peaks: bool = True, fill_value: float = 0.0) -> np.ndarray:
    w = np.ones(len(harmonics)) if weights is None else np.asarray(weights, float)
    h = interp_harmonics(s, freqs, harmonics, fill_value).reshape(len(s), len(harmonics), -1)
    out = np.tensordot(w / (w.sum() if w.sum() > 0 else 1.0), h, axes=(0, 1))
    if filter_peaks:
        peak = np.zeros(out.shape, bool)
        peak[:, 1:-1] = (out[:, 1:-1] > out[:, :-2]) & (out[:, 1:-1] >= out[:, 2:])
        if out.shape[1] > 1:
            peak[:, -1] = out[:, -1] > out[:, -2]
        out = np.where(peak, out, 0.0)
    return out


# spectral features of magnitudes or powers


def melspectrogram(s: np.ndarray, sr: float = SR, n_fft: int = 2048, **bank) -> np.ndarray:
    return s @ banks.mel(sr, n_fft, **bank).T


def _in_order(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x @ weights, the terms of a sum added up one after the other."""
    out = np.zeros((len(x), weights.shape[1]))
    for a, w in zip(x.T, weights):
        out += a[:, None] * w
    return out


def mfcc(mel_db: np.ndarray, n_mfcc: int = 20, dct_type: int = 2, ortho: bool = True, lifter: float = 0) -> np.ndarray:
    if lifter < 0:
        raise ValueError("lifter must not be negative")
    m = _in_order(mel_db, banks.dct_basis(n_mfcc, mel_db.shape[1], ortho, dct_type).T)
    return m * (1 + lifter / 2 * np.sin(np.pi * np.arange(1, n_mfcc + 1) / lifter)) if lifter else m


def mfcc_to_mel(m: np.ndarray, n_mels: int = 128, dct_type: int = 2, ortho: bool = True, ref: float = 1.0, lifter: float = 0) -> np.ndarray:
    if lifter:
        m = m / (1 + lifter / 2 * np.sin(np.pi * np.arange(1, m.shape[1] + 1) / lifter))
    inverse = banks.dct_basis(n_mels, m.shape[1], True, 3)
    if m.shape[1] > n_mels and dct_type == 2:
        raise ValueError("more coefficients than bands")
    if dct_type == 2 and ortho:  # rows of the basis are orthonormal; the last coefficient first, as in the query's SQL
        db = _in_order(m[:, ::-1], banks.dct_basis(m.shape[1], n_mels)[::-1])
    elif dct_type == 2:
        basis = banks.dct_basis(n_mels, n_mels, ortho, 2)
        db = np.linalg.solve(basis, np.pad(m, ((0, 0), (0, n_mels - m.shape[1]))).T).T
    else:
        db = m @ inverse.T
    return ref * 10.0 ** (db / 10.0)


def chroma_stft(s: np.ndarray, sr: float = SR, n_fft: int = 2048, tuning: float | None = None, norm: float | None = np.inf, n_chroma: int = 12) -> np.ndarray:
    tuning = estimate_tuning(s, sr, n_fft, bins_per_octave=n_chroma) if tuning is None else tuning
    return normalize(s @ banks.chroma(sr, n_fft, n_chroma, tuning).T, norm)


def chroma_cqt(c: np.ndarray, fmin: float | None = None, norm: float | None = np.inf, threshold: float = 0.0, n_chroma: int = 12, bins_per_octave: int = 36) -> np.ndarray:
    x = c @ banks.cq_to_chroma(c.shape[1], bins_per_octave, n_chroma, fmin).T
    return normalize(np.where(x < threshold, 0.0, x), norm)


def chroma_audio(y, sr: float = SR, hop_length: int = 512, fmin: float | None = None, tuning: float | None = None, n_chroma: int = 12, n_octaves: int = 7, bins_per_octave: int = 36, norm: float | None = np.inf, threshold: float = 0.0, gamma: float | None = 0.0) -> np.ndarray:
    """Chroma of a signal's constant-Q magnitudes; of variable-Q ones with another gamma."""
    c = np.abs(vqt(y, sr, hop_length, fmin, n_octaves * bins_per_octave, gamma, bins_per_octave, tuning))
    return chroma_cqt(c, fmin, norm, threshold, n_chroma, bins_per_octave)


def chroma_cens_audio(y, norm: float | None = 2.0, win_len_smooth: int | None = 41, **params) -> np.ndarray:
    return chroma_cens(chroma_audio(y, norm=None, **params), norm, win_len_smooth)


def chroma_cens(chroma: np.ndarray, norm: float | None = 2.0, win_len_smooth: int | None = 41) -> np.ndarray:
    x = normalize(chroma, 1.0)
    q = sum(0.25 * (x > step) for step in (0.4, 0.2, 0.1, 0.05))
    if win_len_smooth:
        w = banks.get_window("hann", win_len_smooth + 2, fftbins=False)
        w = w / w.sum()
        half = len(w) // 2
        q = np.array([np.convolve(col, w)[half : half + len(col)] for col in q.T]).T
    return normalize(q, norm)


def poly_features(s: np.ndarray, freq: np.ndarray, order: int = 1) -> np.ndarray:
    return s @ np.linalg.pinv(np.vander(freq, order + 1)).T


def tonnetz(chroma: np.ndarray) -> np.ndarray:
    n = chroma.shape[1]
    steps = np.linspace(0, 12, n, endpoint=False)
    v = np.outer([7 / 6, 7 / 6, 3 / 2, 3 / 2, 2 / 3, 2 / 3], steps)
    v[::2] -= 0.5
    return normalize(chroma, 1.0) @ (np.array([1, 1, 1, 1, 0.5, 0.5])[:, None] * np.cos(np.pi * v)).T


def spectral_contrast(s: np.ndarray, freq: np.ndarray, fmin: float = 200.0, n_bands: int = 6, quantile: float = 0.02, linear: bool = False) -> np.ndarray:
    edges = np.concatenate([[0.0], fmin * 2.0 ** np.arange(n_bands + 1)])
    if edges[-2] >= freq[-1]:
        raise ValueError("a band lies above the Nyquist frequency")
    peak, valley = np.zeros((len(s), n_bands + 1)), np.zeros((len(s), n_bands + 1))
    for k in range(n_bands + 1):
        band = (freq >= edges[k]) & (freq <= edges[k + 1])
        at = np.flatnonzero(band)
        if k > 0 and at[0] > 0:
            band[at[0] - 1] = True
        if k == n_bands:
            band[at[-1] + 1 :] = True
        part = s[:, band]
        if k < n_bands and part.shape[1] > 1:
            part = part[:, :-1]
        part = np.sort(part, axis=1)
        n = max(1, math.floor(quantile * int(band.sum()) + 0.5))
        valley[:, k], peak[:, k] = part[:, :n].mean(axis=1), part[:, -n:].mean(axis=1)
    return peak - valley if linear else dsp.power_to_db(peak) - dsp.power_to_db(valley)


def spectral_contrast_audio(y, sr: float = SR, n_fft: int = 2048, hop_length: int = 512, center: bool = True, **params) -> np.ndarray:
    return spectral_contrast(np.abs(dsp.stft(y, n_fft, hop_length, center=center)), banks.fft_frequencies(sr, n_fft), **params)


def delta(data: np.ndarray, width: int = 9, order: int = 1, mode: str = "interp") -> np.ndarray:
    """Savitzky-Golay derivative along time, of data (frames, features)."""
    if width < 3 or width % 2 == 0 or mode == "interp" and width > len(data):
        raise ValueError("width must be odd, at least 3 and at most the number of frames")
    half = width // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    c = math.factorial(order) * fit[order]
    if mode == "interp":
        out = np.apply_along_axis(lambda x: np.convolve(x, c[::-1], "same"), 0, data)
        slopes = [np.polynomial.polynomial.polyder(fit @ data[p], order) for p in (slice(0, width), slice(-width, None))]
        for k in range(half):
            out[k] = np.polynomial.polynomial.polyval(t[k], slopes[0])
            out[len(data) - half + k] = np.polynomial.polynomial.polyval(t[half + 1 + k], slopes[1])
        return out
    pad = {"nearest": "edge", "constant": "constant", "mirror": "reflect", "wrap": "wrap", "edge": "edge"}[mode]
    ext = np.pad(data, ((half, half), (0, 0)), mode=pad)
    return np.apply_along_axis(lambda x: np.convolve(x, c[::-1], "valid"), 0, ext)


def stack_memory(data: np.ndarray, n_steps: int = 2, delay: int = 1, mode: str = "constant") -> np.ndarray:
    if n_steps < 1 or delay == 0:
        raise ValueError("n_steps must be positive and delay not zero")
    reach = abs(delay) * (n_steps - 1)
    ext = np.pad(data, ((reach, 0) if delay > 0 else (0, reach), (0, 0)), mode=mode)
    n = len(data)
    return np.concatenate([ext[reach - k * delay : reach - k * delay + n] if delay > 0 else ext[-k * delay : -k * delay + n] for k in range(n_steps)], axis=1)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares without negative weights for each column of b.

    Active sets on the normal equations: only a'a and a'b are used, and the inverse Cholesky factor of a set of columns is
    kept for all columns of b that come to the same set. A set without a factor (dependent columns) is solved by least
    squares.
    """
    gram, goals = a.T @ a, a.T @ b
    n, out = a.shape[1], np.zeros((a.shape[1], b.shape[1]))
    factors: dict[bytes, np.ndarray | None] = {}

    def solve(on: np.ndarray, goal: np.ndarray) -> np.ndarray:
        key = np.packbits(on).tobytes()
        if key not in factors:
            if len(factors) >= 4096:
                factors.clear()
            own = gram[np.ix_(on, on)]
            try:
                factors[key] = np.linalg.inv(np.linalg.cholesky(own)) if np.linalg.cond(own) < 1e12 else None
            except np.linalg.LinAlgError:
                factors[key] = None
        f = factors[key]
        return f.T @ (f @ goal[on]) if f is not None else np.linalg.lstsq(gram[np.ix_(on, on)], goal[on], rcond=None)[0]

    for col in range(b.shape[1]):
        x, on, goal = np.zeros(n), np.zeros(n, bool), goals[:, col]
        small = 1e-12 * max(1.0, float(np.abs(goal).max(initial=0.0)))
        for _ in range(3 * n):
            w = goal - gram @ x
            w[on] = -np.inf
            if on.all() or w.max() <= small:
                break
            on[int(np.argmax(w))] = True
            while on.any():
                s = np.zeros(n)
                s[on] = solve(on, goal)
                bad = on & (s <= 0)
                if not bad.any():
                    break
                step = np.min(x[bad] / np.maximum(x[bad] - s[bad], TINY))
                x = x + step * (s - x)
                gone = on & (x <= 1e-12 * max(1.0, float(x.max())))
                if not gone.any():  # rounding left the first to reach zero just above it
                    gone[np.flatnonzero(bad)[np.argmin(x[bad])]] = True
                on &= ~gone
                x[~on] = 0
            x = np.where(on, s, 0.0) if on.any() else np.zeros(n)
        out[:, col] = x
    return out


def mel_to_stft(m: np.ndarray, sr: float = SR, n_fft: int = 2048, power: float = 2.0) -> np.ndarray:
    return nnls(banks.mel(sr, n_fft, m.shape[1]), m.T).T ** (1.0 / power)


# pitch


def parabolic_shift(x: np.ndarray) -> np.ndarray:
    """Offset of the extremum through each inner point and its neighbours, along the last axis."""
    out = np.zeros_like(x)
    a = x[..., 2:] + x[..., :-2] - 2 * x[..., 1:-1]
    b = (x[..., 2:] - x[..., :-2]) / 2
    out[..., 1:-1] = np.where(np.abs(b) >= np.abs(a), 0.0, -b / np.where(a == 0, 1.0, a))
    return out


def piptrack(s: np.ndarray, sr: float = SR, n_fft: int = 2048, fmin: float = 150.0, fmax: float = 4000.0, threshold: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    s = np.abs(s)
    freq = banks.fft_frequencies(sr, n_fft)
    shift = parabolic_shift(s)
    slope = np.gradient(s, axis=1)
    keep = np.zeros(s.shape, bool)
    keep[:, 1:-1] = (s[:, 1:-1] > s[:, :-2]) & (s[:, 1:-1] >= s[:, 2:])
    keep &= (freq >= fmin) & (freq < min(fmax, sr / 2)) & (s > threshold * s.max(axis=1, keepdims=True))
    return np.where(keep, (np.arange(s.shape[1]) + shift) * sr / n_fft, 0.0), np.where(keep, s + 0.5 * slope * shift, 0.0)


def pitch_tuning(frequencies, resolution: float = 0.01, bins_per_octave: int = 12) -> float:
    f = np.asarray(frequencies, float)
    f = f[f > 0]
    if not len(f):
        return 0.0
    rest = np.fmod(bins_per_octave * banks.hz_to_octs(f), 1.0)
    rest[rest >= 0.5] -= 1.0
    n = math.ceil(1.0 / resolution)
    at = np.floor((rest + 0.5) / resolution).astype(int)
    return float(-0.5 + resolution * np.argmax(np.bincount(np.clip(at, 0, n - 1), minlength=n)))


def estimate_tuning(s: np.ndarray, sr: float = SR, n_fft: int = 2048, resolution: float = 0.01, bins_per_octave: int = 12, **params) -> float:
    pitch, mag = piptrack(s, sr, n_fft, **params)
    on = pitch > 0
    if not on.any():
        return 0.0
    at = np.sort(mag[on])[on.sum() // 2]  # the upper middle
    return pitch_tuning(pitch[on & (mag >= at)], resolution, bins_per_octave)


def estimate_tuning_audio(y, sr: float = SR, n_fft: int = 2048, **params) -> float:
    return estimate_tuning(np.abs(dsp.stft(y, n_fft)), sr, n_fft, **params)


def _cmnd(y, sr, frame_length, hop, fmin, fmax, center):
    y = dsp.pad_signal(np.asarray(y, float), frame_length // 2, frame_length // 2) if center else np.asarray(y, float)
    if not 0 < fmin < fmax <= sr / 2 or sr / fmin >= frame_length - 1:
        raise ValueError("fmin and fmax must be positive, ascending, at most sr / 2, and a frame longer than the longest period")
    low, high = math.floor(sr / fmax), min(math.ceil(sr / fmin), frame_length - 1)
    x = dsp.frame(y, frame_length, hop)
    size = 1 << (2 * frame_length - 1).bit_length()
    auto = np.fft.irfft(np.abs(np.fft.rfft(x, size, axis=1)) ** 2, size, axis=1)[:, : high + 1]
    energy = np.cumsum(x**2, axis=1)[:, :high]
    d = 2 * (auto[:, :1] - auto[:, 1:]) - energy
    mean = np.cumsum(d, axis=1) / np.arange(1, high + 1)
    return (d / (mean + TINY))[:, low - 1 :], low


def yin(y, fmin: float, fmax: float, sr: float = SR, frame_length: int = 2048, hop_length: int | None = None, trough_threshold: float = 0.1, center: bool = True) -> np.ndarray:
    x, low = _cmnd(y, sr, frame_length, hop_length or frame_length // 4, fmin, fmax, center)
    shift = parabolic_shift(x)
    trough = np.zeros(x.shape, bool)
    trough[:, 1:-1] = (x[:, 1:-1] < x[:, :-2]) & (x[:, 1:-1] <= x[:, 2:])
    trough[:, 0] = x[:, 0] < x[:, 1]
    ok = trough & (x < trough_threshold)
    at = np.where(ok.any(axis=1), np.argmax(ok, axis=1), np.argmin(x, axis=1))
    return sr / (low + at + shift[np.arange(len(x)), at])


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """The beta distribution's cumulative function, by the continued fraction of the incomplete beta function.

    The fraction converges fast below the mean, (a + 1) / (a + b + 2); above it the complement with a and b exchanged does.
    """
    x = np.clip(np.asarray(x, float), 0.0, 1.0)

    def lower(x: np.ndarray, a: float, b: float) -> np.ndarray:
        with np.errstate(divide="ignore"):
            front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        floor = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < floor, floor, d)
        h = d.copy()
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / np.where(np.abs(d) < floor, floor, d), np.where(np.abs(c) < floor, floor, c)
                h *= d * c
            if np.all(np.abs(d * c - 1) < 1e-16):
                break
        return front * h

    low = x < (a + 1) / (a + b + 2)
    out = np.where(low, lower(np.where(low, x, 0.0), a, b), 1 - lower(np.where(low, 0.0, 1 - x), b, a))
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def pyin(y, fmin: float, fmax: float, sr: float = SR, frame_length: int = 2048, hop_length: int | None = None, n_thresholds: int = 100, beta: tuple[float, float] = (2.0, 18.0), boltzmann_parameter: float = 2.0, resolution: float = 0.1, max_transition_rate: float = 35.92, switch_prob: float = 0.01, no_trough_prob: float = 0.01, fill_na: float | None = np.nan, center: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequency, voiced flag and voiced probability of each frame."""
    from .sequence import viterbi

    hop = hop_length or frame_length // 4
    x, low = _cmnd(y, sr, frame_length, hop, fmin, fmax, center)
    shift = parabolic_shift(x)
    thresholds = np.linspace(0, 1, n_thresholds + 1)
    prior = np.diff(beta_cdf(thresholds, *beta))
    bins = int(math.floor(12 * math.ceil(1 / resolution) * math.log2(fmax / fmin))) + 1
    per_semitone = math.ceil(1 / resolution)
    observed = np.zeros((len(x), 2 * bins))
    voiced_prob = np.zeros(len(x))
    for t, row in enumerate(x):
        trough = np.zeros(len(row), bool)
        trough[1:-1] = (row[1:-1] < row[:-2]) & (row[1:-1] <= row[2:])
        trough[0], trough[-1] = row[0] < row[1], row[-1] < row[-2]
        at = np.flatnonzero(trough)
        if not len(at):
            continue
        below = row[at][:, None] < thresholds[1:]
        rank, count = np.cumsum(below, axis=0) - 1, below.sum(axis=0)
        lam = boltzmann_parameter
        weight = np.where(below, (1 - math.exp(-lam)) * np.exp(-lam * rank) / (1 - np.exp(-lam * np.maximum(count, 1))), 0.0)
        p = (weight * prior).sum(axis=1)
        p[int(np.argmin(row[at]))] += no_trough_prob * prior[~below.any(axis=0)].sum()
        f = sr / (low + at + shift[t, at])
        bin_ = 12 * per_semitone * np.log2(f / fmin)
        k = np.clip((np.sign(bin_) * np.floor(np.abs(bin_) + 0.5)).astype(int), 0, bins - 1)
        np.add.at(observed[t], k, p)
        voiced_prob[t] = min(1.0, observed[t, :bins].sum())
    observed[:, bins:] = ((1 - voiced_prob) / bins)[:, None]
    width = math.floor(max_transition_rate * 12 * hop / sr + 0.5) * per_semitone + 1
    width = max(1, min(width, bins))
    move = banks.transition_local(bins, width) if bins > 1 else np.ones((1, 1))
    trans = np.kron(banks.transition_loop(2, 1 - switch_prob), move)
    start = np.full(2 * bins, 0.5 / bins)
    path, _ = viterbi(observed.T, trans, start)
    voiced = path < bins
    f0 = fmin * 2.0 ** ((path % bins) / (12.0 * per_semitone))
    return (f0 if fill_na is None else np.where(voiced, f0, fill_na)), voiced, voiced_prob

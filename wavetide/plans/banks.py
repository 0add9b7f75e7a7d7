"""Constant tables: windows, frequency grids, filter banks, transition matrices. Numpy arrays, small whatever the data.

``bank_table`` turns a matrix into a DataFrame of its non-zero entries, for joins; kernels take the arrays.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SR, N_FFT, HOP, N_MELS = 22050.0, 2048, 512, 128
TINY = np.finfo(np.float64).tiny


def bank_table(spark: SparkSession, bank: np.ndarray, row: str = "m", col: str = "k", value: str = "w") -> DataFrame:
    i, j = np.nonzero(bank)
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), bank[i, j].tolist())), f"{row} int, {col} int, {value} double")


def grid_table(spark: SparkSession, grid: np.ndarray, index: str = "k", value: str = "f") -> DataFrame:
    return spark.createDataFrame(list(enumerate(np.asarray(grid, float).tolist())), f"{index} int, {value} double")


# windows

#: Coefficients of the raised cosine windows.
COSINES = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08)}
ALIASES = {"hanning": "hann", "boxcar": "rectangular", "ones": "rectangular", "triangle": "bartlett", "kaiser": "hann", "gaussian": "hann", "tukey": "hann"}


def get_window(window: str | np.ndarray, n: int, fftbins: bool = True) -> np.ndarray:
    """fftbins: periodic. Kaiser, Gaussian and Tukey are taken for Hann; triangle is Bartlett."""
    if not isinstance(window, str):
        return np.asarray(window, float)
    name = ALIASES.get(window.lower(), window.lower())
    i, period = np.arange(n), n if fftbins else n - 1
    if name == "rectangular":
        return np.ones(n)
    if name == "bartlett":
        ramp = 2.0 * i / max(1, period)
        return np.where(i <= period // 2, ramp, 2.0 - ramp)
    if name not in COSINES:
        raise ValueError(f"unknown window {window!r}")
    return sum((-1) ** k * c * np.cos(2 * np.pi * k * i / max(1, period)) for k, c in enumerate(COSINES[name]))


#: Equivalent noise bandwidths of windows by name, in bins.
BANDWIDTHS = {
    "bart": 1.3334961334912805,
    "barthann": 1.4560255965133932,
    "bartlett": 1.3334961334912805,
    "bkh": 2.0045975283585014,
    "black": 1.7269681554262326,
    "blackharr": 2.0045975283585014,
    "blackman": 1.7269681554262326,
    "blackmanharris": 2.0045975283585014,
    "blk": 1.7269681554262326,
    "bman": 1.7859588613860062,
    "bmn": 1.7859588613860062,
    "bohman": 1.7859588613860062,
    "box": 1.0,
    "boxcar": 1.0,
    "brt": 1.3334961334912805,
    "brthan": 1.4560255965133932,
    "bth": 1.4560255965133932,
    "cosine": 1.2337005350199792,
    "flat": 2.7762255046484143,
    "flattop": 2.7762255046484143,
    "flt": 2.7762255046484143,
    "halfcosine": 1.2337005350199792,
    "ham": 1.3629455320350348,
    "hamm": 1.3629455320350348,
    "hamming": 1.3629455320350348,
    "han": 1.50018310546875,
    "hann": 1.50018310546875,
    "nut": 1.9763500280946082,
    "nutl": 1.9763500280946082,
    "nuttall": 1.9763500280946082,
    "ones": 1.0,
    "par": 1.9174603174603191,
    "parz": 1.9174603174603191,
    "parzen": 1.9174603174603191,
    "rect": 1.0,
    "rectangular": 1.0,
    "tri": 1.3331706523555851,
    "triang": 1.3331706523555851,
    "triangle": 1.3331706523555851,
}


def window_bandwidth(window: str, n: int = 1000) -> float:
    if window in BANDWIDTHS:
        return BANDWIDTHS[window]
    w = get_window(window, n)
    return float(n * np.sum(w**2) / np.sum(np.abs(w)) ** 2)


def window_sumsquare(window: str | np.ndarray, n_frames: int, hop_length: int = HOP, n_fft: int = N_FFT) -> np.ndarray:
    w = _centred(get_window(window, n_fft) if isinstance(window, str) else np.asarray(window, float), n_fft) ** 2
    out = np.zeros(n_fft + hop_length * (n_frames - 1))
    for t in range(n_frames):
        out[t * hop_length : t * hop_length + n_fft] += w
    return out


def _centred(w: np.ndarray, n: int) -> np.ndarray:
    left = (n - len(w)) // 2
    return np.pad(w, (left, n - len(w) - left))


# frequency grids


def fft_frequencies(sr: float = SR, n_fft: int = N_FFT) -> np.ndarray:
    return np.arange(n_fft // 2 + 1) * sr / n_fft


def cqt_frequencies(n_bins: int, fmin: float, bins_per_octave: int = 12, tuning: float = 0.0) -> np.ndarray:
    return fmin * 2.0 ** (tuning / bins_per_octave) * 2.0 ** (np.arange(n_bins) / bins_per_octave)


def hz_to_mel(f, htk: bool = False):
    f = np.asarray(f, float)
    if htk:
        return 2595.0 * np.log10(1.0 + f / 700.0)
    return np.where(f >= 1000.0, 15.0 + np.log(np.maximum(f, 1e-300) / 1000.0) * 27.0 / math.log(6.4), 3.0 * f / 200.0)


def mel_to_hz(m, htk: bool = False):
    m = np.asarray(m, float)
    if htk:
        return 700.0 * (10.0 ** (m / 2595.0) - 1.0)
    return np.where(m >= 15.0, 1000.0 * np.exp(math.log(6.4) / 27.0 * (m - 15.0)), 200.0 * m / 3.0)


def mel_frequencies(n_mels: int = N_MELS, fmin: float = 0.0, fmax: float = 11025.0, htk: bool = False) -> np.ndarray:
    return mel_to_hz(np.linspace(hz_to_mel(fmin, htk), hz_to_mel(fmax, htk), n_mels), htk)


def tempo_frequencies(n_bins: int, hop_length: int = HOP, sr: float = SR) -> np.ndarray:
    if n_bins < 1:
        raise ValueError("n_bins must be positive")
    return np.concatenate([[np.inf], 60.0 * sr / (hop_length * np.arange(1.0, n_bins))])


def fourier_tempo_frequencies(sr: float = SR, win_length: int = 384, hop_length: int = HOP) -> np.ndarray:
    return fft_frequencies(60.0 * sr / hop_length, win_length)


def hz_to_octs(f, tuning: float = 0.0, bins_per_octave: int = 12):
    return np.log2(np.asarray(f, float) / (440.0 * 2.0 ** (tuning / bins_per_octave) / 16.0))


def pythagorean_intervals(bins_per_octave: int = 12, sort: bool = True) -> np.ndarray:
    x = np.modf(np.arange(bins_per_octave) * math.log2(3.0))[0]
    return 2.0 ** (np.sort(x) if sort else x)


def plimit_intervals(primes: list[int], bins_per_octave: int = 12, sort: bool = True) -> np.ndarray:
    """Grow a crystal of prime-power ratios: each new one is the frontier's point nearest in summed harmonic distance."""
    logs = np.log2(np.asarray(primes, float))
    seeds = [s * row for row in np.eye(len(primes), dtype=int) for s in (1, -1)]

    def spread(point: np.ndarray) -> float:
        log_up, log_down = point[point > 0] @ logs[point > 0], -point[point < 0] @ logs[point < 0]
        return float(log_up + log_down)

    chosen = [np.zeros(len(primes), dtype=int)]
    frontier, seen = list(seeds), {tuple(chosen[0]), *map(tuple, seeds)}
    while len(chosen) < bins_per_octave:
        cost = np.array([sum(spread(f - c) for c in chosen) for f in frontier])
        near = [k for k in range(len(frontier)) if cost[k] <= cost.min() + 1e-9]
        point = frontier.pop(min(near, key=lambda k: round(spread(frontier[k]), 9)))
        chosen.append(point)
        for s in seeds:
            if tuple(point + s) not in seen:
                seen.add(tuple(point + s))
                frontier.append(point + s)
    x = np.array([c @ logs for c in chosen])
    x = x - np.floor(x)
    return 2.0 ** (np.sort(x) if sort else x)


def interval_frequencies(n_bins: int, fmin: float, intervals: str | np.ndarray = "equal", bins_per_octave: int = 12, tuning: float = 0.0, sort: bool = True) -> np.ndarray:
    if not isinstance(intervals, str):
        ratios = np.asarray(intervals, float)
        bins_per_octave = len(ratios)
    elif intervals == "equal":
        ratios = 2.0 ** ((tuning + np.arange(bins_per_octave)) / bins_per_octave)
    elif intervals == "pythagorean":
        ratios = pythagorean_intervals(bins_per_octave, sort)
    elif intervals in ("ji3", "ji5", "ji7"):
        ratios = plimit_intervals([p for p in (3, 5, 7) if p <= int(intervals[2])], bins_per_octave, sort)
    else:
        raise ValueError(f"unknown intervals {intervals!r}")
    octaves = -(-n_bins // bins_per_octave)
    grid = (2.0 ** np.arange(octaves)[:, None] * ratios).ravel()[:n_bins]
    return fmin * (np.sort(grid) if sort else grid)


# filter banks


def mel(sr: float = SR, n_fft: int = N_FFT, n_mels: int = N_MELS, fmin: float = 0.0, fmax: float | None = None, htk: bool = False, norm: str | None = "slaney") -> np.ndarray:
    """Triangles between neighbouring mel frequencies, (n_mels, 1 + n_fft/2)."""
    edges = mel_frequencies(n_mels + 2, fmin, sr / 2.0 if fmax is None else fmax, htk)
    f = fft_frequencies(sr, n_fft)
    width = np.diff(edges)
    up = (f - edges[:-2, None]) / width[:-1, None]
    down = (edges[2:, None] - f) / width[1:, None]
    bank = np.maximum(0.0, np.minimum(up, down))
    if norm == "slaney":
        return bank * (2.0 / (edges[2:] - edges[:-2]))[:, None]
    if norm is None:
        return bank
    return normalize_rows(bank, {"l1": 1.0, "l2": 2.0, "inf": np.inf}[norm])


def normalize_rows(x: np.ndarray, norm: float) -> np.ndarray:
    size = np.abs(x).max(axis=1) if math.isinf(norm) else (np.abs(x) ** norm).sum(axis=1) ** (1.0 / norm)
    return x / np.where(size < TINY, 1.0, size)[:, None]


def chroma(sr: float = SR, n_fft: int = N_FFT, n_chroma: int = 12, tuning: float = 0.0, ctroct: float = 5.0, octwidth: float | None = 2.0, norm: float | None = 2.0, base_c: bool = True) -> np.ndarray:
    """Gaussian bumps around pitch classes, (n_chroma, 1 + n_fft/2)."""
    f = np.arange(1, n_fft) * sr / n_fft
    bins = n_chroma * hz_to_octs(f, tuning, n_chroma)
    bins = np.concatenate([[bins[0] - 1.5 * n_chroma], bins])  # the zero frequency lies 1.5 octaves below the first
    width = np.concatenate([np.maximum(1.0, np.diff(bins)), [1.0]])
    half = round(n_chroma / 2.0)
    away = np.remainder(bins - np.arange(n_chroma)[:, None] + half + 10 * n_chroma, n_chroma) - half
    bank = np.exp(-0.5 * (2.0 * away / width) ** 2)
    if norm is not None:
        bank = normalize_rows(bank.T, norm).T
    if octwidth is not None:
        bank = bank * np.exp(-0.5 * ((bins / n_chroma - ctroct) / octwidth) ** 2)
    if base_c:
        bank = np.roll(bank, -3 * (n_chroma // 12), axis=0)
    return np.ascontiguousarray(bank[:, : n_fft // 2 + 1])


def cq_to_chroma(n_input: int, bins_per_octave: int = 12, n_chroma: int = 12, fmin: float | None = None, base_c: bool = True) -> np.ndarray:
    if bins_per_octave % n_chroma:
        raise ValueError("bins_per_octave must be a multiple of n_chroma")
    merge = bins_per_octave // n_chroma
    fold = np.roll(np.repeat(np.eye(n_chroma), merge, axis=1), -(merge // 2), axis=1)
    fold = np.tile(fold, -(-n_input // bins_per_octave))[:, :n_input]
    midi = (12 * math.log2((32.70319566257483 if fmin is None else fmin) / 440.0) + 69) % 12
    roll = round((midi if base_c else midi - 9) * (n_chroma / 12.0))
    return np.roll(fold, roll, axis=0)


def dct_basis(n: int, n_in: int, ortho: bool = True, kind: int = 2) -> np.ndarray:
    """Rows of the cosine transform: kind 2, or 3 (its inverse up to scale)."""
    i, j = np.arange(n)[:, None], np.arange(n_in)
    if kind == 2:
        c = 2.0 * np.cos(np.pi * i * (2 * j + 1) / (2.0 * n_in))
        return c * np.where(i == 0, math.sqrt(1.0 / (4 * n_in)), math.sqrt(1.0 / (2 * n_in))) if ortho else c
    c = np.cos(np.pi * j * (2 * i + 1) / (2.0 * n_in))
    return c * np.where(j == 0, math.sqrt(1.0 / n_in), math.sqrt(2.0 / n_in)) if ortho else np.where(j == 0, 1.0, 2.0 * c)


def relative_bandwidth(freqs: np.ndarray) -> np.ndarray:
    freqs = np.asarray(freqs, float)
    if len(freqs) < 2:
        raise ValueError("two or more frequencies are needed")
    octs = np.log2(freqs)
    step = np.concatenate([[2 * (octs[1] - octs[0])], octs[2:] - octs[:-2], [2 * (octs[-1] - octs[-2])]])
    return (2.0**step - 1) / (2.0**step + 1)


def wavelet_lengths(freqs: np.ndarray, sr: float = SR, window: str = "hann", filter_scale: float = 1.0, gamma: float | None = 0.0, alpha: float | np.ndarray | None = None) -> tuple[np.ndarray, float]:
    freqs = np.asarray(freqs, float)
    if filter_scale <= 0 or gamma is not None and gamma < 0 or (freqs <= 0).any() or (np.diff(freqs) <= 0).any():
        raise ValueError("frequencies must be positive and ascending, filter_scale positive, gamma not negative")
    a = relative_bandwidth(freqs) if alpha is None else np.broadcast_to(np.asarray(alpha, float), freqs.shape)
    g = a * 24.7 / 0.108 if gamma is None else gamma
    q = filter_scale / a
    cutoff = float(np.max(freqs * (1 + 0.5 * window_bandwidth(window) / q) + 0.5 * g))
    return q * sr / (freqs + g / a), cutoff


def wavelet(freqs: np.ndarray, sr: float = SR, window: str = "hann", filter_scale: float = 1.0, pad_fft: bool = True, norm: float | None = 1.0, gamma: float | None = 0.0, alpha=None) -> tuple[np.ndarray, np.ndarray]:
    """Windowed complex sinusoids, centred in rows of one length, and their real lengths."""
    lengths, _ = wavelet_lengths(freqs, sr, window, filter_scale, gamma, alpha)
    rows = []
    for f, n in zip(freqs, lengths):
        t = np.arange(-math.ceil(n / 2), math.floor(n / 2))
        w = np.exp(2j * np.pi * f / sr * t) * get_window(window, len(t))
        if norm is not None:
            size = np.abs(w).max() if math.isinf(norm) else (np.abs(w) ** norm).sum() ** (1 / norm)
            w = w / size if size > 0 else w
        rows.append(w)
    most = max(map(len, rows))
    size = 2 ** math.ceil(math.log2(most)) if pad_fft else most
    return np.array([_centred(r, size) for r in rows]), lengths


def rotate(image: np.ndarray, angle: float) -> np.ndarray:
    """Bilinear rotation about the centre by angle (radians), zero outside."""
    n, m = image.shape
    cy, cx = (n - 1) / 2.0, (m - 1) / 2.0
    y, x = np.meshgrid(np.arange(n) - cy, np.arange(m) - cx, indexing="ij")
    sy, sx = y * math.cos(angle) - x * math.sin(angle) + cy, y * math.sin(angle) + x * math.cos(angle) + cx
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    out = np.zeros_like(image, dtype=float)
    for dy in (0, 1):
        for dx in (0, 1):
            yy, xx = y0 + dy, x0 + dx
            w = (1 - np.abs(sy - yy)) * (1 - np.abs(sx - xx))
            ok = (yy >= 0) & (yy < n) & (xx >= 0) & (xx < m)
            out[ok] += w[ok] * image[yy[ok], xx[ok]]
    return out


def diagonal_filter(window: str, n: int, slope: float = 1.0, angle: float | None = None, zero_mean: bool = False) -> np.ndarray:
    angle = math.atan(slope) if angle is None else angle
    image = np.diag(get_window(window, n, fftbins=False))
    if abs(angle - math.pi / 4) > 1e-10:
        image = rotate(image, -(angle - math.pi / 4))
    image = np.maximum(image, 0.0)
    image = image / image.sum() if image.sum() > 0 else image
    return image - image.mean() if zero_mean else image


def mr_frequencies(tuning: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """85 semitones and the sampling rate that each is filtered at."""
    freqs = 440.0 * 2.0 ** ((np.arange(24, 109) + tuning - 69) / 12.0)
    rates = np.concatenate([np.full(36, 882.0), np.full(34, 4410.0), np.full(15, 22050.0)])
    return freqs, rates


# transition matrices


def transition_uniform(n: int) -> np.ndarray:
    if n < 1:
        raise ValueError("n_states must be positive")
    return np.full((n, n), 1.0 / n)


def _probabilities(n: int, prob) -> np.ndarray:
    p = np.broadcast_to(np.asarray(prob, float), (n,))
    if n < 2 or (p < 0).any() or (p > 1).any():
        raise ValueError("n_states must exceed 1 and probabilities lie in [0, 1]")
    return p


def transition_loop(n: int, prob) -> np.ndarray:
    p = _probabilities(n, prob)
    out = np.repeat(((1 - p) / (n - 1))[:, None], n, axis=1)
    np.fill_diagonal(out, p)
    return out


def transition_cycle(n: int, prob) -> np.ndarray:
    p = _probabilities(n, prob)
    return np.diag(p) + np.roll(np.diag(1 - p), 1, axis=1)


def transition_local(n: int, width: int, window: str = "triangle", wrap: bool = False) -> np.ndarray:
    """A window of the given width around the diagonal, rows summing to one."""
    w = get_window(window, width)
    out = np.zeros((n, n))
    for i in range(n):
        for k, x in enumerate(w):
            j = i + k - width // 2
            if wrap:
                out[i, j % n] += x
            elif 0 <= j < n:
                out[i, j] = x
    total = out.sum(axis=1, keepdims=True)
    return out / np.where(total > 0, total, 1.0)


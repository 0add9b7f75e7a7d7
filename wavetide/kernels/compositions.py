"""Chains of kernels for one signal, and the small steps that only they use. Matrices are (frames, features)."""

from __future__ import annotations

import numpy as np

from wavetide.kernels import dsp, features, rhythm, sequence


def relative_db(db: np.ndarray, floor: float = -80.0) -> np.ndarray:
    """Levels below the largest, floored."""
    return np.maximum(floor, db - db.max()) if db.size else db


def nn_filter_median(s: np.ndarray, neighbors: int = 8, width: int = 1) -> np.ndarray:
    """Each frame becomes the median of its most similar frames by cosine, ties to the smaller number.

    Frames at most width away don't count, unless that would leave none or one of them; a frame without direction is similar
    to none. There are at most one frame fewer than in all.
    """
    n = len(s)
    neighbors = min(neighbors, max(1, n - 1))
    size = np.sqrt((s * s).sum(axis=1))
    size[size == 0] = 1.0
    likeness = (s @ s.T) / (size[:, None] * size)
    at = np.arange(n)
    out = np.empty(s.shape)
    for i in range(n):
        others = at[np.abs(at - i) > width] if n > 2 * width + 1 else at
        chosen = others[np.argsort(-likeness[i, others], kind="stable")[:neighbors]]
        out[i] = np.median(s[chosen], axis=0) if len(chosen) else s[i]
    return out


def robust_beat_frames(beats, last: int) -> np.ndarray:
    """Distinct beats in 0 to last with both ends; even steps where there are fewer than four."""
    frames = np.unique(np.floor(np.asarray(beats, float) + 0.5).astype(int))
    frames = frames[(frames >= 0) & (frames <= last)]
    if len(frames) < 4:
        frames = np.arange(0, last + 1, max(3, last // 8))
    return sequence.fix_frames(frames, 0, last)


def sync_median(s: np.ndarray, bounds) -> np.ndarray:
    """Medians between bounds; the spans cover all frames."""
    at = np.unique(np.concatenate([[0], np.asarray(bounds, int), [len(s)]]))
    at = at[(at >= 0) & (at <= len(s))]
    return np.array([np.median(s[a:b], axis=0) for a, b in zip(at, at[1:])])


def preset(y, sr: float, n_fft: int, hop_length: int, rate: float | None = None, n_mels: int = 80) -> np.ndarray:
    """Mel levels below the largest, at another rate if asked for."""
    if rate is not None and rate != sr:
        y, sr = dsp.resample(y, sr, rate, "linear"), rate
    power = np.abs(dsp.stft(y, n_fft, hop_length)) ** 2
    return relative_db(dsp.power_to_db(features.melspectrogram(power, sr, n_fft, n_mels=n_mels), top_db=None))


#: Window sizes of the peak picker in frames, its threshold and least distance.
PEAKS = dict(pre_max=3, post_max=3, pre_avg=3, post_avg=5, delta=0.05, wait=4)


def superflux(y, sr: float, n_fft: int = 1024, hop_length: int | None = None, n_mels: int = 96, fmin: float = 27.5, fmax: float | None = None, lag: int = 2, max_size: int = 3) -> np.ndarray:
    """Onsets of the flux over several frames against a reference that vibrato can't pass."""
    hop = hop_length or max(64, int(sr / 200 + 0.5))
    power = np.abs(dsp.stft(y, n_fft, hop)) ** 2
    mel = features.melspectrogram(power, sr, n_fft, n_mels=n_mels, fmin=fmin, fmax=min(8000.0, sr / 2 - 100) if fmax is None else fmax)
    levels = relative_db(dsp.power_to_db(mel, top_db=None))
    return rhythm.onset_detect(rhythm.onset_strength(levels, lag=lag, max_size=max_size), sr, hop, **PEAKS)


def separate_vocals(y, sr: float, n_fft: int = 1024, hop_length: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes of the foreground, and of the background that similar frames share."""
    full = np.abs(dsp.stft(y, n_fft, hop_length))
    width = max(2, int(sr / hop_length + 0.5))
    shared = np.minimum(full, nn_filter_median(full, min(12, max(2, len(full) // 4)), width))
    rest = np.maximum(0.0, full - shared)
    return sequence.softmask(rest, 10 * shared, 2.0) * full, sequence.softmask(shared, 2 * rest, 2.0) * full


def sync_path(y, sr: float, n_fft: int = 2048, hop_length: int = 512, rate: float = 1.32, stretch_fft: int = 1024, stretch_hop: int = 256) -> list[tuple[int, int]]:
    """The warping path between the chroma of a signal and of its faster copy, both of Euclidean length one."""

    def chroma(x):
        return features.chroma_stft(np.abs(dsp.stft(x, n_fft, hop_length)) ** 2, sr, n_fft, tuning=0.0, norm=2.0)

    return sequence.dtw_backtrack(chroma(y), chroma(dsp.time_stretch(y, rate, stretch_fft, stretch_hop)))[1]


def enhanced_chroma(y, sr: float, n_fft: int = 2048, hop_length: int = 512, n_octaves: int = 5, bins_per_octave: int = 36, fmin: float | None = None, margin: float = 8.0) -> np.ndarray:
    """Chroma of the harmonic signal, smoothed over similar frames and by a median of nine frames."""
    d = sequence.hpss(dsp.stft(y, n_fft, hop_length), margin=(margin, 1.0))[0]
    harmonic = dsp.istft(d, hop_length, length=len(y))
    c = features.chroma_audio(harmonic, sr, hop_length, fmin, n_octaves=n_octaves, bins_per_octave=bins_per_octave)
    c = np.minimum(c, nn_filter_median(c, min(8, max(2, len(c) // 4)), 2))
    return sequence.median_filter_2d(c, (9, 1), "edge")


def structure(y, sr: float, n_fft: int = 2048, hop_length: int = 512, k: int = 5, start_bpm: float = 112.0) -> dict[str, np.ndarray]:
    """Beat frames, their chroma, its recurrence plot, the plot's paths, and the borders of k sections of the chroma."""
    power = np.abs(dsp.stft(y, n_fft, hop_length)) ** 2
    chroma = features.chroma_stft(power, sr, n_fft, norm=2.0)
    _, beats = rhythm.beat_track(rhythm.onset_envelope(y, sr, n_fft, hop_length), sr, hop_length, start_bpm, trim=False)
    beats = robust_beat_frames(beats, len(chroma))
    synced = sync_median(chroma, beats)
    n = len(synced)
    first = sequence.agglomerative(synced, min(k, n))
    out = {"beats": beats, "chroma": synced, "borders": np.unique(np.concatenate([[0], beats[np.minimum(first, len(beats) - 1)], [len(chroma)]]))}
    if n > 6:  # fewer frames are too near to each other
        out["recurrence"] = sequence.recurrence_matrix(synced, min(4, n - 1), 2, mode="affinity", sym=True, self_=True)
        out["paths"] = sequence.path_enhance(out["recurrence"], 5, n_filters=5)
    return out

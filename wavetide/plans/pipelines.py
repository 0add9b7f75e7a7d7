"""Fixed compositions of operators over many signals: presets, onsets by spectral flux, separation, alignment, structure.

Each takes wide signals (signal_id, y). A whole chain runs as one kernel on each signal, so intermediate matrices never
leave the worker that made them; other keyword parameters are the kernel's (wavetide/kernels/compositions.py).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from wavetide.kernels import compositions as C
from wavetide.kernels import dsp, sequence
from wavetide.operators.kernels import apply


def presets(signals: DataFrame, sr: float, settings: dict[str, tuple], n_mels: int = 80) -> dict[str, DataFrame]:
    """Mel levels at several sizes of window and hop, and rates (a third value), by name."""
    return {name: apply(signals, lambda y, at=at: C.preset(y, sr, *at, n_mels=n_mels), ("y",), "frames") for name, at in settings.items()}


def superflux(signals: DataFrame, sr: float, **params) -> DataFrame:
    """Onsets of the lagged flux against a maximum-filtered reference."""
    return apply(signals, lambda y: C.superflux(y, sr, **params), ("y",), "events")


def energy_shares(signals: DataFrame, n_fft: int, hop_length: int, kernel_size: int = 9) -> DataFrame:
    """Share of harmonic energy at margins 1 and 8."""

    def run(y):
        d = dsp.stft(y, n_fft, hop_length)
        whole = float((np.abs(d) ** 2).sum()) or 1.0
        return np.array([(np.abs(sequence.hpss(d, kernel_size, margin=m)[0]) ** 2).sum() / whole for m in (1.0, 8.0)])

    return apply(signals, run, ("y",), "series")


def vocal_separation(signals: DataFrame, sr: float, **params) -> DataFrame:
    """Foreground (a) and background (b) magnitudes: what similar frames share is background."""
    return apply(signals, lambda y: C.separate_vocals(y, sr, **params), ("y",), "two_frames")


def music_sync(signals: DataFrame, sr: float, **params) -> DataFrame:
    """The warping path between a signal's chroma and that of its stretched copy."""
    return apply(signals, lambda y: C.sync_path(y, sr, **params), ("y",), "path")


def enhanced_chroma(signals: DataFrame, sr: float, **params) -> DataFrame:
    """Constant-Q chroma of the harmonic part, smoothed over similar frames and in time."""
    return apply(signals, lambda y: C.enhanced_chroma(y, sr, **params), ("y",), "frames")


def segmentation(signals: DataFrame, sr: float, result: str = "borders", **params) -> DataFrame:
    """Borders of sections; or the beat frames, chroma, recurrence plot or its paths, by result."""
    shape = {"borders": "events", "beats": "events", "chroma": "frames", "recurrence": "frames", "paths": "frames"}[result]
    return apply(signals, lambda y: C.structure(y, sr, **params).get(result, np.empty((0, 0))), ("y",), shape)

"""Unit conversions as Column expressions. Arguments that vary by row are Columns; parameters are Python numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SR, HOP, A4 = 22050.0, 512, 440.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _positive(log, x: Column) -> Column:
    """Spark's logarithms of zero are NULL; the engine's is minus infinity, below zero NaN."""
    return F.when(x > 0, log(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def log2(x) -> Column:
    return _positive(F.log2, _c(x).cast("double"))


def log10(x) -> Column:
    return _positive(F.log10, _c(x).cast("double"))


# time units


def frames_to_samples(frames, hop_length: int = HOP, n_fft: int | None = None) -> Column:
    return F.floor(_c(frames)) * hop_length + (n_fft // 2 if n_fft else 0)


def samples_to_frames(samples, hop_length: int = HOP, n_fft: int | None = None) -> Column:
    """Rounds down, as for arrays of samples."""
    return F.floor((_c(samples) - (n_fft // 2 if n_fft else 0)) / F.lit(float(hop_length)))


def samples_to_frames_scalar(samples, hop_length: int = HOP, n_fft: int | None = None) -> Column:
    """Rounds towards zero, as for a single number of samples."""
    x = (_c(samples) - (n_fft // 2 if n_fft else 0)) / F.lit(float(hop_length))
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def frames_to_time(frames, sr: float = SR, hop_length: int = HOP, n_fft: int | None = None) -> Column:
    return frames_to_samples(frames, hop_length, n_fft) / F.lit(float(sr))


def time_to_samples(times, sr: float = SR) -> Column:
    return F.floor(_c(times) * float(sr))


def time_to_frames(times, sr: float = SR, hop_length: int = HOP, n_fft: int | None = None) -> Column:
    return samples_to_frames(time_to_samples(times, sr), hop_length, n_fft)


def samples_to_time(samples, sr: float = SR) -> Column:
    return _c(samples) / F.lit(float(sr))


def blocks_to_frames(blocks, block_length: int) -> Column:
    return _c(blocks) * block_length


def blocks_to_samples(blocks, block_length: int, hop_length: int) -> Column:
    return blocks_to_frames(blocks, block_length) * hop_length


def blocks_to_time(blocks, block_length: int, hop_length: int, sr: float) -> Column:
    return blocks_to_samples(blocks, block_length, hop_length) / F.lit(float(sr))


# pitch scales


def midi_to_hz(midi) -> Column:
    return A4 * F.pow(F.lit(2.0), (_c(midi) - 69.0) / 12.0)


def hz_to_midi(hz) -> Column:
    return 12.0 * (log2(hz) - math.log2(A4)) + 69.0


def hz_to_mel(hz, htk: bool = False) -> Column:
    f = _c(hz).cast("double")
    if htk:
        return 2595.0 * log10(1.0 + f / 700.0)
    return F.when(f >= 1000.0, 15.0 + F.log(f / 1000.0) / (math.log(6.4) / 27.0)).otherwise(3.0 * f / 200.0)


def mel_to_hz(mel, htk: bool = False) -> Column:
    m = _c(mel).cast("double")
    if htk:
        return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1.0)
    return F.when(m >= 15.0, 1000.0 * F.exp((math.log(6.4) / 27.0) * (m - 15.0))).otherwise(200.0 * m / 3.0)


def hz_to_octs(hz, tuning: float = 0.0, bins_per_octave: int = 12) -> Column:
    return log2(_c(hz) / (A4 * 2.0 ** (tuning / bins_per_octave) / 16.0))


def octs_to_hz(octs, tuning: float = 0.0, bins_per_octave: int = 12) -> Column:
    return (A4 * 2.0 ** (tuning / bins_per_octave) / 16.0) * F.pow(F.lit(2.0), _c(octs))


def A4_to_tuning(a4, bins_per_octave: int = 12) -> Column:  # noqa: N802
    return float(bins_per_octave) * (log2(a4) - math.log2(A4))


def tuning_to_A4(tuning, bins_per_octave: int = 12) -> Column:  # noqa: N802
    return A4 * F.pow(F.lit(2.0), _c(tuning) / float(bins_per_octave))


# frequency weighting. The pole frequencies (Hz) and offsets (dB) of the A, B, C and D curves.
POLES = {"outer": 12194.217, "low": 20.598997, "a1": 107.65265, "a2": 737.86223, "b": 158.48932}
OFFSETS = {"A": 2.0, "B": 0.17, "C": 0.062}
D_CURVE = (8.3046305e-3, 1018.7, 1039.6, 3136.5, 3424.0, 282.7, 1160.0)


def _floor(db: Column, min_db: float | None) -> Column:
    return db if min_db is None else F.greatest(F.lit(float(min_db)), db)


def _abc(hz, kind: str, squares: float, roots: tuple[str, ...], min_db: float | None) -> Column:
    f2 = F.pow(_c(hz).cast("double"), F.lit(2.0))
    top, low = POLES["outer"] ** 2, POLES["low"] ** 2
    db = math.log10(top) + squares * log10(f2) - log10(f2 + top) - log10(f2 + low)
    for r in roots:
        db = db - 0.5 * log10(f2 + POLES[r] ** 2)
    return _floor(OFFSETS[kind] + 20.0 * db, min_db)


def A_weighting(hz, min_db: float | None = -80.0) -> Column:  # noqa: N802
    return _abc(hz, "A", 2.0, ("a1", "a2"), min_db)


def B_weighting(hz, min_db: float | None = -80.0) -> Column:  # noqa: N802
    return _abc(hz, "B", 1.5, ("b",), min_db)


def C_weighting(hz, min_db: float | None = -80.0) -> Column:  # noqa: N802
    return _abc(hz, "C", 1.0, (), min_db)


def D_weighting(hz, min_db: float | None = -80.0) -> Column:  # noqa: N802
    f2 = F.pow(_c(hz).cast("double"), F.lit(2.0))
    c = [x * x for x in D_CURVE]
    bump = log10(F.pow(c[1] - f2, F.lit(2.0)) + c[2] * f2) - log10(F.pow(c[3] - f2, F.lit(2.0)) + c[4] * f2)
    db = 0.5 * log10(f2) - math.log10(D_CURVE[0]) + 0.5 * (bump - log10(c[5] + f2) - log10(c[6] + f2))
    return _floor(20.0 * db, min_db)


def Z_weighting(hz, min_db: float | None = -80.0) -> Column:  # noqa: N802
    return _c(hz).cast("double") * 0.0


WEIGHTINGS = {"A": A_weighting, "B": B_weighting, "C": C_weighting, "D": D_weighting, "Z": Z_weighting}


def frequency_weighting(hz, kind: str = "A", min_db: float | None = -80.0) -> Column:
    if kind not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {kind!r}; one of {', '.join(WEIGHTINGS)}")
    return WEIGHTINGS[kind](hz, min_db)


# levels


def power_to_db(power, ref: float = 1.0, amin: float = 1e-10, ceiling: Column | None = None, top_db: float | None = 80.0) -> Column:
    """ceiling: the largest level of the whole matrix (a window's maximum); without it top_db isn't applied."""
    if amin <= 0:
        raise ValueError("amin must be positive")
    db = 10.0 * F.log10(F.greatest(F.lit(amin), _c(power))) - 10.0 * math.log10(max(amin, abs(ref)))
    return db if ceiling is None or top_db is None else F.greatest(db, ceiling - float(top_db))


def amplitude_to_db(amplitude, ref: float = 1.0, amin: float = 1e-5, ceiling: Column | None = None, top_db: float | None = 80.0) -> Column:
    return power_to_db(F.pow(_c(amplitude), F.lit(2.0)), ref * ref, amin * amin, ceiling, top_db)


def db_to_power(db, ref: float = 1.0) -> Column:
    return float(ref) * F.pow(F.lit(10.0), _c(db) * 0.1)


def db_to_amplitude(db, ref: float = 1.0) -> Column:
    return F.sqrt(db_to_power(db, ref * ref))


def mu_compress(x, mu: float = 255, quantize: bool = True) -> Column:
    v = _c(x)
    v = F.when(F.abs(v) > 1, F.raise_error(F.lit("mu_compress takes values in [-1, 1]")).cast("double")).otherwise(v)
    y = F.signum(v) * F.log1p(mu * F.abs(v)) / math.log1p(mu)
    levels = int(mu) + 1
    return F.floor((y + 1.0) / 2.0 * (levels - 1) + 0.5) - levels // 2 if quantize else y


def mu_expand(x, mu: float = 255, quantize: bool = True) -> Column:
    v = _c(x).cast("double")
    v = v * (2.0 / (1.0 + mu)) if quantize else v
    return F.signum(v) / float(mu) * (F.pow(F.lit(1.0 + mu), F.abs(v)) - 1.0)


# complex numbers as pairs of columns


def abs2(re, im) -> Column:
    return _c(re) * _c(re) + _c(im) * _c(im)


def magnitude(re, im) -> Column:
    return F.sqrt(abs2(re, im))


def phase(re, im) -> Column:
    return F.atan2(_c(im), _c(re))


def unit_phase(re, im) -> tuple[Column, Column]:
    """The phase part of magphase: 1 where the magnitude is zero."""
    m = magnitude(re, im)
    return F.when(m == 0, F.lit(1.0)).otherwise(_c(re) / m), F.when(m == 0, F.lit(0.0)).otherwise(_c(im) / m)


def phasor(angle, mag=1.0) -> tuple[Column, Column]:
    return _c(mag) * F.cos(_c(angle)), _c(mag) * F.sin(_c(angle))


def softmask(x, ref, power: float = 1.0, split_zeros: bool = False) -> Column:
    """x**p / (x**p + ref**p); 0, or a half, where both are zero. The larger of the two scales both first."""
    if power <= 0:
        raise ValueError("power must be positive")
    a, b = _c(x), _c(ref)
    top = F.greatest(a, b)
    if math.isinf(power):
        return (a > b).cast("double")
    p, q = F.pow(a / top, F.lit(float(power))), F.pow(b / top, F.lit(float(power)))
    return F.when(F.least(a, b) < 0, F.raise_error(F.lit("softmask takes values of at least zero")).cast("double")).when(top < 2.2250738585072014e-308, F.lit(0.5 if split_zeros else 0.0)).otherwise(p / (p + q))

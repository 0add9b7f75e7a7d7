"""Operators that run a numpy kernel on each signal, in Arrow batches.

The input has one row per signal, with ``signal_id`` and one array column for each signal or matrix that the kernel
takes (``y``: array of doubles; ``S`` and the like: array of frames). Rows are independent, so an operator never
shuffles; a plan's parallelism is that of its input. Results come as rows of one of the SHAPES. Signals that a kernel
refuses (too short, say) raise, unless ``skip`` is set; nulls give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetide.kernels import compositions, dsp, features, rhythm, sequence
from wavetide.plans import banks

_F, _L = pa.float64(), pa.int64()
_FS, _FT = pa.list_(_F), T.ArrayType(T.DoubleType())
#: Columns behind signal_id for each shape of result, with their Arrow and Spark types.
SHAPES = {
    "signal": [("y", _FS, _FT)],
    "value": [("value", _F, T.DoubleType())],
    "text": [("value", pa.string(), T.StringType())],
    "frames": [("t", _L, T.LongType()), ("f", _FS, _FT)],
    "complex": [("t", _L, T.LongType()), ("re", _FS, _FT), ("im", _FS, _FT)],
    "series": [("t", _L, T.LongType()), ("v", _F, T.DoubleType())],
    "flags": [("t", _L, T.LongType()), ("v", pa.bool_(), T.BooleanType())],
    "events": [("event_no", _L, T.LongType()), ("frame", _L, T.LongType())],
    "intervals": [("interval_no", _L, T.LongType()), ("start", _L, T.LongType()), ("end", _L, T.LongType())],
    "path": [("step", _L, T.LongType()), ("i", _L, T.LongType()), ("j", _L, T.LongType())],
    "edges": [("i", _L, T.LongType()), ("j", _L, T.LongType()), ("w", _F, T.DoubleType())],
    "pitch": [("t", _L, T.LongType()), ("f0", _F, T.DoubleType()), ("voiced", pa.bool_(), T.BooleanType()), ("voiced_prob", _F, T.DoubleType())],
    "two_frames": [("t", _L, T.LongType()), ("a", _FS, _FT), ("b", _FS, _FT)],
    "three_frames": [("t", _L, T.LongType()), ("a", _FS, _FT), ("b", _FS, _FT), ("c", _FS, _FT)],
    "two_complex": [("t", _L, T.LongType()), ("a_re", _FS, _FT), ("a_im", _FS, _FT), ("b_re", _FS, _FT), ("b_im", _FS, _FT)],
    "beats": [("bpm", _F, T.DoubleType()), ("event_no", _L, T.LongType()), ("frame", _L, T.LongType())],
}


def _lists(x) -> pa.Array:
    """Rows of a matrix as lists of doubles."""
    x = np.ascontiguousarray(x, float)
    x = x.reshape(len(x), -1) if len(x) else np.empty((0, 0))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _rows(shape: str, result) -> list[pa.Array]:
    """Columns of a kernel's result."""
    count = lambda x: pa.array(np.arange(len(x)), _L)
    if shape == "signal":
        return [_lists(np.asarray(result, float)[None])]
    if shape in ("value", "text"):
        return [pa.array([result], SHAPES[shape][0][1])]
    if shape == "frames":
        return [count(result), _lists(result)]
    if shape == "complex":
        return [count(result), _lists(result.real), _lists(result.imag)]
    if shape == "two_complex":
        return [count(result[0]), *(_lists(p) for x in result for p in (x.real, x.imag))]
    if shape in ("series", "flags", "events"):
        return [count(result), pa.array(np.asarray(result, {"series": float, "flags": bool, "events": np.int64}[shape]))]
    if shape in ("intervals", "path"):
        x = np.array(result, np.int64).reshape(-1, 2)
        return [count(x), pa.array(x[:, 0]), pa.array(x[:, 1])]
    if shape == "edges":
        i, j = np.nonzero(result)
        return [pa.array(i, _L), pa.array(j, _L), pa.array(result[i, j], _F)]
    if shape == "beats":
        bpm, beats = result
        return [pa.array(np.full(len(beats), bpm), _F), count(beats), pa.array(beats, _L)]
    if shape == "pitch":
        return [count(result[0]), *(pa.array(x) for x in result)]
    return [count(result[0]), *map(_lists, result)]


def _inputs(column: pa.Array):
    """Each row's number, vector or matrix; None for a null."""
    if not pa.types.is_list(column.type):
        yield from column.to_pylist()
        return
    known, at, inner = column.is_valid().to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.values
    matrix = pa.types.is_list(inner.type)
    places = inner.offsets.to_numpy() if matrix else None
    flat = (inner.values if matrix else inner).to_numpy(zero_copy_only=False)
    for ok, a, b in zip(known, at, at[1:]):
        if not ok:
            yield None
        elif not matrix:
            yield flat[a:b].astype(float)
        else:
            widths = np.diff(places[a : b + 1])
            if len(widths) and (widths != widths[0]).any():
                raise ValueError("frames of one signal must have one length")
            yield flat[places[a] : places[b]].astype(float).reshape(b - a, -1) if len(widths) and widths[0] else np.empty((b - a, 0) if b > a else 0)


def apply(df: DataFrame, kernel: Callable, inputs: tuple[str, ...], shape: str, skip: bool = False, key: str = "signal_id") -> DataFrame:
    """key and the columns of shape, for the kernel's result on each row's inputs."""
    columns = SHAPES[shape]

    def run(batches):
        for b in batches:
            keys, out = [], [[] for _ in columns]
            kind = b.schema.field(0).type
            for k, *args in zip(b.column(0), *map(_inputs, b.columns[1:])):
                if any(a is None for a in args):
                    continue
                try:
                    made = _rows(shape, kernel(*args))
                except ValueError:
                    if not skip:
                        raise
                    continue
                keys.append(pa.repeat(k, len(made[0])))
                for o, m, (_, t, _) in zip(out, made, columns):
                    o.append(m if m.type == t else m.cast(t))
            join = lambda parts, t: pa.concat_arrays(parts) if parts else pa.array([], t)
            yield pa.RecordBatch.from_arrays([join(keys, kind), *(join(o, t) for o, (_, t, _) in zip(out, columns))], [key, *(n for n, _, _ in columns)])

    schema = T.StructType([df.schema[key], *(T.StructField(name, kind) for name, _, kind in columns)])
    return df.select(key, *inputs).mapInArrow(run, schema)


def apply_grouped(rows: DataFrame, kernel: Callable, values: tuple[str, ...], shape: str, order: str = "n", key: str = "signal_id") -> DataFrame:
    """key and the columns of shape, for the kernel's result on the columns values of each key's rows, in their order.

    For samples that aren't arrays yet: each key's rows come to one task as an Arrow table, so they must fit a worker. Nulls
    become NaN; a null key is a signal of its own.
    """
    columns = SHAPES[shape]

    def run(of: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        made = _rows(shape, kernel(*(table[v].combine_chunks().cast(_F).to_numpy(zero_copy_only=False) for v in values)))
        keys = pa.repeat(of[0], len(made[0])) if of[0].is_valid else pa.nulls(len(made[0]), table[key].type)
        return pa.Table.from_arrays([keys, *(m if m.type == t else m.cast(t) for m, (_, t, _) in zip(made, columns))], names=[key, *(n for n, _, _ in columns)])

    schema = T.StructType([rows.schema[key], *(T.StructField(name, kind) for name, _, kind in columns)])
    return rows.select(key, order, *values).groupBy(key).applyInArrow(run, schema)


def to_matrix(frames: DataFrame, value: str = "f", name: str = "S", key: str = "signal_id") -> DataFrame:
    """Frames as one row per signal, sorted by t."""
    rows = F.sort_array(F.collect_list(F.struct("t", value)))
    return frames.groupBy(key).agg(F.transform(rows, lambda r: r[value]).alias(name))


def to_long(frames: DataFrame, value: str = "f", name: str = "v", key: str = "signal_id") -> DataFrame:
    return frames.select(key, "t", F.posexplode(value).alias("k", name))


def _operator(kernel: Callable, shape: str, *inputs: str) -> Callable:
    def op(df: DataFrame, *, skip: bool = False, **params) -> DataFrame:
        return apply(df, lambda *args: kernel(*args, **params), inputs, shape, skip)

    op.__doc__ = f"{kernel.__doc__ or kernel.__name__}\n\nRows of shape {shape!r} from {', '.join(inputs)}; keyword parameters are the kernel's."
    op.__name__ = kernel.__name__
    return op


def _first(kernel: Callable) -> Callable:
    return lambda *a, **p: kernel(*a, **p)[0]


def _second(kernel: Callable) -> Callable:
    return lambda *a, **p: kernel(*a, **p)[1]


# transforms
stft = _operator(dsp.stft, "complex", "y")
stft_magnitude = _operator(lambda y, **p: np.abs(dsp.stft(y, **p)), "frames", "y")
istft = _operator(lambda re, im, **p: dsp.istft(re + 1j * im, **p), "signal", "re", "im")
phase_vocoder = _operator(lambda re, im, **p: dsp.phase_vocoder(re + 1j * im, **p), "complex", "re", "im")
griffinlim = _operator(dsp.griffinlim, "signal", "S")
pcen = _operator(dsp.pcen, "frames", "S")
iirt = _operator(dsp.iirt, "frames", "y")
reassigned_spectrogram = _operator(dsp.reassigned, "three_frames", "y")
fmt = _operator(lambda y, **p: dsp.fmt(y, **p)[None, :], "complex", "y")
cqt = _operator(features.cqt, "complex", "y")
cqt_magnitude = _operator(lambda y, **p: np.abs(features.cqt(y, **p)), "frames", "y")
vqt = _operator(features.vqt, "complex", "y")
vqt_magnitude = _operator(lambda y, **p: np.abs(features.vqt(y, **p)), "frames", "y")
pseudo_cqt = _operator(features.pseudo_cqt, "frames", "y")
hybrid_cqt = _operator(features.hybrid_cqt, "frames", "y")
icqt = _operator(lambda re, im, **p: features.icqt(re + 1j * im, **p), "signal", "re", "im")
griffinlim_cqt = _operator(features.griffinlim_cqt, "signal", "S")
# signals
resample = _operator(dsp.resample, "signal", "y")
autocorrelate = _operator(dsp.autocorrelate, "signal", "y")
lpc = _operator(dsp.lpc, "signal", "y")
zero_crossings = _operator(dsp.zero_crossings, "flags", "y")
clicks = _operator(dsp.clicks, "signal", "times")
clicks_frames = _operator(lambda frames, sr=banks.SR, hop_length=512, **p: dsp.clicks(frames * hop_length / sr, sr, **p), "signal", "frames")
sosfilt = _operator(lambda y, sos, **p: dsp.sosfilt(sos, y, **p)[0], "signal", "y")
sosfiltfilt = _operator(lambda y, sos: dsp.sosfiltfilt(sos, y), "signal", "y")
time_stretch = _operator(dsp.time_stretch, "signal", "y")
pitch_shift = _operator(dsp.pitch_shift, "signal", "y")
trim = _operator(lambda y, **p: [dsp.trim(y, **p)], "intervals", "y")
split = _operator(dsp.split, "intervals", "y")
deemphasis = _operator(dsp.deemphasis, "signal", "y")
remix = _operator(dsp.remix, "signal", "y", "intervals")


def _harmonic(y, part: int, kernel_size=31, power=2.0, mask=False, margin=1.0, **p):
    d = dsp.stft(y, **p)
    return dsp.istft(sequence.hpss(d, kernel_size, power, mask, margin)[part], p.get("hop_length"), n_fft=p.get("n_fft"), length=len(y))


harmonic = _operator(lambda y, **p: _harmonic(y, 0, **p), "signal", "y")
percussive = _operator(lambda y, **p: _harmonic(y, 1, **p), "signal", "y")
# features
melspectrogram = _operator(features.melspectrogram, "frames", "S")
mfcc = _operator(features.mfcc, "frames", "S")
mfcc_to_mel = _operator(features.mfcc_to_mel, "frames", "S")
mel_to_stft = _operator(features.mel_to_stft, "frames", "S")
mel_to_audio = _operator(lambda m, sr=banks.SR, n_fft=2048, power=2.0, **p: dsp.griffinlim(features.mel_to_stft(m, sr, n_fft, power), n_fft=n_fft, **p), "signal", "S")
mfcc_to_audio = _operator(lambda m, n_mels=128, sr=banks.SR, n_fft=2048, **p: dsp.griffinlim(features.mel_to_stft(features.mfcc_to_mel(m, n_mels), sr, n_fft), n_fft=n_fft, **p), "signal", "S")
chroma_stft = _operator(features.chroma_stft, "frames", "S")
chroma_cqt = _operator(features.chroma_cqt, "frames", "S")
chroma_cens = _operator(features.chroma_cens, "frames", "S")
chroma_vqt = _operator(lambda s, bins_per_octave=12, **p: features.chroma_cqt(s, n_chroma=bins_per_octave, bins_per_octave=bins_per_octave, **p), "frames", "S")
chroma_cqt_audio = _operator(features.chroma_audio, "frames", "y")
chroma_vqt_audio = _operator(lambda y, gamma=None, **p: features.chroma_audio(y, gamma=gamma, **p), "frames", "y")
chroma_cens_audio = _operator(features.chroma_cens_audio, "frames", "y")
spectral_contrast = _operator(features.spectral_contrast, "frames", "S")
spectral_contrast_audio = _operator(features.spectral_contrast_audio, "frames", "y")
poly_features = _operator(features.poly_features, "frames", "S")
tonnetz = _operator(features.tonnetz, "frames", "S")
delta = _operator(features.delta, "frames", "S")
stack_memory = _operator(features.stack_memory, "frames", "S")
interp_harmonics = _operator(features.interp_harmonics, "frames", "S")
f0_harmonics = _operator(features.f0_harmonics, "frames", "S", "f0")
salience = _operator(features.salience, "frames", "S")
sparsify_rows = _operator(features.sparsify_rows, "frames", "S")
# pitch
yin = _operator(features.yin, "series", "y")
pyin = _operator(features.pyin, "pitch", "y")
piptrack = _operator(features.piptrack, "two_frames", "S")
pitch_tuning = _operator(features.pitch_tuning, "value", "y")
estimate_tuning = _operator(features.estimate_tuning, "value", "S")
estimate_tuning_audio = _operator(features.estimate_tuning_audio, "value", "y")
# rhythm
onset_strength = _operator(rhythm.onset_strength, "series", "S")
onset_strength_multi = _operator(rhythm.onset_strength_multi, "frames", "S")
onset_envelope = _operator(rhythm.onset_envelope, "series", "y")
onset_detect_envelope = _operator(rhythm.onset_detect, "events", "y")
onset_detect = _operator(lambda y, sr=banks.SR, hop_length=512, n_fft=2048, n_mels=128, **p: rhythm.onset_detect(rhythm.onset_envelope(y, sr, n_fft, hop_length, n_mels), sr, hop_length, **p), "events", "y")
onset_backtrack = _operator(rhythm.onset_backtrack, "events", "events", "y")
peak_pick = _operator(rhythm.peak_pick, "events", "y")
maximum_filter1d = _operator(rhythm.maximum_filter1d, "frames", "S")
match_events = _operator(rhythm.match_events, "events", "source", "target")
match_intervals = _operator(rhythm.match_intervals, "events", "source", "target")
tempogram = _operator(rhythm.tempogram, "frames", "y")
fourier_tempogram = _operator(rhythm.fourier_tempogram, "complex", "y")
tempogram_ratio = _operator(rhythm.tempogram_ratio, "frames", "S")
tempo = _operator(rhythm.tempo, "value", "y")
tempo_frames = _operator(rhythm.tempo_frames, "series", "y")
beat_track = _operator(rhythm.beat_track, "beats", "y")
plp = _operator(rhythm.plp, "series", "y")


def _from_audio(kernel: Callable, shape: str, aggregate: str = "mean") -> Callable:
    def run(y, sr=banks.SR, hop_length=512, n_fft=2048, n_mels=128, **p):
        env = rhythm.onset_envelope(y, sr, n_fft, hop_length, n_mels, aggregate=aggregate)
        return kernel(env, sr, hop_length, p)

    return _operator(run, shape, "y")


tempogram_audio = _from_audio(lambda env, sr, hop, p: rhythm.tempogram(env, **p), "frames")
fourier_tempogram_audio = _from_audio(lambda env, sr, hop, p: rhythm.fourier_tempogram(env, **p), "complex")
tempo_audio = _from_audio(lambda env, sr, hop, p: rhythm.tempo(env, sr, hop, **p), "value")
beat_track_audio = _from_audio(lambda env, sr, hop, p: rhythm.beat_track(env, sr, hop, **p), "beats", "median")
plp_audio = _from_audio(lambda env, sr, hop, p: rhythm.plp(env, sr, hop, **p), "series")
# decomposition
median_filter_2d = _operator(sequence.median_filter_2d, "frames", "S")
hpss = _operator(sequence.hpss, "two_frames", "S")
hpss_complex = _operator(lambda re, im, **p: sequence.hpss(re + 1j * im, **p), "two_complex", "re", "im")
decompose_nmf = _operator(lambda s, **p: (lambda w, h: (w.T, h))(*sequence.nmf(s, **p)), "two_frames", "S")
nn_filter_median = _operator(compositions.nn_filter_median, "frames", "S")
robust_beat_frames = _operator(lambda beats, last: compositions.robust_beat_frames(beats, int(last)), "events", "beats", "last")
nn_filter = _operator(sequence.nn_filter, "frames", "S", "rec")
nnls = _operator(features.nnls, "frames", "A", "B")
# similarity and segmentation
cross_similarity = _operator(sequence.cross_similarity, "frames", "S", "R")
cross_similarity_sparse = _operator(sequence.cross_similarity, "edges", "S", "R")
recurrence_matrix = _operator(sequence.recurrence_matrix, "frames", "S")
recurrence_matrix_sparse = _operator(sequence.recurrence_matrix, "edges", "S")
recurrence_to_lag = _operator(sequence.recurrence_to_lag, "frames", "S")
lag_to_recurrence = _operator(sequence.lag_to_recurrence, "frames", "S")
timelag_filter = _operator(lambda s, fn, pad=True: sequence.lag_to_recurrence(fn(sequence.recurrence_to_lag(s, pad))), "frames", "S")
timelag_median_filter = _operator(lambda s, size=(1, 3), pad=True: sequence.lag_to_recurrence(sequence.median_filter_2d(sequence.recurrence_to_lag(s, pad), size)), "frames", "S")
path_enhance = _operator(sequence.path_enhance, "frames", "S")
agglomerative = _operator(sequence.agglomerative, "events", "S")
subsegment = _operator(sequence.subsegment, "events", "S", "frames")
laplacian_components = _operator(sequence.laplacian_components, "frames", "S")
# sequences
viterbi = _operator(_first(sequence.viterbi), "events", "prob")
viterbi_with_logp = _operator(_second(sequence.viterbi), "value", "prob")
viterbi_discriminative = _operator(sequence.viterbi_discriminative, "events", "prob")
viterbi_binary = _operator(_first(sequence.viterbi_binary), "frames", "prob")
viterbi_binary_with_logp = _operator(_second(sequence.viterbi_binary), "series", "prob")
rqa = _operator(_first(sequence.rqa), "frames", "S")
rqa_backtrack = _operator(_second(sequence.rqa), "path", "S")
cdist_euclidean = _operator(sequence.cdist, "frames", "S", "R")
cdist_cosine = _operator(lambda s, r: sequence.cdist(s, r, "cosine"), "frames", "S", "R")
dtw = _operator(_first(sequence.dtw), "frames", "S", "R")
dtw_steps = _operator(_second(sequence.dtw), "frames", "S", "R")
dtw_backtrack = _operator(_second(sequence.dtw_backtrack), "path", "S", "R")
dtw_backtracking = _operator(sequence.dtw_backtracking, "path", "steps")
# utilities
normalize = _operator(features.normalize, "frames", "S")
sync = _operator(rhythm.sync, "frames", "S", "idx")
axis_sort = _operator(_first(rhythm.axis_sort), "frames", "S")
axis_sort_with_index = _operator(_second(rhythm.axis_sort), "events", "S")
cyclic_gradient = _operator(rhythm.cyclic_gradient, "signal", "y")
fill_off_diagonal = _operator(sequence.fill_off_diagonal, "frames", "S")
shear = _operator(sequence.shear, "frames", "S")
fix_frames = _operator(sequence.fix_frames, "events", "frames")

"""Signals of any length: rows are chunks of a signal, so that one signal is the work of many tasks.

Chunked signals are (signal_id, chunk, y) with `size` samples in each chunk but the last. What a kernel needs from its
neighbours comes as a halo: neighbours send slices of their samples, keyed by signal and chunk. Short-time frames belong to
the chunk that holds their first sample; in the inverse each frame goes to the chunks that it reaches. Recursive filters
run on every chunk from nothing, the states that chunks leave are combined in a tree of bounded groups, and a second pass
starts each chunk from its true state. No task sees more than a chunk with its halo, or FAN states.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetide.kernels import dsp, recursion
from wavetide.plans.banks import SR, TINY, _centred, get_window

from .signals import KEY

#: Samples of a chunk, chunks whose states one task puts together, and frames that leave a kernel at once.
CHUNK, FAN, FRAMES = 1 << 18, 512, 256
_DOUBLES = pa.list_(pa.float64())


def chunked(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """(signal_id, chunk, y) of samples (signal_id, n, v), n being 0, 1, ... in each signal."""
    own = F.sort_array(F.collect_list(F.struct("n", "v")))
    chunk = F.floor(F.col("n") / size).cast("long").alias("chunk")
    return samples.groupBy(KEY, chunk).agg(F.transform(own, lambda p: p["v"].cast("double")).alias("y"))


def samples_of(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(signal_id, n, v) of a chunked signal."""
    at = chunks.select(KEY, "chunk", F.posexplode("y").alias("k", "v"))
    return at.select(KEY, (F.col("chunk") * size + F.col("k")).alias("n"), "v")


def with_halo(chunks: DataFrame, left: int, right: int, size: int = CHUNK) -> DataFrame:
    """(signal_id, chunk, y, before, own): chunks with up to left samples before and right samples behind their own ones.

    before and own count samples; fewer than asked for are there only where the signal begins or ends. One exchange; a chunk
    sends no more than the halo's slices to its neighbours.
    """
    piece = lambda step, y: F.struct((F.col("chunk") + step).alias("chunk"), F.col("chunk").alias("of"), y.alias("y"))
    pieces = [piece(0, F.col("y"))]
    for j in range(1, -(-right // size) + 1):
        pieces.append(piece(-j, F.slice("y", 1, min(size, right - (j - 1) * size))))
    for j in range(1, -(-left // size) + 1):
        pieces.append(piece(j, F.slice("y", max(0, size - (left - (j - 1) * size)) + 1, size)))
    sent = chunks.select(KEY, F.explode(F.array(*pieces)).alias("p")).where("p.chunk >= 0")
    near = sent.groupBy(KEY, F.col("p.chunk").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("p.of", "p.y"))).alias("parts"))
    count = lambda keep: F.aggregate("parts", F.lit(0), lambda n, p: n + F.when(keep(p), F.size(p["y"])).otherwise(0))
    return near.where(F.exists("parts", lambda p: p["of"] == F.col("chunk"))).select(
        KEY,
        "chunk",
        F.flatten(F.transform("parts", lambda p: p["y"])).alias("y"),
        count(lambda p: p["of"] < F.col("chunk")).alias("before"),
        count(lambda p: p["of"] == F.col("chunk")).alias("own"),
    )


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(column.offsets.to_numpy(), column.offsets.to_numpy()[1:])]


def _matrix(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _key(chunks: DataFrame) -> str:
    return f"{KEY} {chunks.schema[KEY].dataType.simpleString()}"


def framewise(chunks: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], frame_length: int, hop_length: int, center: bool = True, pad_mode: str = "constant", size: int = CHUNK) -> DataFrame:
    """(signal_id, t, re, im): kernel, of frames (n, frame_length) to a matrix of n rows, on each frame of a chunked signal.

    Frames are those of the whole padded signal; a signal shorter than a frame has none. im is null for real results.
    """
    if frame_length < 1 or hop_length < 1:
        raise ValueError("frame_length and hop_length must be positive")
    pad = frame_length // 2 if center else 0
    right = frame_length + 1

    def frames(chunk: int, y: np.ndarray, before: int, own: int):
        """The first number and the frames that begin in a chunk."""
        first = chunk * size - before
        last = before + own == len(y)
        if len(y) < before + own + right:  # the signal's end is known
            y = dsp.pad_signal(y, 0, pad, pad_mode)
        if first == 0:
            y, first = dsp.pad_signal(y, pad, 0, pad_mode), -pad
        begin = 0 if chunk == 0 else -(-(chunk * size + pad) // hop_length)
        end = -(-((chunk + 1) * size + pad) // hop_length)
        fits = (first + len(y) - frame_length + pad) // hop_length + 1
        end = fits if last else min(end, fits)
        if end <= begin:
            return begin, np.empty((0, frame_length))
        y = y[begin * hop_length - pad - first :]
        return begin, np.lib.stride_tricks.sliding_window_view(y, frame_length)[::hop_length][: end - begin]

    def run(batches):
        for b in batches:
            for key, chunk, y, before, own in zip(b.column(0), b.column(1).to_pylist(), _arrays(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                begin, x = frames(chunk, y, before, own)
                for lo in range(0, len(x), FRAMES):
                    out = kernel(x[lo : lo + FRAMES])
                    im = _matrix(out.imag) if np.iscomplexobj(out) else pa.nulls(len(out), _DOUBLES)
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, len(out)), pa.array(np.arange(begin + lo, begin + lo + len(out))), _matrix(out.real), im], [KEY, "t", "re", "im"])

    halo = with_halo(chunks, frame_length if pad_mode == "reflect" and center else 0, right, size)
    return halo.mapInArrow(run, f"{_key(chunks)}, t long, re array<double>, im array<double>")


def frame(chunks: DataFrame, frame_length: int, hop_length: int, size: int = CHUNK) -> DataFrame:
    """(signal_id, t, f): windows of a chunked signal."""
    return framewise(chunks, lambda x: x, frame_length, hop_length, False, size=size).select(KEY, "t", F.col("re").alias("f"))


def stft(chunks: DataFrame, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window="hann", center: bool = True, pad_mode: str = "constant", size: int = CHUNK) -> DataFrame:
    """(signal_id, t, re, im) of a chunked signal, the numbers of the transform of the whole signal."""
    win_length = win_length or n_fft
    w = _centred(get_window(window, win_length), n_fft)
    return framewise(chunks, lambda x: np.fft.rfft(x * w, axis=1), n_fft, hop_length or max(1, win_length // 4), center, pad_mode, size)


def istft(frames: DataFrame, n_fft: int, hop_length: int | None = None, win_length: int | None = None, window="hann", center: bool = True, size: int = CHUNK) -> DataFrame:
    """(signal_id, chunk, y) from frames (signal_id, t, re, im), t being 0, 1, ... in each signal.

    Each frame is sent to the chunks that it or the frame before it reaches; there frames are added in order of t, as for a
    whole signal.
    """
    win_length = win_length or n_fft
    hop = hop_length or max(1, win_length // 4)
    pad = n_fft // 2 if center else 0
    w = _centred(get_window(window, win_length), n_fft)
    first = F.greatest(F.lit(0), F.floor((F.col("t") * hop - pad - hop) / size)).cast("long")
    last = F.floor((F.col("t") * hop - pad + n_fft - 1) / size).cast("long")
    sent = frames.select(KEY, F.explode(F.when(last >= first, F.sequence(first, last))).alias("chunk"), F.struct("t", "re", "im").alias("x"))
    sent = sent.groupBy(KEY, "chunk").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def run(batches):
        for b in batches:
            x = b.column(2)
            for k, (key, chunk) in enumerate(zip(b.column(0), b.column(1).to_pylist())):
                t, re, im = (x[k].values.field(f) for f in ("t", "re", "im"))
                t = t.to_numpy()
                d = np.stack(_arrays(re)) + 1j * np.stack(_arrays(im))
                y = np.zeros(n_fft + hop * int(t[-1] - t[0]))
                power = np.zeros_like(y)
                for at, part in zip((t - t[0]) * hop, np.fft.irfft(d, n_fft, axis=1) * w):
                    y[at : at + n_fft] += part
                    power[at : at + n_fft] += w * w
                y = np.where(power > TINY, y / np.where(power > TINY, power, 1.0), y)
                begin = int(t[0]) * hop - pad  # of y, in samples of the signal
                end = min((chunk + 1) * size, begin + len(y) - pad)
                if begin > chunk * size:  # frames with gaps between them
                    y, begin = np.concatenate([np.zeros(begin - chunk * size), y]), chunk * size
                y = y[chunk * size - begin : max(end - begin, 0)]
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, 1), pa.array([chunk], pa.int64()), _matrix(y[None])], [KEY, "chunk", "y"])

    return sent.mapInArrow(run, f"{_key(frames)}, chunk long, y array<double>")


# recursions


def chunk_states(left: DataFrame, a: np.ndarray, initial: np.ndarray, fan: int = FAN) -> DataFrame:
    """(signal_id, chunk, state): the state in which each chunk begins.

    left: (signal_id, chunk, n, state), the samples of a chunk and the state that it leaves from nothing. Groups of fan
    chunks become one chunk of the next level, until a signal is one; then states go down again.
    """
    most = left.agg(F.max("chunk")).first()[0] or 0
    kind = left.schema[KEY].dataType.simpleString()
    grouped = []

    def group(rows: DataFrame) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("chunk", "n", "state"))).alias("parts")
        return rows.groupBy(KEY, F.floor(F.col("chunk") / fan).cast("long").alias("chunk")).agg(parts)

    def parts(x: pa.Array):
        v = x.values
        return v.field("chunk").to_pylist(), v.field("n").to_pylist(), _arrays(v.field("state"))

    def up(batches):
        for b in batches:
            for k, (key, chunk) in enumerate(zip(b.column(0), b.column(1))):
                _, n, gains = parts(b.column(2)[k])
                _, total, own = recursion.through(a, n, gains, np.zeros(len(gains[0])))
                yield pa.RecordBatch.from_arrays([pa.repeat(key, 1), pa.repeat(chunk, 1), pa.array([total], pa.int64()), _matrix(own[None])], [KEY, "chunk", "n", "state"])

    def down(batches):
        for b in batches:
            for k, (key, start) in enumerate(zip(b.column(0), _arrays(b.column(2)))):
                chunks, n, gains = parts(b.column(1)[k])
                before, _, _ = recursion.through(a, n, gains, start if len(start) else np.resize(initial, len(gains[0])))
                yield pa.RecordBatch.from_arrays([pa.repeat(key, len(chunks)), pa.array(chunks, pa.int64()), _matrix(np.stack(before))], [KEY, "chunk", "state"])

    rows = left
    while True:
        grouped.append(group(rows))
        most //= fan
        if not most:
            break
        rows = grouped[-1].mapInArrow(up, f"{KEY} {kind}, chunk long, n long, state array<double>")
    states = None
    for level in reversed(grouped):
        start = F.array().cast("array<double>").alias("state")
        level = level.select(KEY, "parts", start) if states is None else level.join(states, [KEY, "chunk"]).select(KEY, "parts", "state")
        states = level.mapInArrow(down, f"{KEY} {kind}, chunk long, state array<double>")
    return states


def _recurrent(chunks: DataFrame, step: Callable, a: np.ndarray, initial: np.ndarray, value: str, to_rows: Callable, shape: str) -> DataFrame:
    """(signal_id, chunk, value): step(x, state) on each chunk, from the state that the chunks before it leave.

    initial: the signal's first state, repeated for each channel; shape: the Spark type of value.
    """
    kind = _key(chunks)
    width = len(initial)

    def leave(batches):
        for b in batches:
            for key, chunk, x in zip(b.column(0), b.column(1), to_rows(b.column(2))):
                channels = x.shape[1] if x.ndim > 1 else 1
                _, end = step(x, np.zeros(width * channels))
                yield pa.RecordBatch.from_arrays([pa.repeat(key, 1), pa.repeat(chunk, 1), pa.array([len(x)], pa.int64()), _matrix(end.reshape(1, -1))], [KEY, "chunk", "n", "state"])

    def go(batches):
        for b in batches:
            for key, chunk, x, state in zip(b.column(0), b.column(1), to_rows(b.column(2)), _arrays(b.column(3))):
                y, _ = step(x, state)
                out = _matrix(y[None]) if y.ndim == 1 else pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), _matrix(y))
                yield pa.RecordBatch.from_arrays([pa.repeat(key, 1), pa.repeat(chunk, 1), out], [KEY, "chunk", value])

    rows = chunks.select(KEY, "chunk", value)
    left = rows.mapInArrow(leave, f"{kind}, chunk long, n long, state array<double>")
    return rows.join(chunk_states(left, a, initial), [KEY, "chunk"]).mapInArrow(go, f"{kind}, chunk long, {value} {shape}")


def sosfilt(chunks: DataFrame, sos) -> DataFrame:
    """A chunked signal through second-order sections, from rest."""

    def step(x, state):
        y, end = dsp.sosfilt(sos, x, state.reshape(-1, 2))
        return y, end.ravel()

    m = 2 * len(sos)
    return _recurrent(chunks, step, recursion.transition(step, m), np.zeros(m), "y", _arrays, "array<double>")


def deemphasis(chunks: DataFrame, coef: float = 0.97) -> DataFrame:
    """The recursive inverse of preemphasis on a chunked signal."""

    def step(x, state):
        return recursion.state_filter([[coef]], [coef], [1.0], 1.0, x, state)

    return _recurrent(chunks, step, np.array([[coef]]), np.zeros(1), "y", _arrays, "array<double>")


def preemphasis(chunks: DataFrame, coef: float = 0.97, size: int = CHUNK) -> DataFrame:
    """y[n] - coef y[n - 1] on a chunked signal; the first sample stays."""
    pairs = F.zip_with(F.slice("y", F.col("before") + 1, F.col("own")), F.when(F.col("before") > 0, F.slice("y", F.col("before"), F.col("own"))).otherwise(F.concat(F.array(F.lit(0.0)), F.slice("y", F.lit(1), F.greatest(F.col("own") - 1, F.lit(0))))), lambda a, b: a - coef * b)
    return with_halo(chunks, 1, 0, size).select(KEY, "chunk", pairs.alias("y"))


def chunked_frames(frames: DataFrame, value: str | Column = "f", size: int = 4096) -> DataFrame:
    """(signal_id, chunk, f): frames (signal_id, t, value), size of them in a chunk."""
    own = F.sort_array(F.collect_list(F.struct(F.col("t"), (F.col(value) if isinstance(value, str) else value).alias("f"))))
    return frames.groupBy(KEY, F.floor(F.col("t") / size).cast("long").alias("chunk")).agg(F.transform(own, lambda p: p["f"]).alias("f"))


def pcen(frames: DataFrame, size: int = 4096, sr: float = SR, hop_length: int = 512, time_constant: float = 0.4, **params) -> DataFrame:
    """(signal_id, t, f): per-channel energy normalization of frames (signal_id, t, f); the smoother starts at one."""
    t = time_constant * sr / hop_length
    keep = 1 - (np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)

    def step(x, state):
        return dsp.pcen_steps(x, state, sr, hop_length, time_constant=time_constant, **params)

    def matrices(column: pa.Array) -> list[np.ndarray]:
        flat = column.values
        return [np.stack(_arrays(flat.slice(a, b - a))) for a, b in zip(column.offsets.to_pylist(), column.offsets.to_pylist()[1:])]

    done = _recurrent(chunked_frames(frames, size=size), step, np.array([[keep]]), np.ones(1), "f", matrices, "array<array<double>>")
    rows = done.select(KEY, "chunk", F.posexplode("f").alias("k", "f"))
    return rows.select(KEY, (F.col("chunk") * size + F.col("k")).alias("t"), "f")

"""Frame-local operators on streams: windows with a watermark, and framing and filters with kept state.

A stream has columns signal_id, n (place in its signal) and v. State per signal: the samples that later frames still
need, or a filter's memory. Samples of a micro-batch are taken in order of n; samples below those already used are late
and dropped. Filters can wait for samples that come out of order: up to ``ahead`` of a signal are held until those in
front of them arrive, and a longer gap is given up. Centred frames would need samples ahead, so there are none here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum of values by window and type, once the watermark has passed."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def stream_frames(samples: DataFrame, frame_length: int, hop_length: int) -> DataFrame:
    """(signal_id, t, f): the same frames as the batch operator without centring."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, held = state.get if state.exists else (0, [])
        x = pd.concat(list(batches)).sort_values("n")
        x = x[x["n"] >= start + len(held)]
        held = list(held) + x["v"].tolist()
        ts, fs = [], []
        while len(held) >= frame_length:
            ts.append(start // hop_length)
            fs.append(held[:frame_length])
            held, start = held[hop_length:], start + hop_length
        state.update((int(start), [float(v) for v in held]))
        yield pd.DataFrame({"signal_id": [key[0]] * len(ts), "t": ts, "f": fs})

    return samples.groupBy("signal_id").applyInPandasWithState(step, "signal_id long, t long, f array<double>", "start long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def _filtered(samples: DataFrame, step: Callable[[np.ndarray, list[float]], tuple[np.ndarray, list[float]]], memory: list[float], ahead: int) -> DataFrame:
    """(signal_id, n, v) of a filter that takes samples in order and its memory, and gives values and the next memory."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held, places, values = state.get if state.exists else (-1, memory, [], [])
        x = pd.concat(list(batches)).drop_duplicates("n")
        seen = dict(zip(places, values))
        seen.update((int(n), float(v)) for n, v in zip(x["n"], x["v"]) if n > last)
        order, taken = sorted(seen), []
        for k, n in enumerate(order):
            if n == last + 1 or len(order) - k > ahead:  # too many wait behind the gap
                taken.append(n)
                last = n
        y, held = step(np.array([seen.pop(n) for n in taken]), list(held))
        rest = sorted(seen)
        state.update((last, [float(v) for v in held], rest, [seen[n] for n in rest]))
        yield pd.DataFrame({"signal_id": [key[0]] * len(taken), "n": taken, "v": y})

    kept = "last long, held array<double>, places array<long>, waiting array<double>"
    return samples.groupBy("signal_id").applyInPandasWithState(run, "signal_id long, n long, v double", kept, "append", GroupStateTimeout.NoTimeout)


def stream_preemphasis(samples: DataFrame, coef: float = 0.97, ahead: int = 0) -> DataFrame:
    """(signal_id, n, v), with the last sample as state."""

    def step(x: np.ndarray, held: list[float]) -> tuple[np.ndarray, list[float]]:
        return (x - coef * np.concatenate([held, x[:-1]]), [x[-1]]) if len(x) else (x, held)

    return _filtered(samples, step, [0.0], ahead)


def stream_deemphasis(samples: DataFrame, coef: float = 0.97, ahead: int = 0) -> DataFrame:
    """(signal_id, n, v), with the last output as state."""
    return stream_sosfilt(samples, [[1.0, 0.0, 0.0, 1.0, -coef, 0.0]], ahead)


def stream_sosfilt(samples: DataFrame, sos: list[list[float]], ahead: int = 0) -> DataFrame:
    """(signal_id, n, v): second-order sections with their memory as state."""
    from wavetide.kernels.dsp import sosfilt

    def step(x: np.ndarray, held: list[float]) -> tuple[np.ndarray, list[float]]:
        y, z = sosfilt(sos, x, np.array(held).reshape(-1, 2))
        return y, z.ravel().tolist()

    return _filtered(samples, step, [0.0] * (2 * len(sos)), ahead)


def stream_pcen(frames: DataFrame, **params) -> DataFrame:
    """(signal_id, t, f) of frames (signal_id, t, f) in order, with each bin's smoothed energy as state."""
    from wavetide.kernels.dsp import pcen_steps

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, smooth = state.get if state.exists else (-1, [])
        x = pd.concat(list(batches)).drop_duplicates("t").sort_values("t")
        x = x[x["t"] > last]
        if len(x):
            y, smooth = pcen_steps(np.array(x["f"].tolist(), float), np.array(smooth) if len(smooth) else None, **params)
            state.update((int(x["t"].iloc[-1]), smooth.tolist()))
            yield pd.DataFrame({"signal_id": [key[0]] * len(x), "t": x["t"].astype("int64").tolist(), "f": y.tolist()})

    return frames.groupBy("signal_id").applyInPandasWithState(run, "signal_id long, t long, f array<double>", "last long, smooth array<double>", "append", GroupStateTimeout.NoTimeout)

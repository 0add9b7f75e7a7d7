"""Functions for SQL: scalar ones over arrays, and a table function that cuts a signal into frames.

``register(spark)`` makes them known; a kernel of one's own runs over signals with ``wavetide.operators.kernels.apply``,
which takes any function of arrays and one of its SHAPES.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetide.kernels import dsp

_SIGNAL = T.ArrayType(T.DoubleType())


def _on_signals(kernel):
    """The kernel as a function of an array column; null for a null or for a signal it refuses."""

    def each(y):
        try:
            return None if y is None else np.asarray(kernel(np.asarray(y, float)), float).tolist()
        except ValueError:
            return None

    def run(y: pd.Series) -> pd.Series:
        return y.map(each)

    return F.pandas_udf(run, _SIGNAL)


@F.udtf(returnType="t bigint, f array<double>")
class FrameSignal:
    """Frames of one signal, as rows: t and f. For lateral joins, which Arrow table functions can't serve."""

    def eval(self, y: list[float], frame_length: int, hop_length: int):
        for t in range(0 if y is None or len(y) < frame_length else (len(y) - frame_length) // hop_length + 1):
            yield t, [float(v) for v in y[t * hop_length : t * hop_length + frame_length]]


@F.arrow_udtf(returnType="signal_id bigint, t bigint, f array<double>")
class FrameTable:
    """Frames of a table of signals (signal_id, y): samples stay in Arrow buffers and never become Python numbers."""

    def eval(self, signals: pa.RecordBatch, frame_length: pa.Array, hop_length: pa.Array):
        if not signals.num_rows:
            return
        n, hop = frame_length[0].as_py(), hop_length[0].as_py()
        for key, y in zip(signals.column("signal_id"), signals.column("y")):
            if not y.is_valid or len(y.values) < n:
                continue
            frames = dsp.frame(y.values.to_numpy(zero_copy_only=False).astype(float), n, hop)
            for lo in range(0, len(frames), 4096):
                part = np.ascontiguousarray(frames[lo : lo + 4096])
                f = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.repeat(key.cast(pa.int64()), len(part)), pa.array(np.arange(lo, lo + len(part))), f], ["signal_id", "t", "f"])


def register(spark: SparkSession) -> None:
    """wt_frames(y, frame_length, hop_length) and wt_frame_table(TABLE(signals), frame_length, hop_length) as tables; wt_preemphasis, wt_deemphasis, wt_autocorrelate, wt_zero_crossings
    and wt_rms of a signal."""
    spark.udtf.register("wt_frames", FrameSignal)
    spark.udtf.register("wt_frame_table", FrameTable)
    for kernel in (dsp.preemphasis, dsp.deemphasis, dsp.autocorrelate, dsp.zero_crossings):
        spark.udf.register(f"wt_{kernel.__name__}", _on_signals(kernel))

    def rms(y: pd.Series) -> pd.Series:
        return y.map(lambda x: None if x is None or not len(x) else float(np.sqrt(np.mean(np.square(x)))))

    spark.udf.register("wt_rms", F.pandas_udf(rms, "double"))

"""Filters on streams with event time: gaps are given up by time, and idle signals leave the state.

A stream has columns signal_id, n (place in its signal, from 0), v and ts, with a watermark on ts. A sample behind a gap is
held; a timer goes off ``wait`` behind the earliest held sample's time, and when the watermark has passed it the gap is
closed and what was held is filtered in order. Another timer drops the state of a signal that has been silent for ``idle``;
if it speaks again it begins anew. State lives in the RocksDB provider, so it may be larger than the executors' memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wavetide.kernels.dsp import sosfilt

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this provider; to be set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class GapFilter(StatefulProcessor):
    """step(samples, memory) -> (values, memory), on samples in order of n; times are in milliseconds."""

    def __init__(self, step: Callable[[np.ndarray, list[float]], tuple[np.ndarray, list[float]]], memory: list[float], wait: int, idle: int):
        self.step, self.memory, self.wait, self.idle = step, memory, wait, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "last long, seen long, held array<double>")
        self.waiting = handle.getMapState("waiting", "n long", "v double, ts long")

    def _state(self) -> tuple[int, int, list[float]]:
        return self.at.get() if self.at.exists() else (-1, -1, self.memory)

    def _go(self, key, ready: list[tuple[int, float]], last: int, seen: int, held: list[float]) -> Iterator[pd.DataFrame]:
        """Filters samples, keeps the state and sets the one timer that comes first."""
        y, held = self.step(np.array([v for _, v in ready], float), list(held))
        self.at.update((ready[-1][0] if ready else last, seen, [float(v) for v in held]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        first = [int(v[1]) + self.wait for _, v in self.waiting.iterator()]
        self.handle.registerTimer(min([seen + self.idle, *first]))
        if ready:
            yield pd.DataFrame({"signal_id": [key[0]] * len(ready), "n": [n for n, _ in ready], "v": y})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, seen, held = self._state()
        x = pd.concat(list(rows)).drop_duplicates("n").sort_values("n")
        times = x["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64)
        ready, end = [], last
        fresh = {int(n): (float(v), int(t)) for n, v, t in zip(x["n"], x["v"], times) if n > last}
        while end + 1 in fresh or self.waiting.containsKey((end + 1,)):
            end += 1
            if end in fresh:
                ready.append((end, fresh.pop(end)[0]))
            else:
                ready.append((end, float(self.waiting.getValue((end,))[0])))
                self.waiting.removeKey((end,))
        for n, (v, t) in fresh.items():
            self.waiting.updateValue((n,), (v, t))
        yield from self._go(key, ready, last, max(seen, int(times.max())), held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, seen, held = self._state()
        now = expiredTimerInfo.getExpiryTimeInMs()
        behind = sorted((int(n[0]), float(v[0]), int(v[1])) for n, v in self.waiting.iterator())
        due = [k for k, (_, _, t) in enumerate(behind) if t + self.wait <= now]
        ready = []
        if due:  # the gaps in front of all that have waited long enough, and what follows them without a gap
            end = due[-1] + 1
            while end < len(behind) and behind[end][0] == behind[end - 1][0] + 1:
                end += 1
            ready = [(n, v) for n, v, _ in behind[:end]]
            for n, _ in ready:
                self.waiting.removeKey((n,))
        if seen + self.idle <= now and len(ready) == len(behind):
            y, _ = self.step(np.array([v for _, v in ready], float), list(held))
            self.at.clear()
            if ready:
                yield pd.DataFrame({"signal_id": [key[0]] * len(ready), "n": [n for n, _ in ready], "v": y})
        else:
            yield from self._go(key, ready, last, seen, held)

    def close(self) -> None:
        pass


def timed_sosfilt(samples: DataFrame, sos: list[list[float]], wait_ms: int = 10_000, idle_ms: int = 600_000, late: str = "10 seconds") -> DataFrame:
    """(signal_id, n, v) of a stream (signal_id, n, v, ts) through second-order sections."""

    def step(x: np.ndarray, held: list[float]) -> tuple[np.ndarray, list[float]]:
        y, z = sosfilt(sos, x, np.array(held).reshape(-1, 2))
        return y, z.ravel().tolist()

    kind = samples.schema["signal_id"].dataType.simpleString()
    x = samples.select("signal_id", F.col("n").cast("long").alias("n"), F.col("v").cast("double").alias("v"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    filt = GapFilter(step, [0.0] * (2 * len(sos)), wait_ms, idle_ms)
    return x.groupBy("signal_id").transformWithStateInPandas(statefulProcessor=filt, outputStructType=f"signal_id {kind}, n long, v double", outputMode="Append", timeMode="EventTime")


def timed_deemphasis(samples: DataFrame, coef: float = 0.97, **times) -> DataFrame:
    return timed_sosfilt(samples, [[1.0, 0.0, 0.0, 1.0, -coef, 0.0]], **times)

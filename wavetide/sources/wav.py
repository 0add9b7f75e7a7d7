"""WAV files as rows, and signals as WAV files. Files are read and written by Spark, so any store it knows will do."""

from __future__ import annotations

import io
import tempfile
import uuid
import wave

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetide.kernels.dsp import buf_to_float, resample


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder that spark.checkpoint.dir names; below a local one only where that is unset and
    Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='wavetide-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/wav-{uuid.uuid4().hex}"


def decode(raw: bytes, samples: bool = True, mono: bool = True, offset: float = 0.0, duration: float | None = None, sr: float | None = None):
    """(rate, channels, frames, signal or None) of a WAV file's bytes."""
    with wave.open(io.BytesIO(raw)) as w:
        rate, channels, n, width = w.getframerate(), w.getnchannels(), w.getnframes(), w.getsampwidth()
        if not samples:
            return rate, channels, n, None
        first = int(offset * rate)
        if first > n:
            raise ValueError("offset lies behind the end of the file")
        w.setpos(first)
        y = buf_to_float(w.readframes(n - first if duration is None else min(n - first, int(duration * rate))), width)
    y = y.reshape(-1, channels)
    y = y.mean(axis=1) if mono else y[:, 0]
    return rate, channels, n, resample(y, rate, sr) if sr else y


def encode(y: np.ndarray, sr: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(sr))
        w.writeframes(_pcm(y))
    return out.getvalue()


def _pcm(y) -> bytes:
    return np.clip(np.rint(np.asarray(y, float) * 32768), -32768, 32767).astype("<i2").tobytes()


def read_wav(spark: SparkSession, path: str, samples: bool = True, **options) -> DataFrame:
    """path, name, sr, channels, n, duration and, with samples, y, for the files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav*").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            rows = []
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rate, channels, n, y = decode(raw, samples, **options)
                rows.append((p, p.rsplit("/", 1)[-1], float(rate), channels, n, n / rate, None if y is None else y.tolist()))
            types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], ["path", "name", "sr", "channels", "n", "duration", "y"])

    out = files.mapInArrow(run, "path string, name string, sr double, channels long, n long, duration double, y array<double>")
    return out if samples else out.drop("y")


def _known(uri: str) -> bool:
    """Whether pyarrow knows the store that uri names."""
    try:
        FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return False
    return True


def write_wav(wide: DataFrame, path: str, sr: int, key: str = "signal_id") -> None:
    """One 16-bit file for each row, named by the key. Tasks write the files themselves; only for stores that pyarrow
    doesn't know do the bytes pass through the driver, one file at a time, to Spark's own file system."""
    spark = wide.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    uri = folder.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri()
    # Hadoop writes file:/x, pyarrow wants file:///x
    uri = f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getRawPath()}"

    def pack(batches):
        for b in batches:
            raws = [encode(np.array(y or [], float), sr) for y in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(raws, pa.binary())], ["name", "raw"])

    def write(batches):
        store, base = FileSystem.from_uri(uri)
        for b in batches:
            names = b.column(0).to_pylist()
            for name, y in zip(names, b.column(1).to_pylist()):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"  # a task that fails or runs twice leaves no half file
                with store.open_output_stream(part) as out:
                    out.write(encode(np.array(y or [], float), sr))
                store.move(part, f"{base}/{name}.wav")
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["files"])

    rows = wide.select(F.col(key).cast("string").alias(key), "y")
    if _known(uri):
        rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
        return
    for r in rows.mapInArrow(pack, "name string, raw binary").toLocalIterator(prefetchPartitions=False):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{r['name']}.wav"), True)
        out.write(r["raw"])
        out.close()


def signal_to_pcm(wide: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_pcm(y or []) for y in b.column(1).to_pylist()], pa.binary())], ["signal_id", "raw"])

    return wide.select("signal_id", "y").mapInArrow(run, "signal_id long, raw binary")


def pcm_to_signal(rows: DataFrame, n_bytes: int = 2) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([buf_to_float(x, n_bytes).tolist() for x in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["signal_id", "y"])

    return rows.select("signal_id", "raw").mapInArrow(run, "signal_id long, y array<double>")

"""WAV files as a data source: ``spark.dataSource.register(WavSource)``, then ``spark.read.format("wav").load(path)``.

Reading: a file is split by ranges of bytes; a range gives the chunks of samples that begin in it, so a long file is the
work of many tasks, and of the file a task reads the header and its range alone. With the option ``metadata`` only headers
are read, a few dozen bytes each. Writing: tasks write to a folder of their own below the target, and only the commit of
the whole job moves the files to their names. A job that fails publishes nothing; its folder (hidden from readers by its
name) is removed, unless a task is still writing at that time. Both sides use stores that pyarrow knows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wavetide.sources.wav import encode

#: Samples of a chunk and bytes of a partition, where the options don't say.
CHUNK, RANGE = 1 << 18, 64 << 20
#: How files of other formats begin.
SIGNATURES = {b"fLaC": "FLAC", b"OggS": "Ogg", b"ID3": "MP3", b"\xff\xfb": "MP3", b"FORM": "AIFF", b"caff": "CAF", b".snd": "AU"}
_INFO = "path string, name string, sr double, channels bigint, n bigint, duration double"


@dataclass
class Header:
    rate: int
    channels: int
    width: int
    start: int
    n: int


def read_header(f, size: int, name: str) -> Header:
    """The layout of a WAV file from the heads of its chunks; other formats and codings raise with their name."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        kind = next((k for s, k in SIGNATURES.items() if head.startswith(s)), None)
        raise ValueError(f"{name}: {kind + ' files need a decoder that is not here' if kind else 'not a WAV file'}")
    at, layout = 12, None
    while at + 8 <= size:
        f.seek(at)
        tag, length = struct.unpack("<4sI", f.read(8))
        if tag == b"fmt ":
            raw = f.read(min(length, 40))
            coding, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            if coding == 0xFFFE and len(raw) >= 26:  # the coding stands in the extension
                coding = struct.unpack("<H", raw[24:26])[0]
            if coding not in (1, 3) or bits not in ((8, 16, 24, 32) if coding == 1 else (32, 64)):
                raise ValueError(f"{name}: WAV coding {coding} of {bits} bits is not supported")
            layout = rate, channels, bits // 8 if coding == 1 else -bits // 8
        elif tag == b"data":
            if layout is None:
                raise ValueError(f"{name}: samples before their format")
            rate, channels, width = layout
            length = min(length, size - at - 8)  # of a stream that was cut or never finished
            return Header(rate, channels, width, at + 8, length // (abs(width) * channels))
        at += 8 + length + length % 2
    raise ValueError(f"{name}: no samples")


def decoded(raw: bytes, width: int) -> np.ndarray:
    """Samples as numbers from -1 to 1; width: bytes of an integer, or of a float if negative."""
    if width < 0:
        return np.frombuffer(raw, f"<f{-width}").astype(float)
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    if width == 3:
        x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8) / float(1 << 23)
    return np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))


def _store(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if ":" in path else f"file://{path}")


class _Files(InputPartition):
    """Files to read whole, or one range of one file."""

    def __init__(self, files: list[tuple[str, int]], low: int = 0, high: int | None = None):
        super().__init__(None)
        self.files, self.low, self.high = files, low, high


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.chunk, self.range = int(options.get("chunk", CHUNK)), int(options.get("range", RANGE))
        self.metadata, self.mono = options.get("metadata", "false") == "true", options.get("mono", "true") == "true"

    def partitions(self) -> list[_Files]:
        store, base = _store(self.path)
        at = store.get_file_info(base)
        found = [at] if at.type == FileType.File else store.get_file_info(FileSelector(base, recursive=True))
        hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].split("/") if x)  # noqa: E731  of unfinished writes
        files = sorted((x.path, x.size) for x in found if x.type == FileType.File and x.path.lower().endswith(".wav") and not hidden(x.path))
        if self.metadata:
            return [_Files(files[k : k + 256]) for k in range(0, len(files), 256)] or [_Files([])]
        out, small, held = [], [], 0
        for path, size in files:
            if size > self.range:
                out += [_Files([(path, size)], low, low + self.range) for low in range(0, size, self.range)]
                continue
            if held + size > self.range and small:
                out.append(_Files(small))
                small, held = [], 0
            small.append((path, size))
            held += size
        return out + [_Files(small)] if small or not out else out

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for path, size in part.files:
            name = path.rsplit("/", 1)[-1]
            with store.open_input_file(path) as f:
                h = read_header(f, size, name)
                info = [path, name, float(h.rate), h.channels, h.n, h.n / h.rate if h.rate else None]
                columns = [pa.array([v], t) for v, t in zip(info, (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))]
                names = ["path", "name", "sr", "channels", "n", "duration"]
                if self.metadata:
                    yield pa.RecordBatch.from_arrays(columns, names)
                    continue
                frame = abs(h.width) * h.channels
                step = self.chunk * frame
                # chunks whose first byte lies in the range; a file without samples has an empty one
                count = max(1, -(-h.n // self.chunk))
                first = max(0, -(-(part.low - h.start) // step))
                last = count if part.high is None else min(count, max(0, -(-(part.high - h.start) // step)))
                for c in range(first, last):
                    f.seek(h.start + c * step)
                    y = decoded(f.read(min(step, (h.n - c * self.chunk) * frame)), h.width).reshape(-1, h.channels)
                    y = y.mean(axis=1) if self.mono else y[:, 0]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([c], pa.int64()), pa.array([y], pa.list_(pa.float64()))], [*names, "chunk", "y"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WavWriter(DataSourceArrowWriter):
    """Rows (signal_id, y) to one 16-bit file each, named by signal_id."""

    def __init__(self, options, overwrite: bool):
        self.path, self.sr, self.overwrite = options.get("path"), int(float(options.get("sr", 22050))), overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, base = _store(self.path)
        files = []
        for b in batches:
            for key, y in zip(b.column("signal_id"), b.column("y")):
                at = f"{base}/{self.job}/{uuid.uuid4().hex}"  # of this try of the task alone
                if not files:
                    store.create_dir(f"{base}/{self.job}", recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(encode(np.asarray(y.values, float) if y.is_valid else np.empty(0), self.sr))
                files.append((at, f"{base}/{key.as_py()}.wav"))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        """All tasks are through: their files get their names, and the folder of the job goes."""
        store, base = _store(self.path)
        names = [to for m in messages if m for _, to in m.files]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("two signals have one name")
        if self.overwrite and store.get_file_info(base).type == FileType.Directory:
            for old in store.get_file_info(FileSelector(base)):
                if old.type == FileType.File and old.path.endswith(".wav") and old.path not in names:
                    store.delete_file(old.path)
        store.create_dir(base, recursive=True)
        for m in messages:
            for at, to in m.files if m else ():
                store.move(at, to)
        self._clear(store, base)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/{self.job}").type == FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")


class WavSource(DataSource):
    """Options: path; chunk (samples in a row), range (bytes in a partition), metadata (headers only), mono; sr (writing)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return _INFO if self.options.get("metadata", "false") == "true" else f"{_INFO}, chunk bigint, y array<double>"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        missing = {"signal_id", "y"} - set(schema.names)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        return WavWriter(self.options, overwrite)


def audio_info(spark, path: str):
    """(path, name, sr, channels, n, duration) of the WAV files below path, from their headers."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("metadata", "true").load(path)

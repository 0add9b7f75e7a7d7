"""Command line: one subcommand for each common question about a folder of WAV files.

    python -m wavetide.cli tempo recordings/ --format csv
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetide.kernels import dsp, features, rhythm, sequence
from wavetide.operators.kernels import apply
from wavetide.plans import banks
from wavetide.sources.wav import read_wav


def _spectrum(a, power=1.0):
    return lambda y: np.abs(dsp.stft(y, a.n_fft, a.hop_length, a.win_length, a.window)) ** power


def _mel(a):
    return lambda y: features.melspectrogram(_spectrum(a, 2.0)(y), a.sr, a.n_fft, n_mels=a.n_mels)


def _env(a, **p):
    return lambda y: rhythm.onset_envelope(y, a.sr, a.n_fft, a.hop_length, **p)


def _column(f):
    return lambda y: np.asarray(f(y))[:, None]


def _centroid(a):
    f = banks.fft_frequencies(a.sr, a.n_fft)
    return lambda y: (lambda s: s @ f / np.maximum(s.sum(axis=1), banks.TINY))(_spectrum(a)(y))


def _bandwidth(a):
    f = banks.fft_frequencies(a.sr, a.n_fft)

    def run(y):
        s = _spectrum(a)(y)
        total = np.maximum(s.sum(axis=1), banks.TINY)
        return np.sqrt((s * (f - (s @ f / total)[:, None]) ** 2).sum(axis=1) / total)

    return run


def _rolloff(a):
    f = banks.fft_frequencies(a.sr, a.n_fft)
    return lambda y: (lambda c: f[np.argmax(c >= 0.85 * c[:, -1:], axis=1)])(np.cumsum(_spectrum(a)(y), axis=1))


def _flatness(a):
    return lambda y: (lambda p: np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1))(np.maximum(1e-10, _spectrum(a, 2.0)(y)))


def _framed(a, f):
    return lambda y: f(dsp.frame(dsp.pad_signal(y, a.n_fft // 2, a.n_fft // 2), a.n_fft, a.hop_length))


def _pitch(a):
    return lambda y: features.pyin(y, 65.4, min(2093.0, a.sr / 2), a.sr, a.n_fft, a.hop_length)


def _chroma(a):
    return lambda y: features.chroma_stft(_spectrum(a, 2.0)(y), a.sr, a.n_fft)


def _hpss(a):
    def run(y):
        h, p = sequence.hpss(dsp.stft(y))
        return np.stack([dsp.istft(x, length=len(y)) for x in (h, p)], axis=1)

    return run


#: Subcommand: shape of the result, and how its kernel is made from the arguments.
COMMANDS: dict[str, tuple[str, Callable]] = {
    "tempo": ("value", lambda a: lambda y: rhythm.tempo(_env(a)(y), a.sr, a.hop_length)),
    "beat": ("beats", lambda a: lambda y: rhythm.beat_track(_env(a, aggregate="median")(y), a.sr, a.hop_length)),
    "onset": ("events", lambda a: lambda y: rhythm.onset_detect(_env(a)(y), a.sr, a.hop_length)),
    "pitch": ("pitch", _pitch),
    "mfcc": ("frames", lambda a: lambda y: features.mfcc(dsp.power_to_db(features.melspectrogram(np.abs(dsp.stft(y, a.n_fft, a.hop_length)) ** 2, a.sr, a.n_fft)), a.n_mfcc)),
    "melspectrogram": ("frames", _mel),
    "chroma": ("frames", _chroma),
    "spectral-centroid": ("frames", lambda a: _column(_centroid(a))),
    "spectral-bandwidth": ("frames", lambda a: _column(_bandwidth(a))),
    "spectral-rolloff": ("frames", lambda a: _column(_rolloff(a))),
    "spectral-flatness": ("frames", lambda a: _column(_flatness(a))),
    "spectral-contrast": ("frames", lambda a: lambda y: features.spectral_contrast(_spectrum(a)(y), banks.fft_frequencies(a.sr, a.n_fft))),
    "rms": ("frames", lambda a: _column(_framed(a, lambda x: np.sqrt((x * x).mean(axis=1))))),
    "zcr": ("frames", lambda a: _column(_framed(a, lambda x: ((x[:, 1:] < 0) != (x[:, :-1] < 0)).mean(axis=1)))),
    "tonnetz": ("frames", lambda a: lambda y: features.tonnetz(_chroma(a)(y))),
    "tuning": ("value", lambda a: lambda y: features.estimate_tuning(_spectrum(a)(y), a.sr, a.n_fft)),
    "stft": ("frames", _spectrum),
    "trim": ("intervals", lambda a: lambda y: [dsp.trim(y, a.top_db, frame_length=a.n_fft, hop_length=a.hop_length)]),
    "hpss": ("frames", _hpss),
}


def run(spark: SparkSession, command: str, path: str, args: argparse.Namespace) -> DataFrame:
    """signal_id (the file's name) and the result; frames get their time in seconds."""
    if command == "info":
        return read_wav(spark, path, samples=False)
    shape, make = COMMANDS[command]
    files = read_wav(spark, path, sr=args.sr, mono=args.mono, offset=args.offset, duration=args.duration).withColumnRenamed("name", "signal_id")
    out = apply(files, make(args), ("y",), shape)
    if shape in ("frames", "pitch") and command != "hpss" and not args.no_time:
        out = out.withColumn("time", F.col("t") * (args.hop_length / args.sr))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavetide", description=__doc__)
    p.add_argument("command", choices=["info", *COMMANDS])
    p.add_argument("path")
    p.add_argument("--sr", type=float, default=banks.SR)
    p.add_argument("--mono", type=lambda x: x.lower() != "false", default=True)
    p.add_argument("--offset", type=float, default=0.0)
    p.add_argument("--duration", type=float)
    p.add_argument("--n-fft", type=int, default=banks.N_FFT)
    p.add_argument("--hop-length", type=int, default=banks.HOP)
    p.add_argument("--win-length", type=int)
    p.add_argument("--window", default="hann")
    p.add_argument("--n-mels", type=int, default=banks.N_MELS)
    p.add_argument("--n-mfcc", type=int, default=20)
    p.add_argument("--top-db", type=float, default=60.0)
    p.add_argument("--format", choices=["text", "json", "csv"], default="text")
    p.add_argument("--precision", type=int, default=6)
    p.add_argument("--no-time", action="store_true")
    p.add_argument("--out", help="folder for the result instead of the screen")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("wavetide").getOrCreate()
    out = run(spark, args.command, args.path, args)
    rounded = [F.round(c, args.precision).alias(c) if t == "double" else F.transform(c, lambda x: F.round(x, args.precision)).alias(c) if t == "array<double>" else F.col(c) for c, t in out.dtypes]
    out = out.select(*rounded)
    flat = out.select(*(F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes))
    if args.out:
        (out.write.json if args.format == "json" else flat.write.option("header", "true").csv)(args.out)
        return 0
    if args.format == "csv":
        print(",".join(out.columns))
    for r in (out if args.format == "json" else flat).toLocalIterator():
        sep = "," if args.format == "csv" else "\t"
        print(_line(r, args.format, sep))
    return 0


def _line(row, kind: str, sep: str) -> str:
    import json

    return json.dumps(row.asDict(recursive=True)) if kind == "json" else sep.join(map(str, row))


if __name__ == "__main__":
    sys.exit(main())

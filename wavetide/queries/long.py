"""Queries over chunked signals: one signal is the work of many tasks. Chunks of 32 samples, so that borders matter here."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetide.operators import long as L
from wavetide.operators import signals as S
from wavetide.operators.alignment import align

from .base import HOP, N, SQL, SR, long, query, r
from .kernels import SOS, paired
from .spectral import _long, mel_bank

SIZE = 32


def chunks(spark, folder):
    return L.chunked(long(spark, folder), SIZE)


def spectrum(spark, folder):
    return L.stft(chunks(spark, folder), N, HOP, center=False, size=SIZE)


def _samples(df, digits=6):
    return L.samples_of(df, SIZE).select("signal_id", "n", r("v", digits).alias("v"))


def _sql_samples(name: str) -> str:
    """The SQL of a query with whole signals, a row for each sample."""
    return f"SELECT signal_id, unnest(range(len(y))) AS n, unnest(y) AS v FROM ({SQL[name]}) q"


@query("long_stft", SQL["stft"])
def long_stft(spark, folder):
    z = spectrum(spark, folder).select("signal_id", "t", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return z.select("signal_id", "t", F.col("k").cast("long").alias("k"), r("z.re", 4).alias("re"), r("z.im", 4).alias("im"))


@query("long_melspectrogram", SQL["melspectrogram"])
def long_melspectrogram(spark, folder):
    power = spectrum(spark, folder).select("signal_id", "t", F.zip_with("re", "im", lambda a, b: a * a + b * b).alias("f"))
    return _long(S.project(power, mel_bank()))


@query("long_istft", _sql_samples("istft"))
def long_istft(spark, folder):
    return _samples(L.istft(spectrum(spark, folder), N, HOP, center=False, size=SIZE), 5)


@query("long_preemphasis", SQL["preemphasis"])
def long_preemphasis(spark, folder):
    return _samples(L.preemphasis(chunks(spark, folder), size=SIZE))


@query("long_deemphasis", SQL["deemphasis"])
def long_deemphasis(spark, folder):
    return _samples(L.deemphasis(chunks(spark, folder)))


@query("long_sosfilt", _sql_samples("sosfilt"))
def long_sosfilt(spark, folder):
    return _samples(L.sosfilt(chunks(spark, folder), SOS), 5)


@query("long_pcen", SQL["pcen"])
def long_pcen(spark, folder):
    """The smoother keeps nine tenths."""
    size = F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))
    frames = spectrum(spark, folder).select("signal_id", "t", size.alias("f"))
    rows = L.pcen(frames, size=4, sr=SR, hop_length=HOP, time_constant=90**0.5 * HOP / SR).select("signal_id", "t", F.posexplode("f").alias("k", "v"))
    return rows.select("signal_id", "t", F.col("k").cast("long").alias("k"), r("v").alias("v"))


def _aligned(spark, folder):
    """The frames of the dtw queries, in tiles of five frames."""
    both = paired(spark, folder)
    side = lambda name: both.select("signal_id", F.posexplode(name).alias("t", "f"))
    return align(side("S"), side("R"), block=5)


@query("long_dtw_cost", f"SELECT signal_id, arg_max(f, t)[-1] AS cost FROM ({SQL['dtw']}) q GROUP BY 1")
def long_dtw_cost(spark, folder):
    return _aligned(spark, folder)[0].select("signal_id", r("cost", 5).alias("cost"))


@query("long_dtw_path", f"SELECT signal_id, i, j FROM ({SQL['dtw_backtrack']}) q")
def long_dtw_path(spark, folder):
    return _aligned(spark, folder)[1]

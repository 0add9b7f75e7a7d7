"""Queries of the fixed compositions, over the users' event signals and the weekly ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetide.plans import pipelines as P

from .base import HOP, N, SR, query, wide
from .kernels import _rounded, weekly

AT = dict(n_fft=N, hop_length=HOP)


@query("mel_presets")
def mel_presets(spark, folder):
    """The third preset is at half the rate."""
    made = P.presets(wide(spark, folder), SR, {"base": (16, 4), "highres": (16, 2), "low": (16, 4, SR / 2)}, n_mels=6)
    parts = [_rounded(d).withColumn("preset", F.lit(k)) for k, d in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


query("superflux")(lambda s, d: P.superflux(wide(s, d), SR, n_mels=6, fmin=1.0, fmax=30.0, **AT))
query("energy_shares")(lambda s, d: _rounded(P.energy_shares(wide(s, d), kernel_size=5, **AT)))
query("vocal_separation")(lambda s, d: _rounded(P.vocal_separation(wide(s, d), 8.0, **AT)))
query("music_sync")(lambda s, d: P.music_sync(wide(s, d), SR, stretch_fft=N, stretch_hop=HOP, **AT))
query("enhanced_chroma")(lambda s, d: _rounded(P.enhanced_chroma(weekly(s, d), SR, n_fft=64, hop_length=8, n_octaves=2, bins_per_octave=12, fmin=4.0)))
query("segmentation")(lambda s, d: P.segmentation(wide(s, d), SR, start_bpm=240.0, **AT))
query("segmentation_paths")(lambda s, d: _rounded(P.segmentation(wide(s, d), SR, "paths", start_bpm=240.0, n_fft=N, hop_length=2)))

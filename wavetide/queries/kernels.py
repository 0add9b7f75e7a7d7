"""Queries whose operator is a kernel: one row per signal in, rows of a shape out. SQL can't say them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wavetide.kernels import dsp
from wavetide.operators import kernels as K
from wavetide.plans import banks

from .base import COUNTED, HOP, LONG, N, SPECTRUM, SQL, SR, query, r, sql_round, table, wide
from .kernel_sql import SQL as KERNEL_SQL
from .spectral import DB, MIRROR, magnitudes, mel_bank, power, spectrum

TRANS = banks.transition_loop(3, 0.8)


def weekly(spark, folder):
    """Long signals: the prices of the orders of each week, one signal for each nation of the customers."""
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("signal_id"))
    orders = table(spark, folder, "orders").select("o_custkey", F.date_trunc("week", "o_orderdate").alias("week"), F.col("o_totalprice").cast("double").alias("v"))
    sums = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("signal_id", "week").agg(F.sum("v").alias("v"))
    y = F.transform(F.sort_array(F.collect_list(F.struct("week", "v"))), lambda x: x["v"] / 1e6)
    return sums.groupBy("signal_id").agg(y.alias("y"))


def matrices(spark, folder, of=magnitudes, name="S"):
    return K.to_matrix(of(spark, folder), name=name)


def mel_matrices(spark, folder, sums=False):
    from wavetide.operators.signals import project, to_db

    return K.to_matrix(to_db(project(power(spark, folder, sums), mel_bank())))


def complex_matrices(spark, folder, of=spectrum):
    z = of(spark, folder)
    rows = F.sort_array(F.collect_list(F.struct("t", "re", "im")))
    return z.groupBy("signal_id").agg(F.transform(rows, lambda x: x["re"]).alias("re"), F.transform(rows, lambda x: x["im"]).alias("im"))


def _rounded(df, last_digits=False):
    """Numbers of results, rounded; with last_digits as the SQL rounds."""
    one = (lambda x: sql_round(x, 5)) if last_digits else (lambda x: r(x, 5))
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "double":
            out.append(one(F.col(f.name)).alias(f.name))
        elif kind == "array<double>":
            out.append(F.transform(f.name, one).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _add(name, source, op, sql=None, last_digits=False, **params):
    query(name, sql)(lambda spark, folder: _rounded(op(source(spark, folder), **params), last_digits))


def paired(spark, folder, of=magnitudes):
    """Two matrices of each signal: all its frames, and all of them again from the fourth one on, the first three last."""
    return matrices(spark, folder, of).select("signal_id", "S", F.concat(F.slice("S", F.lit(4), F.size("S")), F.slice("S", 1, 3)).alias("R"))


def states(spark, folder):
    """Probabilities of three states for each frame, (states, frames): shares of three bands."""
    m = magnitudes(spark, folder)
    part = lambda a: F.aggregate(F.slice("f", a, 3), F.lit(0.0), lambda s, x: s + x)
    x = m.select("signal_id", "t", F.array(part(1), part(4), part(7)).alias("f"))
    x = x.select("signal_id", "t", F.transform("f", lambda v: v / F.aggregate("f", F.lit(0.0), lambda s, y: s + y)).alias("f"))
    rows = F.sort_array(F.collect_list(F.struct("t", "f")))
    one = lambda k: F.transform(rows, lambda v: v["f"][k])
    return x.groupBy("signal_id").agg(F.array(one(0), one(1), one(2)).alias("prob"))


def squares(spark, folder):
    """A symmetric matrix of each signal: its recurrence plot."""
    return K.to_matrix(K.recurrence_matrix(matrices(spark, folder), k=3, mode="affinity", skip=True))


def marks(spark, folder):
    every = lambda a, b: F.transform(F.sequence(F.lit(a), F.size("y") - 1, F.lit(b)), lambda x: x.cast("double"))
    spans = lambda a, n: F.transform(F.sequence(F.lit(a), F.size("y") - 12, F.lit(12)), lambda x: F.array(x.cast("double"), (x + n).cast("double")))
    return wide(spark, folder).select("signal_id", "y", every(3, 7).alias("source"), every(5, 11).alias("target"), spans(0, 10).alias("intervals"), spans(2, 9).alias("other"))


STFT = dict(n_fft=N, hop_length=HOP, center=False)
_add("istft", complex_matrices, K.istft, hop_length=HOP, center=False)
_add("phase_vocoder", complex_matrices, K.phase_vocoder, rate=1.5, hop_length=HOP)
_add("griffinlim", matrices, K.griffinlim, n_iter=4, hop_length=HOP, center=False, init_phase="zeros")
_add("pcen_kernel", matrices, K.pcen, sr=SR, hop_length=HOP)
_add("iirt", weekly, K.iirt, win_length=256, hop_length=64)
_add("reassigned_spectrogram", wide, K.reassigned_spectrogram, last_digits=True, sr=SR, fill_nan=True, skip=True, **STFT)
_add("fmt", wide, K.fmt, n_fmt=32)
CQT = dict(sr=SR, hop_length=8, fmin=4.0, n_bins=12, bins_per_octave=6)
_add("cqt", weekly, K.cqt, **CQT)
_add("cqt_magnitude", weekly, K.cqt_magnitude, **CQT)
_add("vqt", weekly, K.vqt, **CQT)
_add("pseudo_cqt", weekly, K.pseudo_cqt, **CQT)
_add("hybrid_cqt", weekly, K.hybrid_cqt, **CQT)
_add("icqt", lambda s, d: complex_matrices(s, d, lambda a, b: K.cqt(weekly(a, b), **CQT)), K.icqt, sr=SR, hop_length=8, fmin=4.0, bins_per_octave=6)
_add("griffinlim_cqt", lambda s, d: K.to_matrix(K.cqt_magnitude(weekly(s, d), **CQT)), K.griffinlim_cqt, n_iter=2, sr=SR, hop_length=8, fmin=4.0, bins_per_octave=6, init_phase="zeros")
_add("resample", wide, K.resample, orig_sr=64, target_sr=48)
_add("resample_linear", wide, K.resample, f"WITH {COUNTED}, o AS (SELECT signal_id, size, unnest(range(CAST(ceil(size * 0.75) AS BIGINT))) AS i FROM c), p AS (SELECT signal_id, i, CAST(floor(i / 0.75) AS BIGINT) AS a, i / 0.75 - floor(i / 0.75) AS part, size FROM o), x AS (SELECT p.signal_id, p.i, a.v + part * (coalesce(b.v, a.v) - a.v) AS v FROM p JOIN l a ON a.signal_id = p.signal_id AND a.n = p.a LEFT JOIN l b ON b.signal_id = p.signal_id AND b.n = p.a + 1) SELECT signal_id, list(round(v, 5) + 0.0 ORDER BY i) AS y FROM x GROUP BY 1", orig_sr=64, target_sr=48, res_type="linear")
_add("resample_fft", wide, K.resample, orig_sr=64, target_sr=48, res_type="fft")
_add("autocorrelate_fft", wide, K.autocorrelate, f"WITH {LONG}, a AS (SELECT a.signal_id, k, round(sum(a.v * b.v), 5) + 0.0 AS r FROM l a, range(8) q(k), l b WHERE b.signal_id = a.signal_id AND b.n = a.n + k GROUP BY 1, 2) SELECT signal_id, list(r ORDER BY k) AS y FROM a GROUP BY 1", max_size=8)
_add("lpc", wide, K.lpc, order=4)
_add("clicks_frames", lambda s, d: marks(s, d).withColumnRenamed("source", "frames"), K.clicks_frames, sr=64.0, hop_length=4, click_freq=10.0)
SOS = dsp.elliptic_bandpass(0.2, 0.4, 1.0, 40.0, 2).tolist()
_add("sosfilt", wide, K.sosfilt, sos=SOS)
_add("sosfiltfilt", wide, K.sosfiltfilt, sos=SOS)
_add("time_stretch", wide, K.time_stretch, rate=1.25, n_fft=N, hop_length=HOP)
_add("pitch_shift", wide, K.pitch_shift, sr=SR, n_steps=2, n_fft=N, hop_length=HOP)
_add("remix", marks, K.remix)
_add("harmonic", wide, K.harmonic, n_fft=N, hop_length=HOP, kernel_size=5)
_add("percussive", wide, K.percussive, n_fft=N, hop_length=HOP, kernel_size=5)
_add("mfcc_to_mel", lambda s, d: K.to_matrix(K.mfcc(mel_matrices(s, d, sums=True), n_mfcc=4)), K.mfcc_to_mel, last_digits=True, n_mels=6)
_add("mel_to_stft", lambda s, d: K.to_matrix(K.melspectrogram(matrices(s, d, power), sr=SR, n_fft=N, n_mels=6)), K.mel_to_stft, sr=SR, n_fft=N)
_add("mel_to_audio", lambda s, d: K.to_matrix(K.melspectrogram(matrices(s, d, power), sr=SR, n_fft=N, n_mels=6)), K.mel_to_audio, sr=SR, n_fft=N, hop_length=HOP, n_iter=2, init_phase="zeros")
_add("mfcc_to_audio", lambda s, d: K.to_matrix(K.mfcc(mel_matrices(s, d), n_mfcc=4)), K.mfcc_to_audio, n_mels=6, sr=SR, n_fft=N, hop_length=HOP, n_iter=2, init_phase="zeros")
_add("chroma_cqt", lambda s, d: K.to_matrix(K.cqt_magnitude(weekly(s, d), **CQT)), K.chroma_cqt, fmin=4.0, n_chroma=6, bins_per_octave=6)
_add("chroma_cens", lambda s, d: K.to_matrix(K.chroma_cqt(K.to_matrix(K.cqt_magnitude(weekly(s, d), **CQT)), fmin=4.0, n_chroma=6, bins_per_octave=6)), K.chroma_cens, win_len_smooth=9)
_add("chroma_vqt", lambda s, d: K.to_matrix(K.vqt_magnitude(weekly(s, d), **CQT)), K.chroma_vqt, fmin=4.0, bins_per_octave=6)
_add("delta_interp", matrices, K.delta, width=5)
FREQ = banks.fft_frequencies(SR, N)
_add("interp_harmonics", matrices, K.interp_harmonics, freqs=FREQ, harmonics=[1, 2])
_add("f0_harmonics", lambda s, d: matrices(s, d).withColumn("f0", F.transform("S", lambda x: F.lit(5.0))), K.f0_harmonics, freqs=FREQ, harmonics=[1, 2, 3])
_add("salience", matrices, K.salience, freqs=FREQ, harmonics=[1, 2], filter_peaks=True)
_add("yin", weekly, K.yin, fmin=2.0, fmax=16.0, sr=SR, frame_length=128, hop_length=32)
_add("pyin", weekly, K.pyin, fmin=2.0, fmax=16.0, sr=SR, frame_length=128, hop_length=32, resolution=0.5)
_add("estimate_tuning", matrices, K.estimate_tuning, sr=SR, n_fft=N, fmin=4.0, fmax=30.0)
_add("onset_detect_envelope", wide, K.onset_detect_envelope, sr=SR, hop_length=1)
AUDIO = dict(sr=SR, hop_length=HOP, n_fft=N, n_mels=6)
_add("onset_detect", weekly, K.onset_detect, **AUDIO)
query("onset_detect_times")(lambda s, d: K.onset_detect(weekly(s, d), **AUDIO).select("signal_id", "event_no", r(F.col("frame") * (HOP / SR)).alias("time")))
_add("tempogram", wide, K.tempogram, win_length=32)
_add("tempogram_audio", weekly, K.tempogram_audio, win_length=32, **AUDIO)
_add("fourier_tempogram", wide, K.fourier_tempogram, win_length=16)
_add("fourier_tempogram_audio", weekly, K.fourier_tempogram_audio, win_length=16, **AUDIO)
_add("tempogram_ratio", lambda s, d: K.to_matrix(K.tempogram(wide(s, d), win_length=32)), K.tempogram_ratio, sr=SR, hop_length=HOP)
_add("tempo", wide, K.tempo, sr=SR, hop_length=HOP, ac_size=2.0)
_add("tempo_frames", wide, K.tempo_frames, sr=SR, hop_length=HOP, ac_size=2.0)
_add("tempo_audio", weekly, K.tempo_audio, ac_size=4.0, **AUDIO)
_add("beat_track", wide, K.beat_track, sr=SR, hop_length=HOP, bpm=120.0)
_add("beat_track_audio", weekly, K.beat_track_audio, bpm=120.0, **AUDIO)
query("beat_track_times")(lambda s, d: K.beat_track_audio(weekly(s, d), bpm=120.0, **AUDIO).select("signal_id", "event_no", r(F.col("frame") * (HOP / SR)).alias("time")))
_add("plp", wide, K.plp, sr=SR, hop_length=HOP, win_length=16, tempo_min=60.0, tempo_max=400.0)
_add("plp_audio", weekly, K.plp_audio, win_length=16, tempo_min=60.0, tempo_max=400.0, **AUDIO)
_add("median_filter_2d", matrices, K.median_filter_2d, size=(3, 3))
_add("hpss_complex", complex_matrices, K.hpss_complex, kernel_size=5)
_add("decompose_nmf", lambda s, d: matrices(s, d).select("signal_id", F.transform(F.sequence(F.lit(0), F.lit(N // 2)), lambda k: F.transform("S", lambda f: f[k])).alias("S")), K.decompose_nmf, n_components=3, sort=True)
_add("nn_filter_median", matrices, K.nn_filter_median, neighbors=4, width=1)
_add("nnls", lambda s, d: paired(s, d).select("signal_id", F.col("S").alias("A"), F.col("R").alias("B")), K.nnls)
_add("cross_similarity_sparse", paired, K.cross_similarity_sparse, k=2, mode="distance")
_add("recurrence_matrix_sparse", matrices, K.recurrence_matrix_sparse, k=3, sym=True, skip=True)
_add("timelag_filter", squares, K.timelag_median_filter)
_add("path_enhance", squares, K.path_enhance, n=5, n_filters=3)
_add("agglomerative", matrices, K.agglomerative, k=4)
_add("subsegment", lambda s, d: matrices(s, d).withColumn("frames", F.array(F.lit(0.0), F.lit(4.0), F.lit(8.0))), K.subsegment, n_segments=2)
_add("laplacian_components", squares, K.laplacian_components, n_components=3)
_add("viterbi", states, K.viterbi, transition=TRANS)
_add("viterbi_with_logp", states, K.viterbi_with_logp, transition=TRANS)
_add("viterbi_discriminative", states, K.viterbi_discriminative, transition=TRANS)
_add("viterbi_binary", states, K.viterbi_binary, transition=banks.transition_loop(2, 0.9))
_add("viterbi_binary_with_logp", states, K.viterbi_binary_with_logp, transition=banks.transition_loop(2, 0.9))
_add("rqa", squares, K.rqa)
_add("rqa_backtrack", squares, K.rqa_backtrack)
_add("dtw", lambda s, d: paired(s, d, lambda a, b: magnitudes(a, b, sums=True)), K.dtw, last_digits=True)
_add("dtw_backtrack", paired, K.dtw_backtrack)
_add("dtw_backtracking", lambda s, d: K.to_matrix(K.dtw_steps(paired(s, d)), name="steps"), K.dtw_backtracking)
_add("match_events_kernel", marks, K.match_events, f"WITH {LONG}, e AS (SELECT signal_id, n FROM l WHERE n % 7 = 3), g AS (SELECT signal_id, n AS m FROM l WHERE n % 11 = 5), x AS (SELECT e.signal_id, e.n, arg_min(m, abs(m - e.n) * 1000 - m) AS nearest FROM e JOIN g ON g.signal_id = e.signal_id GROUP BY 1, 2) SELECT signal_id, CAST(n // 7 AS BIGINT) AS event_no, CAST(nearest // 11 AS BIGINT) AS frame FROM x")
_add("match_intervals_kernel", lambda s, d: marks(s, d).select("signal_id", F.col("intervals").alias("source"), F.col("other").alias("target")), K.match_intervals, strict=False)
_add("normalize_matrix", matrices, K.normalize, f"WITH {SPECTRUM}, x AS (SELECT signal_id, t, k, sqrt(p) / max(sqrt(p)) OVER (PARTITION BY signal_id, t) AS v FROM p) SELECT signal_id, t, list(round(v, 5) + 0.0 ORDER BY k) AS f FROM x GROUP BY 1, 2")
_add("sync", lambda s, d: matrices(s, d).withColumn("idx", F.array(F.lit(0.0), F.lit(4.0), F.lit(8.0))), K.sync, f"WITH {SPECTRUM}, g AS (SELECT signal_id, CAST(least(2, t // 4) AS BIGINT) AS t, k, round(list_extract(list(sqrt(p) ORDER BY p), CAST(count(*) // 2 AS BIGINT) + 1), 5) + 0.0 AS v FROM p GROUP BY 1, 2, 3) SELECT signal_id, t, list(v ORDER BY k) AS f FROM g GROUP BY 1, 2", aggregate="median")
_add("axis_sort_with_index", matrices, K.axis_sort_with_index)
_add("spectral_contrast_kernel", matrices, K.spectral_contrast, freq=FREQ, fmin=4.0, n_bands=2)
_add("onset_strength_kernel", mel_matrices, K.onset_strength, f"WITH {DB}, o AS (SELECT signal_id, t, m, d - lag(d) OVER (PARTITION BY signal_id, m ORDER BY t) AS rise FROM mtop) SELECT signal_id, t, round(avg(greatest(0, coalesce(rise, 0))), 5) + 0.0 AS v FROM o GROUP BY 1, 2")


@query("buf_to_float")
def buf_to_float(spark, folder):
    """16-bit samples packed by pack_pcm and read back."""
    from wavetide.sources.wav import pcm_to_signal, signal_to_pcm

    x = wide(spark, folder).select("signal_id", F.transform("y", lambda v: v / 128.0).alias("y"))
    return _rounded(pcm_to_signal(signal_to_pcm(x)))


@query("load")
def load(spark, folder):
    """Signals written as WAV files and read back: samples, rate and channels."""
    from wavetide.sources.wav import read_wav, write_wav
    from wavetide.sources.wav import scratch as scratch_folder

    path = scratch_folder(spark)
    write_wav(wide(spark, folder).select("signal_id", F.transform("y", lambda v: v / 128.0).alias("y")), path, sr=64)
    return _rounded(read_wav(spark, path).select("name", "sr", "channels", "y"))


@query("get_audio_info")
def get_audio_info(spark, folder):
    """From the files' headers alone."""
    from wavetide.sources.wav import scratch as scratch_folder
    from wavetide.sources.wav import write_wav
    from wavetide.sources.wav_source import audio_info

    path = scratch_folder(spark)
    write_wav(wide(spark, folder).select("signal_id", F.transform("y", lambda v: v / 128.0).alias("y")), path, sr=64)
    return audio_info(spark, path).select("name", "sr", "channels", "n", "duration")


query("get_duration_of_files", f"WITH {COUNTED} SELECT signal_id || '.wav' AS name, size / 64.0 AS duration FROM c")(lambda s, d: get_audio_info(s, d).select("name", "duration"))
query("get_samplerate")(lambda s, d: get_audio_info(s, d).select("name", "sr"))
SQL.update({name: sql.replace("{mirror}", MIRROR).replace("{db}", DB) for name, sql in KERNEL_SQL.items()})

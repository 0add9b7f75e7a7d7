"""Queries over short-time spectra: frames of 16 samples every 4, Hann window, not centred."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavetide.functions import convert as C
from wavetide.operators import kernels as K
from wavetide.operators import signals as S
from wavetide.operators.neighbours import distances, nearest
from wavetide.plans import banks

from .base import HOP, N, SPECTRUM, SR, query, r, table, values, wide

FREQ = [float(f) for f in banks.fft_frequencies(SR, N)]
N_MELS, N_MFCC, N_CHROMA = 6, 4, 12


def spectrum(spark, folder, sums=False):
    return K.stft(wide(spark, folder), n_fft=N, hop_length=HOP, center=False, skip=True, sums=sums)


def power(spark, folder, sums=False):
    z = spectrum(spark, folder, sums)
    return z.select("signal_id", "t", F.zip_with("re", "im", lambda a, b: a * a + b * b).alias("f"))


def magnitudes(spark, folder, sums=False):
    return power(spark, folder, sums).select("signal_id", "t", F.transform("f", lambda x: F.sqrt(x)).alias("f"))


def _long(df, value="f", digits=4):
    return df.select("signal_id", "t", F.posexplode(value).alias("k", "v")).select("signal_id", "t", F.col("k").cast("long").alias("k"), r("v", digits).alias("v"))


def _bank(bank: np.ndarray) -> str:
    i, j = np.nonzero(bank)
    return values("bank", "m, k, w", zip(i.tolist(), j.tolist(), bank[i, j].tolist()))


def mel_bank():
    return banks.mel(SR, N, N_MELS)


MEL = f"{SPECTRUM}, {_bank(mel_bank())}, mel AS (SELECT signal_id, t, m, sum(p * w) AS v FROM p JOIN bank USING (k) GROUP BY ALL)"
DB = MEL + """, mdb AS (SELECT signal_id, t, m, 10 * log10(greatest(1e-10, v)) AS d FROM mel),
 mtop AS (SELECT signal_id, t, m, greatest(d, max(d) OVER (PARTITION BY signal_id) - 80) AS d FROM mdb)"""


@query("stft", f"WITH {SPECTRUM} SELECT signal_id, t, k, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM z")
def stft(spark, folder):
    z = spectrum(spark, folder).select("signal_id", "t", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return z.select("signal_id", "t", F.col("k").cast("long").alias("k"), r("z.re", 4).alias("re"), r("z.im", 4).alias("im"))


@query("stft_magnitude", f"WITH {SPECTRUM} SELECT signal_id, t, k, round(sqrt(p), 4) + 0.0 AS v FROM p")
def stft_magnitude(spark, folder):
    return _long(magnitudes(spark, folder))


@query("stft_relational", f"WITH {SPECTRUM} SELECT signal_id, t, k, round(p, 3) + 0.0 AS p FROM p")
def stft_relational(spark, folder):
    """The same power without Python: frames joined with a table of cosines and sines."""
    i = np.arange(N)
    window = banks.get_window("hann", N)
    rows = [(k, int(j), float(window[j] * np.cos(2 * np.pi * k * j / N)), float(window[j] * np.sin(2 * np.pi * k * j / N))) for k in range(N // 2 + 1) for j in i]
    basis = spark.createDataFrame(rows, "k long, i int, c double, s double")
    frames = S.frame(wide(spark, folder), N, HOP).select("signal_id", F.col("t").cast("long").alias("t"), F.posexplode("f").alias("i", "v"))
    z = frames.join(F.broadcast(basis), "i").groupBy("signal_id", "t", "k").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("s")).alias("im"))
    return z.select("signal_id", "t", "k", r(C.abs2("re", "im"), 3).alias("p"))


@query("power_to_db", f"WITH {SPECTRUM}, d AS (SELECT signal_id, t, k, 10 * log10(greatest(1e-10, p)) AS d FROM p) SELECT signal_id, t, k, round(greatest(d, max(d) OVER (PARTITION BY signal_id) - 20), 4) + 0.0 AS v FROM d")
def power_to_db(spark, folder):
    return _long(S.to_db(power(spark, folder), top_db=20.0))


@query("amplitude_to_db", f"WITH {SPECTRUM}, d AS (SELECT signal_id, t, k, 10 * log10(greatest(1e-10, p)) AS d FROM p) SELECT signal_id, t, k, round(greatest(d, max(d) OVER (PARTITION BY signal_id) - 30), 4) + 0.0 AS v FROM d")
def amplitude_to_db(spark, folder):
    squares = magnitudes(spark, folder).select("signal_id", "t", F.transform("f", lambda x: x * x).alias("f"))
    return _long(S.to_db(squares, top_db=30.0))


#: The A curve over f2, the square of the frequency.
_A_CURVE = "CASE WHEN f2 = 0 THEN -80 ELSE 2 + 20 * (2 * log10(12194.217) + 2 * log10(greatest(f2, 1e-9)) - log10(f2 + pow(12194.217, 2)) - log10(f2 + pow(20.598997, 2)) - 0.5 * log10(f2 + pow(107.65265, 2)) - 0.5 * log10(f2 + pow(737.86223, 2))) END"


@query("perceptual_weighting", f"WITH {SPECTRUM}, d AS (SELECT signal_id, t, k, f * f AS f2, 10 * log10(greatest(1e-10, p)) AS d FROM p), x AS (SELECT *, greatest(d, max(d) OVER (PARTITION BY signal_id) - 80) AS level FROM d) SELECT signal_id, t, k, round(level + greatest(-80, {_A_CURVE}), 4) + 0.0 AS v FROM x")
def perceptual_weighting(spark, folder):
    """Levels plus the A curve."""
    return _long(S.perceptual_weighting(power(spark, folder), FREQ))


@query("melspectrogram", f"WITH {MEL} SELECT signal_id, t, m AS k, round(v, 4) + 0.0 AS v FROM mel")
def melspectrogram(spark, folder):
    return _long(S.project(power(spark, folder), mel_bank()))


@query("mel_db", f"WITH {DB} SELECT signal_id, t, m AS k, round(d, 4) + 0.0 AS v FROM mtop")
def mel_db(spark, folder):
    return _long(S.to_db(S.project(power(spark, folder), mel_bank())))


_DCT = banks.dct_basis(N_MFCC, N_MELS)


@query("mfcc", f"WITH {DB}, {values('dct', 'q, m, w', [(q, m, float(_DCT[q, m])) for q in range(N_MFCC) for m in range(N_MELS)])} SELECT signal_id, t, q AS k, round(sum(d * w), 4) + 0.0 AS v FROM mtop JOIN dct USING (m) GROUP BY ALL")
def mfcc(spark, folder):
    return _long(S.project(S.to_db(S.project(power(spark, folder), mel_bank())), _DCT))


_CHROMA = banks.chroma(SR, N, N_CHROMA, ctroct=1.0, octwidth=None)


@query("chroma_stft", f"WITH {SPECTRUM}, {_bank(_CHROMA)}, ch AS (SELECT signal_id, t, m AS k, sum(p * w) AS v FROM p JOIN bank USING (k) GROUP BY ALL), x AS (SELECT *, max(v) OVER (PARTITION BY signal_id, t) AS top FROM ch) SELECT signal_id, t, k, round(v / top, 4) + 0.0 AS v FROM x".replace("m AS k, sum(p * w) AS v FROM p JOIN bank USING (k) GROUP BY ALL", "m AS k, sum(p * w) AS v FROM p JOIN bank USING (k) GROUP BY signal_id, t, m"))
def chroma_stft(spark, folder):
    x = S.project(power(spark, folder), _CHROMA)
    return _long(x.select("signal_id", "t", S.normalize("f").alias("f")))


_TONNETZ = np.array([1, 1, 1, 1, 0.5, 0.5])[:, None] * np.cos(np.pi * (np.outer([7 / 6, 7 / 6, 3 / 2, 3 / 2, 2 / 3, 2 / 3], np.arange(12.0)) - 0.5 * (np.arange(6) % 2 == 0)[:, None]))


@query("tonnetz", f"WITH {SPECTRUM}, {_bank(_CHROMA)}, ch AS (SELECT signal_id, t, m, sum(p * w) AS v FROM p JOIN bank USING (k) GROUP BY signal_id, t, m), x AS (SELECT signal_id, t, m, v / sum(v) OVER (PARTITION BY signal_id, t) AS v FROM ch), {values('phi', 'd, m, w', [(d, m, float(_TONNETZ[d, m])) for d in range(6) for m in range(12)])} SELECT signal_id, t, d AS k, round(sum(v * w), 4) + 0.0 AS v FROM x JOIN phi USING (m) GROUP BY signal_id, t, d")
def tonnetz(spark, folder):
    chroma = S.project(power(spark, folder), _CHROMA).select("signal_id", "t", S.normalize("f", 1.0).alias("f"))
    return _long(S.project(chroma, _TONNETZ))


_SUMS = "SELECT signal_id, t, sum(f * sqrt(p)) / sum(sqrt(p)) AS c FROM p GROUP BY 1, 2"


@query("spectral_centroid", f"WITH {SPECTRUM} SELECT signal_id, t, round(sum(f * sqrt(p)) / sum(sqrt(p)), 4) + 0.0 AS centroid FROM p GROUP BY 1, 2")
def spectral_centroid(spark, folder):
    return S.spectral_centroid(magnitudes(spark, folder), FREQ).select("signal_id", "t", r("centroid", 4).alias("centroid"))


@query("spectral_bandwidth", f"WITH {SPECTRUM}, ce AS ({_SUMS}) SELECT signal_id, t, round(sqrt(sum(sqrt(p) * pow(f - c, 2)) / sum(sqrt(p))), 4) + 0.0 AS bandwidth FROM p JOIN ce USING (signal_id, t) GROUP BY 1, 2")
def spectral_bandwidth(spark, folder):
    return S.spectral_bandwidth(magnitudes(spark, folder), FREQ).select("signal_id", "t", r("bandwidth", 4).alias("bandwidth"))


@query("spectral_rolloff", f"WITH {SPECTRUM}, x AS (SELECT signal_id, t, f, sum(sqrt(p)) OVER (PARTITION BY signal_id, t ORDER BY k ROWS UNBOUNDED PRECEDING) AS run, sum(sqrt(p)) OVER (PARTITION BY signal_id, t) AS total FROM p) SELECT signal_id, t, CAST(min(f) AS DOUBLE) AS rolloff FROM x WHERE run >= 0.85 * total GROUP BY 1, 2")
def spectral_rolloff(spark, folder):
    return S.spectral_rolloff(magnitudes(spark, folder), FREQ)


@query("spectral_flatness", f"WITH {SPECTRUM} SELECT signal_id, t, round(exp(avg(ln(greatest(1e-10, p)))) / avg(greatest(1e-10, p)), 6) + 0.0 AS flatness FROM p GROUP BY 1, 2")
def spectral_flatness(spark, folder):
    return S.spectral_flatness(magnitudes(spark, folder)).select("signal_id", "t", r("flatness").alias("flatness"))


@query("spectral_contrast", f"WITH {SPECTRUM}, b AS (SELECT signal_id, t, CAST(CASE WHEN k < 3 THEN 0 WHEN k < 5 THEN 1 ELSE 2 END AS BIGINT) AS k, max(sqrt(p)) - min(sqrt(p)) AS v FROM p GROUP BY ALL) SELECT signal_id, t, k, round(v, 4) + 0.0 AS v FROM b")
def spectral_contrast(spark, folder):
    """Linear contrast of three bands, of one bin's quantile each."""
    parts = [(1, 3), (4, 2), (6, 4)]
    bands = F.array(*(F.array_max(F.slice("f", a, n)) - F.array_min(F.slice("f", a, n)) for a, n in parts))
    return _long(magnitudes(spark, folder).select("signal_id", "t", bands.alias("f")))


@query("poly_features", f"WITH {SPECTRUM} SELECT signal_id, t, round(regr_slope(sqrt(p), f), 4) + 0.0 AS slope, round(regr_intercept(sqrt(p), f), 4) + 0.0 AS intercept FROM p GROUP BY 1, 2")
def poly_features(spark, folder):
    fit = np.linalg.pinv(np.vander(FREQ, 2))
    x = S.project(magnitudes(spark, folder), fit)
    return x.select("signal_id", "t", r(F.col("f")[0], 4).alias("slope"), r(F.col("f")[1], 4).alias("intercept"))


@query("rms_spectrum", f"WITH {SPECTRUM} SELECT signal_id, t, round(sqrt(avg(p)), 4) + 0.0 AS rms FROM p GROUP BY 1, 2")
def rms_spectrum(spark, folder):
    return S.rms(magnitudes(spark, folder)).select("signal_id", "t", r("rms", 4).alias("rms"))


@query("onset_strength", f"WITH {DB}, o AS (SELECT signal_id, t, m, d - lag(d) OVER (PARTITION BY signal_id, m ORDER BY t) AS rise FROM mtop) SELECT signal_id, t, round(avg(greatest(0, coalesce(rise, 0))), 4) + 0.0 AS v FROM o GROUP BY 1, 2")
def onset_strength(spark, folder):
    return S.onset_strength(S.to_db(S.project(power(spark, folder), mel_bank()))).select("signal_id", "t", r("v", 4).alias("v"))


@query("onset_strength_multi", f"WITH {DB}, o AS (SELECT signal_id, t, m, d - lag(d) OVER (PARTITION BY signal_id, m ORDER BY t) AS rise FROM mtop) SELECT signal_id, t, CAST(m // 3 AS BIGINT) AS k, round(avg(greatest(0, coalesce(rise, 0))), 4) + 0.0 AS v FROM o GROUP BY 1, 2, 3")
def onset_strength_multi(spark, folder):
    db = S.to_db(S.project(power(spark, folder), mel_bank()))
    w = Window.partitionBy("signal_id").orderBy("t")
    rise = F.zip_with("f", F.coalesce(F.lag("f").over(w), F.col("f")), lambda a, b: F.greatest(F.lit(0.0), a - b))
    x = db.select("signal_id", "t", rise.alias("rise"))
    mean = lambda a: F.aggregate(F.slice("rise", a, 3), F.lit(0.0), lambda s, v: s + v) / 3
    return _long(x.select("signal_id", "t", F.array(mean(1), mean(4)).alias("f")))


@query("pcen", f"WITH RECURSIVE {SPECTRUM}, e AS (SELECT signal_id, k, t, 0.1 * sqrt(p) + 0.9 AS s FROM p WHERE t = 0 UNION ALL SELECT p.signal_id, p.k, p.t, 0.1 * sqrt(p.p) + 0.9 * e.s FROM p JOIN e ON p.signal_id = e.signal_id AND p.k = e.k AND p.t = e.t + 1) SELECT signal_id, t, k, round(sqrt(2) * (sqrt(1 + sqrt(p) * exp(-0.98 * (ln(1e-6) + ln(1 + s / 1e-6))) / 2) - 1), 6) + 0.0 AS v FROM p JOIN e USING (signal_id, k, t)")
def pcen(spark, folder):
    """A fold over each bin's frames; the smoother starts at one and keeps nine tenths."""
    x = magnitudes(spark, folder).select("signal_id", "t", F.posexplode("f").alias("k", "v"))
    y = x.groupBy("signal_id", "k").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("x"))
    none = F.array().cast("array<struct<t:bigint,v:double,s:double>>")
    smooth = F.aggregate("x", none, lambda acc, p: F.array_append(acc, F.struct(p["t"].alias("t"), p["v"].alias("v"), (0.1 * p["v"] + 0.9 * F.coalesce(F.try_element_at(acc, F.lit(-1))["s"], F.lit(1.0))).alias("s"))))
    z = y.select("signal_id", F.col("k").cast("long").alias("k"), F.explode(smooth).alias("e"))
    level = F.exp(-0.98 * (float(np.log(1e-6)) + F.log1p(F.col("e.s") / 1e-6)))
    return z.select("signal_id", F.col("e.t").alias("t"), "k", r(2.0**0.5 * (F.sqrt(1 + F.col("e.v") * level / 2) - 1)).alias("v"))


#: Edges are mirrored without the edge itself, and stay at the other end where the mirror passes it.
MIRROR = """m AS (SELECT signal_id, t, k, sqrt(p) AS v, max(t) OVER (PARTITION BY signal_id) AS tt FROM p),
 g AS (SELECT DISTINCT signal_id, tt FROM m),
 ha AS (SELECT g.signal_id, x AS t, k, v, g.tt FROM g, range(-2, g.tt + 3) q(x), m WHERE m.signal_id = g.signal_id
  AND m.t = CASE WHEN x < 0 THEN least(-x, g.tt) WHEN x > g.tt THEN greatest(0, 2 * g.tt - x) ELSE x END),
 pa AS (SELECT signal_id, t, x AS k, v FROM m, range(-2, 11) q(x) WHERE k = CASE WHEN x < 0 THEN -x WHEN x > 8 THEN 16 - x ELSE x END),
 h AS (SELECT signal_id, t, k, tt, median(v) OVER (PARTITION BY signal_id, k ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM ha),
 q AS (SELECT signal_id, t, k, median(v) OVER (PARTITION BY signal_id, t ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS q FROM pa)"""


@query("hpss", f"WITH {SPECTRUM}, {MIRROR} SELECT signal_id, t, k, round(h * h / (h * h + q * q), 4) + 0.0 AS harmonic, round(q * q / (h * h + q * q), 4) + 0.0 AS percussive FROM h JOIN q USING (signal_id, t, k) WHERE t BETWEEN 0 AND tt")
def hpss(spark, folder):
    masks = K.hpss(K.to_matrix(magnitudes(spark, folder)), kernel_size=5, mask=True)
    x = masks.select("signal_id", "t", F.posexplode(F.arrays_zip("a", "b")).alias("k", "z"))
    return x.select("signal_id", "t", F.col("k").cast("long").alias("k"), r("z.a", 4).alias("harmonic"), r("z.b", 4).alias("percussive"))


@query("piptrack", f"WITH {SPECTRUM}, m AS (SELECT signal_id, t, k, sqrt(p) AS v FROM p), x AS (SELECT signal_id, t, k, v, lag(v) OVER w AS a, lead(v) OVER w AS b, max(v) OVER (PARTITION BY signal_id, t) AS top FROM m WINDOW w AS (PARTITION BY signal_id, t ORDER BY k)), y AS (SELECT *, (b - a) / 2 AS g, b + a - 2 * v AS c FROM x), zz AS (SELECT *, CASE WHEN abs(g) >= abs(c) THEN 0 ELSE -g / c END AS shift FROM y) SELECT signal_id, t, k, round((k + shift) * {SR / N}, 4) + 0.0 AS pitch, round(v + 0.5 * g * shift, 4) + 0.0 AS mag FROM zz WHERE v > a AND v >= b AND v > 0.1 * top AND k * {SR / N} >= 8 AND k * {SR / N} < 30")
def piptrack(spark, folder):
    x = magnitudes(spark, folder).select("signal_id", "t", F.posexplode("f").alias("k", "v")).withColumn("k", F.col("k").cast("long"))
    w = Window.partitionBy("signal_id", "t").orderBy("k")
    y = x.withColumn("a", F.lag("v").over(w)).withColumn("b", F.lead("v").over(w)).withColumn("top", F.max("v").over(Window.partitionBy("signal_id", "t")))
    slope, bend, f = (F.col("b") - F.col("a")) / 2, F.col("b") + F.col("a") - 2 * F.col("v"), F.col("k") * (SR / N)
    shift = F.when(F.abs(slope) >= F.abs(bend), 0.0).otherwise(-slope / bend)
    keep = (F.col("v") > F.col("a")) & (F.col("v") >= F.col("b")) & (F.col("v") > 0.1 * F.col("top")) & (f >= 8) & (f < 30)
    return y.where(keep).select("signal_id", "t", "k", r((F.col("k") + shift) * (SR / N), 4).alias("pitch"), r(F.col("v") + 0.5 * slope * shift, 4).alias("mag"))


@query("pitch_tuning", "WITH x AS (SELECT user_id AS signal_id, 12 * log2(value / 27.5) AS o FROM events WHERE value > 0), y AS (SELECT signal_id, o - trunc(o) AS f FROM x), z AS (SELECT signal_id, CASE WHEN f >= 0.5 THEN f - 1 WHEN f < -0.5 THEN f + 1 ELSE f END AS f FROM y), b AS (SELECT signal_id, CAST(floor((f + 0.5) * 20) AS BIGINT) AS bin, count(*) AS c FROM z GROUP BY 1, 2) SELECT signal_id, round(-0.5 + arg_max(bin, c * 1000 - bin) / 20.0, 4) + 0.0 AS tuning FROM b GROUP BY 1")
def pitch_tuning(spark, folder):
    """Residuals of the events' values taken as frequencies, in bins of a twentieth; the first of equal bins."""
    x = table(spark, folder, "events").where("value > 0").select(F.col("user_id").alias("signal_id"), (12 * C.hz_to_octs("value")).alias("o"))
    f = F.col("o") - F.when(F.col("o") < 0, F.ceil("o")).otherwise(F.floor("o"))
    f = F.when(f >= 0.5, f - 1).when(f < -0.5, f + 1).otherwise(f)
    b = x.groupBy("signal_id", F.floor((f + 0.5) * 20).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    top = F.max_by("bin", F.struct("c", -F.col("bin")))
    return b.groupBy("signal_id").agg(r(-0.5 + top / F.lit(20.0), 4).alias("tuning"))


# similarity over the embeddings of each label, in order of their id

_EMB = "v AS (SELECT label AS signal_id, vec_id AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_DIST = "sqrt(list_sum([pow(x[1] - x[2], 2) FOR x IN list_zip(a.v, b.v)]))"


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("label").alias("signal_id"), F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))


def _sides(spark, folder):
    a = _vectors(spark, folder)
    return a, a.select("signal_id", F.col("i").alias("j"), F.col("v").alias("w"))


_RANKED = f"WITH {_EMB}, d AS (SELECT a.signal_id, a.i, b.i AS j, {{0}} AS d FROM v a JOIN v b ON a.signal_id = b.signal_id AND abs(a.i - b.i) >= 1), x AS (SELECT *, row_number() OVER (PARTITION BY signal_id, i ORDER BY d, j) AS rank FROM d)"


@query("cross_similarity", _RANKED.format(_DIST) + " SELECT signal_id, i, j, round(d, 5) + 0.0 AS d FROM x WHERE rank <= 4")
def cross_similarity(spark, folder):
    return nearest(*_sides(spark, folder), 4, width=1).select("signal_id", "i", "j", r("d", 5).alias("d"))


@query("cross_similarity_cosine", _RANKED.format("1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))") + " SELECT signal_id, i, j, round(d, 5) + 0.0 AS d FROM x WHERE rank <= 4")
def cross_similarity_cosine(spark, folder):
    return nearest(*_sides(spark, folder), 4, "cosine", width=1).select("signal_id", "i", "j", r("d", 5).alias("d"))


@query("recurrence_matrix", _RANKED.format(_DIST) + ", e AS (SELECT * FROM x WHERE rank <= 4) SELECT a.signal_id, a.i, a.j FROM e a JOIN e b ON a.signal_id = b.signal_id AND a.i = b.j AND a.j = b.i")
def recurrence_matrix(spark, folder):
    """Mutual neighbours."""
    return S.mutual(nearest(*_sides(spark, folder), 4, width=1)).select("signal_id", "i", "j")


@query("recurrence_affinity", _RANKED.format(_DIST) + ", e AS (SELECT * FROM x WHERE rank <= 4), b AS (SELECT signal_id, median(d) AS bw FROM e WHERE rank = 4 GROUP BY 1) SELECT signal_id, i, j, round(exp(-d / bw), 5) + 0.0 AS w FROM e JOIN b USING (signal_id)")
def recurrence_affinity(spark, folder):
    e = nearest(*_sides(spark, folder), 4, width=1)
    far = e.groupBy("signal_id", "i").agg(F.max("d").alias("far")).groupBy("signal_id").agg(F.percentile("far", F.lit(0.5)).alias("bw"))
    return e.join(far, "signal_id").select("signal_id", "i", "j", r(F.exp(-F.col("d") / F.col("bw")), 5).alias("w"))


def _numbered(spark, folder):
    """(signal_id, i, frame, size): each label's vectors numbered from 0, and how many there are."""
    own = Window.partitionBy("signal_id")
    frame = (F.row_number().over(own.orderBy("i")) - 1).cast("long")
    return _vectors(spark, folder).select("signal_id", "i", frame.alias("frame"), F.count(F.lit(1)).over(own).alias("size"))


def _lags(spark, folder):
    """(signal_id, i, frame, size, lag) of each link to a neighbour."""
    at = _numbered(spark, folder)
    to = at.select("signal_id", F.col("i").alias("j"), F.col("frame").alias("other"))
    e = nearest(*_sides(spark, folder), 4, width=1).join(at, ["signal_id", "i"]).join(to, ["signal_id", "j"])
    return e.select("signal_id", "i", "frame", "size", F.pmod(F.col("other") - F.col("frame"), 2 * F.col("size")).alias("lag"))


@query("recurrence_to_lag", _RANKED.format(_DIST) + ", n AS (SELECT signal_id, i, row_number() OVER (PARTITION BY signal_id ORDER BY i) AS frame, count(*) OVER (PARTITION BY signal_id) AS size FROM v) SELECT x.signal_id, x.i, (b.frame - a.frame + 2 * a.size) % (2 * a.size) AS lag FROM x JOIN n a ON a.signal_id = x.signal_id AND a.i = x.i JOIN n b ON b.signal_id = x.signal_id AND b.i = x.j WHERE rank <= 4")
def recurrence_to_lag(spark, folder):
    """Lags in frames of the label, of a plot padded to twice its frames."""
    return _lags(spark, folder).select("signal_id", "i", "lag")


@query("lag_to_recurrence", _RANKED.format(_DIST) + " SELECT signal_id, i, j FROM x WHERE rank <= 4")
def lag_to_recurrence(spark, folder):
    j = F.pmod(F.col("frame") + F.col("lag"), 2 * F.col("size")).alias("frame")
    back = _numbered(spark, folder).select("signal_id", "frame", F.col("i").alias("j"))
    return _lags(spark, folder).select("signal_id", "i", j).join(back, ["signal_id", "frame"]).select("signal_id", "i", "j")


@query("nn_filter", _RANKED.format(_DIST) + ", e AS (SELECT * FROM x WHERE rank <= 4), m AS (SELECT e.signal_id, e.i, generate_subscripts(b.v, 1) - 1 AS k, unnest(b.v) AS v FROM e JOIN v b ON b.signal_id = e.signal_id AND b.i = e.j) SELECT signal_id, i, k, round(avg(v), 5) + 0.0 AS v FROM m GROUP BY 1, 2, 3")
def nn_filter(spark, folder):
    a, b = _sides(spark, folder)
    e = nearest(a, b, 4, width=1).join(b, ["signal_id", "j"]).select("signal_id", "i", F.posexplode("w").alias("k", "v"))
    return e.groupBy("signal_id", "i", F.col("k").cast("long").alias("k")).agg(r(F.avg("v"), 5).alias("v"))


for _metric, _sql in (("euclidean", _DIST), ("cosine", "1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))")):
    query(f"cdist_{_metric}", f"WITH {_EMB} SELECT a.signal_id, a.i, b.i AS j, round({_sql}, 5) + 0.0 AS d FROM v a JOIN v b ON a.signal_id = b.signal_id AND a.i != b.i")(
        lambda spark, folder, m=_metric: distances(*_sides(spark, folder), m, digits=5).where("i != j")
    )

"""Grids, windows, banks and transition matrices for each signal, made for its number of samples; names for each part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetide.functions import notation
from wavetide.kernels import dsp
from wavetide.operators import kernels as K
from wavetide.operators import signals as S
from wavetide.plans import banks

from .base import COUNTED, LONG, query, r, table, values, wide
from .kernels import SOS, matrices


def _kept(make):
    """make, once in a task for each number of samples."""
    held: dict = {}

    def of(n):
        if n not in held:
            held[n] = make(n)
        return held[n]

    return of


def sizes(spark, folder):
    """(signal_id, n): the number of samples of each user's signal."""
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("signal_id")).agg(F.count(F.lit(1)).alias("n"))


SIZES = "WITH c AS (SELECT user_id AS signal_id, count(*) AS n FROM events GROUP BY 1)"


def _grid(name: str, make, f: str, count: str, digits: int = 6) -> None:
    """make: of the number of samples, a vector; f and count: SQL of its numbers k and of how many they are."""
    sql = f"{SIZES} SELECT signal_id, k, round({f}, {digits}) + 0.0 AS f FROM (SELECT signal_id, n, unnest(range({count})) AS k FROM c) q"
    made = _kept(make)
    query(name, sql)(lambda spark, folder: K.apply(sizes(spark, folder), made, ("n",), "series").select("signal_id", F.col("t").alias("k"), r("v", digits).alias("f")))


_grid("fft_frequencies", lambda n: banks.fft_frequencies(64.0, n), "k * 64.0 / n", "n // 2 + 1")
_grid("cqt_frequencies", lambda n: banks.cqt_frequencies(n, 0.5), "0.5 * pow(2, k / 12.0)", "n")
_grid("fourier_tempo_frequencies", lambda n: banks.fourier_tempo_frequencies(64.0, n, 4), "k * 60 * 64.0 / 4 / n", "n // 2 + 1")
_grid("mel_frequencies", lambda n: banks.mel_frequencies(n, 0.0, 8000.0, htk=True), "700 * (pow(10, k * log10(1 + 8000 / 700.0) / (n - 1)) - 1)", "n")
_grid("get_window", lambda n: banks.get_window("hann", n), "0.5 - 0.5 * cos(2 * pi() * k / n)", "n")
_grid("get_window_hamming", lambda n: banks.get_window("hamming", n, False), "0.54 - 0.46 * cos(2 * pi() * k / (n - 1))", "n")
_grid("get_window_blackman", lambda n: banks.get_window("blackman", n), "0.42 - 0.5 * cos(2 * pi() * k / n) + 0.08 * cos(4 * pi() * k / n)", "n")
_grid("interval_frequencies", lambda n: banks.interval_frequencies(n, 0.5), "0.5 * pow(2, k / 12.0)", "n")
_grid("mr_frequencies", lambda n: banks.mr_frequencies(n % 16 / 16)[0], "440 * pow(2, (k + 24 + n % 16 / 16.0 - 69) / 12.0)", "85")
_grid("tempo_frequencies", lambda n: banks.tempo_frequencies(n, 4, 64.0)[1:], "60 * 64.0 / (4 * (k + 1))", "n - 1")
_grid("relative_bandwidth", lambda n: banks.relative_bandwidth(banks.cqt_frequencies(24, float(n), 12 + n % 3)), "(pow(2, 2.0 / (12 + n % 3)) - 1) / (pow(2, 2.0 / (12 + n % 3)) + 1)", "24")
_grid("wavelet_lengths", lambda n: banks.wavelet_lengths(banks.cqt_frequencies(24, float(n)))[0], "(pow(2, 2 / 12.0) + 1) / (pow(2, 2 / 12.0) - 1) * 22050 / (n * pow(2, k / 12.0))", "24", 4)

query("pythagorean_intervals", f"{SIZES}, x AS (SELECT signal_id, i * log2(3) - floor(i * log2(3)) AS p FROM (SELECT signal_id, unnest(range(n)) AS i FROM c) q) SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY p) - 1 AS k, round(pow(2, p), 6) + 0.0 AS f FROM x")(
    lambda spark, folder: K.apply(sizes(spark, folder), _kept(banks.pythagorean_intervals), ("n",), "series").select("signal_id", F.col("t").alias("k"), r("v").alias("f"))
)
query("window_sumsquare", f"{SIZES} SELECT signal_id, t * 16 + i AS k, round(sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 64), 2)), 6) + 0.0 AS f FROM (SELECT signal_id, unnest(range(n)) AS t FROM c) a, range(64) b(i) GROUP BY 1, 2")(
    lambda spark, folder: K.apply(sizes(spark, folder), lambda n: banks.window_sumsquare("hann", n, 16, 64), ("n",), "series").select("signal_id", F.col("t").alias("k"), r("v").alias("f"))
)


def _matrix(name: str, make, sql: str | None = None) -> None:
    """make: of the number of samples, a matrix; rows are its entries other than zero."""
    made = _kept(make)

    @query(name, f"{SIZES} {sql}" if sql else None)
    def run(spark, folder):
        rows = K.apply(sizes(spark, folder), made, ("n",), "frames").select("signal_id", F.col("t").alias("m"), F.posexplode("f").alias("k", "w"))
        return rows.where("w <> 0").select("signal_id", "m", F.col("k").cast("long").alias("k"), r("w").alias("w"))


_STATES = "(SELECT signal_id, 3 + n % 4 AS s, unnest(range(3 + n % 4)) AS i FROM c) a, range(6) b(j) WHERE j < s"
_matrix("transition_uniform", lambda n: banks.transition_uniform(3 + n % 4), f"SELECT signal_id, i AS m, j AS k, round(1.0 / s, 6) + 0.0 AS w FROM {_STATES}")
_matrix("transition_loop", lambda n: banks.transition_loop(3 + n % 4, 0.9), f"SELECT signal_id, i AS m, j AS k, round(CASE WHEN i = j THEN 0.9 ELSE 0.1 / (s - 1) END, 6) + 0.0 AS w FROM {_STATES}")
_matrix("transition_cycle", lambda n: banks.transition_cycle(3 + n % 4, 0.8), f"SELECT signal_id, i AS m, j AS k, CASE WHEN i = j THEN 0.8 ELSE 0.2 END::DOUBLE AS w FROM {_STATES} AND (i = j OR j = (i + 1) % s)")
_matrix("transition_local", lambda n: banks.transition_local(3 + n % 4, 3), f"SELECT signal_id, i AS m, j AS k, CASE WHEN i = s - 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS w FROM {_STATES} AND j - i IN (0, 1)")
_matrix("cq_to_chroma", lambda n: banks.cq_to_chroma(n, 36), "SELECT signal_id, (k + 1) % 36 // 3 AS m, k, 1.0::DOUBLE AS w FROM (SELECT signal_id, unnest(range(n)) AS k FROM c) q")
_matrix(
    "mel",
    lambda n: banks.mel(22050.0, 128, 8 + n % 5),
    """, e AS (SELECT signal_id, bands, i, i * (15 + ln(11.025) * 27 / ln(6.4)) / (bands + 1) AS mel FROM (SELECT signal_id, 8 + n % 5 AS bands, unnest(range(10 + n % 5)) AS i FROM c) q),
 h AS (SELECT signal_id, i, CASE WHEN mel < 15 THEN 200 * mel / 3 ELSE 1000 * exp(ln(6.4) / 27 * (mel - 15)) END AS hz FROM e),
 b AS (SELECT x.signal_id, x.i AS m, x.hz AS lo, y.hz AS mid, z.hz AS hi FROM h x JOIN h y ON y.signal_id = x.signal_id AND y.i = x.i + 1 JOIN h z ON z.signal_id = x.signal_id AND z.i = x.i + 2),
 w AS (SELECT signal_id, m, k, greatest(0, least((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo) AS w FROM b, (SELECT k, k * 22050.0 / 128 AS f FROM range(65) q(k))) SELECT signal_id, m, k, round(w, 6) + 0.0 AS w FROM w WHERE w > 1e-9""",
)
_matrix(
    "chroma",
    lambda n: banks.chroma(22050.0, 64, tuning=n % 8 / 16 - 0.25),
    """, b AS (SELECT signal_id, k, 12 * log2(greatest(k, 1) * 22050 / 64.0 / 27.5) - (n % 8 / 16.0 - 0.25) - CASE WHEN k = 0 THEN 18 ELSE 0 END AS b FROM c, range(64) q(k)),
 w AS (SELECT signal_id, k, b, greatest(1, coalesce(lead(b) OVER (PARTITION BY signal_id ORDER BY k) - b, 1)) AS width FROM b), g AS (SELECT signal_id, m, k, b, exp(-0.5 * pow(2 * ((b - m + 126) % 12 - 6) / width, 2)) AS w FROM w, range(12) q(m)),
 n AS (SELECT signal_id, m, k, w / sqrt(sum(w * w) OVER (PARTITION BY signal_id, k)) * exp(-0.5 * pow((b / 12 - 5) / 2, 2)) AS w FROM g) SELECT signal_id, (m + 9) % 12 AS m, k, round(w, 6) + 0.0 AS w FROM n WHERE k <= 32""",
)
_matrix("diagonal_filter", lambda n: banks.diagonal_filter("hann", 9, n / 64.0))
_matrix("wavelet", lambda n: np.abs(banks.wavelet(banks.cqt_frequencies(3, float(n)), 640.0)[0]))
_matrix("semitone_filterbank", lambda n: np.concatenate(dsp.semitone_filterbank(tuning=n % 4 / 8)[0]))

_SECTIONS = values("s", "section, b0, b1, b2, a0, a1, a2", [(k, *map(float, row)) for k, row in enumerate(SOS)])
query(
    "sosfilt_zi",
    f"""WITH {LONG}, {_SECTIONS}, d AS (SELECT *, (b0 + b1 + b2) / (a0 + a1 + a2) AS dc FROM s),
 g AS (SELECT *, coalesce(product(dc) OVER (ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS gain FROM d)
 SELECT signal_id, CAST(section AS BIGINT) AS section, round(v * gain * (b1 / a0 - a1 / a0 * dc + b2 / a0 - a2 / a0 * dc), 5) + 0.0 AS z0, round(v * gain * (b2 / a0 - a2 / a0 * dc), 5) + 0.0 AS z1 FROM g, l WHERE n = 0""",
)(lambda spark, folder: K.apply(wide(spark, folder), lambda y: dsp.sosfilt_zi(SOS) * y[0], ("y",), "frames").select("signal_id", F.col("t").alias("section"), r(F.col("f")[0], 5).alias("z0"), r(F.col("f")[1], 5).alias("z1")))

query("fill_off_diagonal", f"WITH {COUNTED}, t AS (SELECT signal_id, (size - 16) // 4 + 1 AS size FROM c) SELECT signal_id, CAST(t AS BIGINT) AS t, [CASE WHEN k = t THEN 1.0 ELSE -1.0 END::DOUBLE FOR k IN range(size)] AS f FROM (SELECT *, unnest(range(size)) AS t FROM t WHERE size >= 5) q")(
    lambda spark, folder: K.fill_off_diagonal(K.to_matrix(K.recurrence_matrix(matrices(spark, folder), k=3, mode="affinity", self_=True, skip=True)), value=-1.0)
)


# names and scales of each part's size


def parts(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("long").alias("x"))


PARTS = "(SELECT p_partkey, CAST(p_size AS BIGINT) AS x FROM part)"


def _pick(of: Column, names) -> Column:
    """The name at a place; names: a list."""
    return F.element_at(F.array(*map(F.lit, names)), (of + 1).cast("int"))


def _looked_up(made: dict, kind: T.DataType, of: Column) -> Column:
    """A small fixed table as a Column."""
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    pairs = [x for k, v in made.items() for x in (F.lit(k), lit(v))]
    return F.create_map(*pairs)[of].cast(kind)


_INTS, _STRINGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
KEYS = [f"{n}:{m}" for n in ("C", "G", "F", "Eb", "F#") for m in ("maj", "min", "dor")]
RATIOS = (1.0, 1.5, 5 / 4, 6 / 5, 7 / 4, 11 / 8, 16 / 9)
THAATS = notation.list_thaat()
_THAAT_SQL = "(VALUES " + ", ".join(f"({k}, '{t}', {notation.thaat_to_degrees(t)})" for k, t in enumerate(THAATS)) + ") h(k, thaat, degrees)"
_thaat = lambda: _pick(F.col("x") % len(THAATS), THAATS)
_key = lambda: _pick(F.col("x") % len(KEYS), KEYS)
_ratio = lambda: _pick(F.col("x") % len(RATIOS), RATIOS)
_mela = lambda: (F.col("x") % 72 + 1).cast("int")
_MELA = "CAST(x % 72 + 1 AS INTEGER)"


def _named(name: str, column: str, key, value, sql: str | None) -> None:
    query(name, sql)(lambda spark, folder: parts(spark, folder).select("p_partkey", key().alias(column), value()))


_named("thaat_to_degrees", "thaat", _thaat, lambda: _looked_up({t: notation.thaat_to_degrees(t) for t in THAATS}, _INTS, _thaat()).alias("degrees"), f"SELECT p_partkey, thaat, [CAST(d AS INTEGER) FOR d IN degrees] AS degrees FROM {PARTS} p JOIN {_THAAT_SQL} ON k = x % {len(THAATS)}")
_named(
    "mela_to_degrees", "mela", _mela, lambda: _looked_up({m: notation.mela_to_degrees(m) for m in range(1, 73)}, _INTS, _mela()).alias("degrees"),
    f"""SELECT p_partkey, m AS mela, [CAST(x AS INTEGER) FOR x IN [0, CASE WHEN b < 3 THEN 1 WHEN b < 5 THEN 2 ELSE 3 END, CASE b WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 4 END, CASE WHEN m <= 36 THEN 5 ELSE 6 END, 7,
 CASE WHEN u < 3 THEN 8 WHEN u < 5 THEN 9 ELSE 10 END, CASE u WHEN 0 THEN 9 WHEN 1 THEN 10 WHEN 2 THEN 11 WHEN 3 THEN 10 ELSE 11 END]] AS degrees FROM (SELECT p_partkey, m, (m - 1) % 36 // 6 AS b, (m - 1) % 6 AS u FROM (SELECT p_partkey, {_MELA} AS m FROM {PARTS} p))""",
)
_named(
    "mela_to_svara", "mela", _mela, lambda: _looked_up({m: notation.mela_to_svara(m, unicode=False) for m in range(1, 73)}, _STRINGS, _mela()).alias("svara"),
    f"""SELECT p_partkey, m AS mela, ['S', 'R1', CASE WHEN b > 0 THEN 'R2' ELSE 'G1' END, CASE WHEN b = 5 THEN 'R3' ELSE 'G2' END, 'G3', 'M1', 'M2', 'P', 'D1', CASE WHEN u > 0 THEN 'D2' ELSE 'N1' END, CASE WHEN u = 5 THEN 'D3' ELSE 'N2' END, 'N3'] AS svara
 FROM (SELECT p_partkey, m, (m - 1) % 36 // 6 AS b, (m - 1) % 6 AS u FROM (SELECT p_partkey, {_MELA} AS m FROM {PARTS} p))""",
)
_named(
    "key_to_degrees", "key", _key, lambda: _looked_up({k: notation.key_to_degrees(k) for k in KEYS}, _INTS, _key()).alias("degrees"),
    f"""SELECT p_partkey, tonic || ':' || mode AS key, [CAST((d + semitone) % 12 AS INTEGER) FOR d IN steps] AS degrees FROM {PARTS} p JOIN (VALUES (0, 'C', 0), (1, 'G', 7), (2, 'F', 5), (3, 'Eb', 3), (4, 'F#', 6)) a(i, tonic, semitone) ON i = x % 15 // 3
 JOIN (VALUES (0, 'maj', [0, 2, 4, 5, 7, 9, 11]), (1, 'min', [0, 2, 3, 5, 7, 8, 10]), (2, 'dor', [0, 2, 3, 5, 7, 9, 10])) b(j, mode, steps) ON j = x % 3""",
)
_named("key_to_notes", "key", _key, lambda: _looked_up({k: notation.key_to_notes(k) for k in KEYS}, _STRINGS, _key()).alias("notes"), None)
_named("fifths_to_note", "fifths", lambda: (F.col("x") % 31 - 15).cast("int"), lambda: _looked_up({k: notation.fifths_to_note("C", k, unicode=False) for k in range(-15, 16)}, T.StringType(), (F.col("x") % 31 - 15).cast("int")).alias("note"), "SELECT p_partkey, CAST(k AS INTEGER) AS fifths, list_extract(['F','C','G','D','A','E','B'], (k + 1 + 70) % 7 + 1) || CASE WHEN k + 1 >= 7 THEN repeat('#', CAST((k + 1) // 7 AS INTEGER)) WHEN k + 1 < 0 THEN repeat('b', CAST(-floor((k + 1) / 7.0) AS INTEGER)) ELSE '' END AS note FROM (SELECT p_partkey, x % 31 - 15 AS k FROM " + PARTS + " p)")
_named("interval_to_fjs", "ratio", _ratio, lambda: _looked_up({x: notation.interval_to_fjs(x) for x in RATIOS}, T.StringType(), _ratio()).alias("name"), f"SELECT p_partkey, ratio, name FROM {PARTS} p JOIN (VALUES (0, 1.0::DOUBLE, 'C'), (1, 1.5::DOUBLE, 'G'), (2, 1.25::DOUBLE, 'E⁵'), (3, 1.2::DOUBLE, 'E♭₅'), (4, 1.75::DOUBLE, 'B♭⁷'), (5, 1.375::DOUBLE, 'F¹¹'), (6, 16 / 9::DOUBLE, 'B♭')) q(k, ratio, name) ON k = x % 7")
_HZ = (1.0, 3 / 2, 5 / 4, 7 / 5)
_named("hz_to_fjs", "hz", lambda: 440.0 * _pick(F.col("x") % 4, _HZ), lambda: _looked_up({k: notation.interval_to_fjs(x, "A") for k, x in enumerate(_HZ)}, T.StringType(), (F.col("x") % 4).cast("int")).alias("name"), f"SELECT p_partkey, hz, name FROM {PARTS} p JOIN (VALUES (0, 440.0::DOUBLE, 'A'), (1, 660.0::DOUBLE, 'E'), (2, 550.0::DOUBLE, 'C♯⁵'), (3, 616.0::DOUBLE, 'D♯⁷₅')) q(k, hz, name) ON k = x % 4")
_WINDOWS = ("bartlett", "boxcar", "hamming", "hann")
_named("window_bandwidth", "name", lambda: _pick(F.col("x") % 4, _WINDOWS), lambda: _looked_up({w: banks.window_bandwidth(w) for w in _WINDOWS}, T.DoubleType(), _pick(F.col("x") % 4, _WINDOWS)).alias("bandwidth"), f"SELECT p_partkey, name, bandwidth FROM {PARTS} p JOIN (VALUES (3, 'hann', 1.50018310546875::DOUBLE), (2, 'hamming', 1.3629455320350348::DOUBLE), (0, 'bartlett', 1.3334961334912805::DOUBLE), (1, 'boxcar', 1.0::DOUBLE)) q(k, name, bandwidth) ON k = x % 4")


@query("list_thaat", f"SELECT p_partkey, thaat FROM {PARTS} p JOIN {_THAAT_SQL} ON list_contains(degrees, x % 12)")
def list_thaat(spark, folder):
    """The thaats that hold the pitch class of each part's size."""
    names = F.filter(F.array(*map(F.lit, THAATS)), lambda t: F.array_contains(_looked_up({t: notation.thaat_to_degrees(t) for t in THAATS}, _INTS, t), (F.col("x") % 12).cast("int")))
    return parts(spark, folder).select("p_partkey", F.explode(names).alias("thaat"))


@query("list_mela")
def list_mela(spark, folder):
    """Names and numbers of the melakartas that hold the pitch class of each supplier's number."""
    own = F.array(*(F.struct(F.lit(name).alias("mela"), F.lit(k).alias("number"), F.array(*map(F.lit, notation.mela_to_degrees(k))).alias("degrees")) for name, k in notation.list_mela().items()))
    rows = table(spark, folder, "supplier").select("s_suppkey", F.explode(own).alias("m"))
    return rows.where(F.array_contains("m.degrees", (F.col("s_suppkey") % 12).cast("int"))).select("s_suppkey", "m.mela", "m.number")


@query("plimit_intervals", f"SELECT p_partkey, k, round(x * f, 6) + 0.0 AS f FROM {PARTS} p, (SELECT row_number() OVER (ORDER BY f) - 1 AS k, f FROM (VALUES (1.0::DOUBLE), (16 / 15.0), (9 / 8.0), (6 / 5.0), (5 / 4.0), (4 / 3.0), (45 / 32.0), (3 / 2.0), (8 / 5.0), (5 / 3.0), (9 / 5.0), (15 / 8.0)) q(f))")
def plimit_intervals(spark, folder):
    """Twelve just frequencies above each part's size."""
    steps = F.array(*map(F.lit, banks.plimit_intervals([3, 5]).tolist()))
    rows = parts(spark, folder).select("p_partkey", "x", F.posexplode(steps).alias("k", "f"))
    return rows.select("p_partkey", F.col("k").cast("long").alias("k"), r(F.col("x") * F.col("f")).alias("f"))


@query("chirp", f"SELECT p_partkey, i AS n, round(cos(2 * pi() * 2 / ln((2.0 + x) / 2) * (exp(ln((2.0 + x) / 2) * i / 64) - 1) - pi() / 2), 6) + 0.0 AS v FROM {PARTS} p, range(64) q(i)")
def chirp(spark, folder):
    """A second from 2 Hz to that and each part's size."""
    y = S.chirp(2.0, F.lit(2.0) + F.col("x"), 64.0, 64)
    return parts(spark, folder).select("p_partkey", F.posexplode(y).alias("n", "v")).select("p_partkey", F.col("n").cast("long").alias("n"), r("v").alias("v"))

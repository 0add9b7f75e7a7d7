"""SQL of queries whose operator is a kernel. Each states the definition itself; frames come as lists."""

from __future__ import annotations

import math

from wavetide.kernels import dsp
from wavetide.plans import banks

from .base import COUNTED, HOP, LONG, N, SPECTRUM, SR, values

ROUND = "round({}, 5) + 0.0"
MAG = SPECTRUM + ", mg AS (SELECT signal_id, t, k, sqrt(p) AS v FROM p)"


def frames(of: str, value: str = "v", index: str = "k") -> str:
    """Rows signal_id, t, f of a table signal_id, t, index, value."""
    return f"SELECT signal_id, t, list({ROUND.format(value)} ORDER BY {index}) AS f FROM {of} GROUP BY 1, 2"


def signal(of: str, value: str = "v", index: str = "n") -> str:
    return f"SELECT signal_id, list({ROUND.format(value)} ORDER BY {index}) AS y FROM {of} GROUP BY 1"


SQL: dict[str, str] = {}

SQL["istft"] = f"""WITH {SPECTRUM}, x AS (SELECT signal_id, t, i, 0.5 - 0.5 * cos(2 * pi() * i / {N}) AS w,
 sum(CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * i / {N}) - im * sin(2 * pi() * k * i / {N}))) / {N} AS x FROM z, range({N}) q(i) GROUP BY signal_id, t, i),
 y AS (SELECT signal_id, t * {HOP} + i AS n, sum(w * x) AS s, sum(w * w) AS p FROM x GROUP BY 1, 2),
 o AS (SELECT signal_id, n, CASE WHEN p > 1e-300 THEN s / p ELSE s END AS v FROM y) {signal("o")}"""

SQL["phase_vocoder"] = f"""WITH {SPECTRUM}, a AS (SELECT signal_id, t, k, sqrt(p) AS m, atan2(im, re) AS phi FROM z JOIN p USING (signal_id, t, k)),
 ends AS (SELECT signal_id, max(t) AS last FROM a GROUP BY 1),
 s AS (SELECT signal_id, u, least(CAST(floor(u * 1.5) AS BIGINT), last) AS lo, least(CAST(floor(u * 1.5) AS BIGINT) + 1, last) AS hi, u * 1.5 - floor(u * 1.5) AS part FROM ends, range((SELECT max(last) + 1 FROM ends)) q(u) WHERE u < ceil((last + 1) / 1.5)),
 g AS (SELECT s.signal_id, u, x.k, (1 - part) * x.m + part * y.m AS m, pi() * {HOP} * x.k / {N // 2} AS step, (y.phi - x.phi - pi() * {HOP} * x.k / {N // 2} + pi()) % (2 * pi()) - pi() AS turn
  FROM s JOIN a x ON x.signal_id = s.signal_id AND x.t = lo JOIN a y ON y.signal_id = s.signal_id AND y.t = hi AND y.k = x.k),
 f AS (SELECT g.signal_id, u AS t, g.k, g.m, a.phi + coalesce(sum(step + turn) OVER (PARTITION BY g.signal_id, g.k ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS phase FROM g JOIN a ON a.signal_id = g.signal_id AND a.k = g.k AND a.t = 0)
 SELECT signal_id, t, list(round(m * cos(phase), 5) + 0.0 ORDER BY k) AS re, list(round(m * sin(phase), 5) + 0.0 ORDER BY k) AS im FROM f GROUP BY 1, 2"""

_T = 0.4 * SR / HOP
_B = (math.sqrt(1 + 4 * _T * _T) - 1) / (2 * _T * _T)
SQL["pcen_kernel"] = f"""WITH RECURSIVE {MAG}, e AS (SELECT signal_id, k, t, {_B!r} * v + (1 - {_B!r}) AS s FROM mg WHERE t = 0 UNION ALL SELECT mg.signal_id, mg.k, mg.t, {_B!r} * mg.v + (1 - {_B!r}) * e.s FROM mg JOIN e ON mg.signal_id = e.signal_id AND mg.k = e.k AND mg.t = e.t + 1),
 o AS (SELECT signal_id, t, k, sqrt(2) * (sqrt(1 + v * exp(-0.98 * (ln(1e-6) + ln(1 + s / 1e-6))) / 2) - 1) AS v FROM mg JOIN e USING (signal_id, k, t)) {frames("o")}"""

SQL["clicks_frames"] = f"""WITH {LONG}, p AS (SELECT signal_id, n * 4 AS p FROM l WHERE n % 7 = 3), c AS (SELECT signal_id, max(p) + 7 AS size FROM p GROUP BY 1),
 k AS (SELECT signal_id, p + i AS n, pow(1 - i / 6.0, 2) * sin(2 * pi() * 10 * i / 64) AS v FROM p, range(7) q(i)),
 o AS (SELECT c.signal_id, m AS n, coalesce(sum(k.v), 0) AS v FROM c JOIN range((SELECT max(size) FROM c)) q(m) ON m < size LEFT JOIN k ON k.signal_id = c.signal_id AND k.n = m GROUP BY 1, 2) {signal("o")}"""

_SOS = dsp.elliptic_bandpass(0.2, 0.4, 1.0, 40.0, 2).tolist()


def _section(source: str, x: str, j: int) -> str:
    """source with the output o{j} of section j for the input x, and the section's next state."""
    b0, b1, b2, a0, a1, a2 = (repr(float(c)) for c in _SOS[j])
    step = f"SELECT *, {b0} * {x} / {a0} + p{j} AS o{j} FROM ({source})"
    return f"SELECT * EXCLUDE (p{j}, q{j}), ({b1} * {x} - {a1} * o{j}) / {a0} + q{j} AS p{j}, ({b2} * {x} - {a2} * o{j}) / {a0} AS q{j} FROM ({step})"


_STATE = "p0, q0, p1, q1"
_STEP = _section(_section("SELECT s.signal_id, l.n, l.v AS x, p0, q0, p1, q1 FROM s JOIN l ON l.signal_id = s.signal_id AND l.n = s.n + 1", "x", 0), "o0", 1)
if len(_SOS) == 2:
    SQL["sosfilt"] = f"""WITH RECURSIVE {LONG}, s(signal_id, n, v, {_STATE}) AS (SELECT DISTINCT signal_id, -1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM l
     UNION ALL SELECT signal_id, n, o1, {_STATE} FROM ({_STEP})), o AS (SELECT * FROM s WHERE n >= 0) {signal("o")}"""

SQL["delta_interp"] = f"""WITH {MAG}, sz AS (SELECT signal_id, max(t) + 1 AS size FROM mg GROUP BY 1),
 o AS (SELECT a.signal_id, a.t, a.k, sum(i * b.v) / 10 AS v FROM mg a JOIN sz ON sz.signal_id = a.signal_id, range(-2, 3) q(i), mg b WHERE b.signal_id = a.signal_id AND b.k = a.k AND b.t = greatest(2, least(size - 3, a.t)) + i GROUP BY 1, 2, 3) {frames("o")}"""

_HARMONIC = "SELECT signal_id, t, k, v FROM mg UNION ALL SELECT a.signal_id, a.t, a.k + 9, coalesce(b.v, 0) FROM mg a LEFT JOIN mg b ON b.signal_id = a.signal_id AND b.t = a.t AND b.k = 2 * a.k"
SQL["interp_harmonics"] = f"WITH {MAG}, o AS ({_HARMONIC}) {frames('o')}"
SQL["salience"] = f"""WITH {MAG}, h AS ({_HARMONIC}), s AS (SELECT signal_id, t, k % 9 AS k, avg(v) AS v FROM h GROUP BY 1, 2, 3), x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM s WINDOW w AS (PARTITION BY signal_id, t ORDER BY k)),
 o AS (SELECT signal_id, t, k, CASE WHEN v > a AND (b IS NULL OR v >= b) THEN v ELSE 0 END AS v FROM x) {frames("o")}"""
SQL["f0_harmonics"] = f"""WITH {MAG}, x AS (SELECT signal_id, t, h AS k, 5.0 * h / 4 AS pos FROM (SELECT DISTINCT signal_id, t FROM mg), range(1, 4) q(h)),
 o AS (SELECT x.signal_id, x.t, x.k, a.v + (pos - floor(pos)) * (b.v - a.v) AS v FROM x JOIN mg a ON a.signal_id = x.signal_id AND a.t = x.t AND a.k = floor(pos) JOIN mg b ON b.signal_id = x.signal_id AND b.t = x.t AND b.k = floor(pos) + 1) {frames("o")}"""


def tempogram(win: int, norm: bool = True) -> str:
    """tg: local autocorrelation of the signal, ramped at both ends; signal_id, t, k, v."""
    half = win // 2
    top = "CASE WHEN max(abs(r)) OVER w < 1e-300 THEN 1 ELSE max(abs(r)) OVER w END"
    return f"""{COUNTED}, e AS (SELECT signal_id, n + {half} AS n, v FROM l UNION ALL SELECT signal_id, i, v * i / {half} FROM l, range({half}) q(i) WHERE n = 0
  UNION ALL SELECT l.signal_id, size + {half} + i, v * ({half} - i) / {half} FROM l JOIN c ON c.signal_id = l.signal_id AND n = size - 1, range({half}) q(i)),
 fx AS (SELECT c.signal_id, t, i, e.v * (0.5 - 0.5 * cos(2 * pi() * i / {win})) AS x FROM c, range((SELECT max(size) FROM c)) q(t), range({win}) u(i), e WHERE t < size AND e.signal_id = c.signal_id AND e.n = t + i),
 ac AS (SELECT a.signal_id, a.t, b.i - a.i AS k, sum(a.x * b.x) AS r FROM fx a JOIN fx b ON a.signal_id = b.signal_id AND a.t = b.t AND b.i >= a.i GROUP BY 1, 2, 3),
 tg AS (SELECT signal_id, t, k, r / {top} AS v FROM ac WINDOW w AS (PARTITION BY signal_id, t))"""


def scores(of: str) -> str:
    """sc: signal_id, t, k, bpm, score, of rows signal_id, t, k, v."""
    return f"""sc AS (SELECT signal_id, t, k, 60 * {SR} / ({HOP} * k) AS bpm, ln(1 + 1e6 * v) - 0.5 * pow(log2(60 * {SR} / ({HOP} * k)) - log2(120), 2) AS score FROM {of} WHERE k > 0 AND 60 * {SR} / ({HOP} * k) <= 320),
 top AS (SELECT signal_id, t, arg_max(bpm, (score, -k)) AS bpm FROM sc GROUP BY 1, 2)"""


SQL["tempogram"] = f"WITH {tempogram(32)} {frames('tg')}"
SQL["tempo_frames"] = f"WITH {tempogram(32)}, {scores('tg')} SELECT signal_id, t, {ROUND.format('bpm')} AS v FROM top"
SQL["tempo"] = f"WITH {tempogram(32)}, m AS (SELECT signal_id, 0 AS t, k, avg(v) AS v FROM tg GROUP BY 1, 3), {scores('m')} SELECT signal_id, {ROUND.format('bpm')} AS value FROM top"
SQL["fourier_tempogram"] = f"""WITH {COUNTED}, f AS (SELECT c.signal_id, t, i, coalesce(l.v, 0) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS x FROM c JOIN range((SELECT max(size) + 1 FROM c)) q(t) ON t <= size, range(16) u(i) LEFT JOIN l ON l.signal_id = c.signal_id AND l.n = t + i - 8),
 z AS (SELECT signal_id, t, k, sum(x * cos(2 * pi() * k * i / 16)) AS re, -sum(x * sin(2 * pi() * k * i / 16)) AS im FROM f, range(9) q(k) GROUP BY 1, 2, 3)
 SELECT signal_id, t, list(round(re, 5) + 0.0 ORDER BY k) AS re, list(round(im, 5) + 0.0 ORDER BY k) AS im FROM z GROUP BY 1, 2"""


def near(name: str, a: str, n: str) -> str:
    """SQL for the mirrored place of a in 0 to n - 1."""
    return f"{name} = CASE WHEN {a} < 0 THEN least(-({a}), {n} - 1) WHEN {a} >= {n} THEN greatest(0, 2 * ({n}) - 2 - ({a})) ELSE {a} END"


SQL["median_filter_2d"] = f"""WITH {MAG}, sz AS (SELECT signal_id, max(t) + 1 AS size FROM mg GROUP BY 1),
 o AS (SELECT a.signal_id, a.t, a.k, median(b.v) AS v FROM mg a JOIN sz ON sz.signal_id = a.signal_id, range(-1, 2) q(i), range(-1, 2) u(j), mg b WHERE b.signal_id = a.signal_id AND {near("b.t", "a.t + i", "size")} AND {near("b.k", "a.k + j", "9")} GROUP BY 1, 2, 3) {frames("o")}"""

_RS = "r AS (SELECT signal_id, (t + size - 3) % size AS t, k, v FROM mg JOIN (SELECT signal_id, max(t) + 1 AS size FROM mg GROUP BY 1) USING (signal_id))"
_PAIRS = "d AS (SELECT a.signal_id, a.t AS i, b.t AS j, sqrt(sum(pow(a.v - b.v, 2))) AS d FROM mg a JOIN {0} b ON a.signal_id = b.signal_id AND a.k = b.k GROUP BY 1, 2, 3)"
SQL["cross_similarity_sparse"] = f"""WITH {MAG}, sz AS (SELECT signal_id, max(t) + 1 AS size FROM mg GROUP BY 1), r AS (SELECT signal_id, CASE WHEN size > 3 THEN (t + size - 3) % size ELSE t END AS t, k, v FROM mg JOIN sz USING (signal_id)),
 {_PAIRS.format("r")}, x AS (SELECT *, row_number() OVER (PARTITION BY signal_id, i ORDER BY d, j) AS rank FROM d)
 SELECT signal_id, j AS i, i AS j, {ROUND.format("d")} AS w FROM x WHERE rank <= 2 AND d > 0"""
SQL["recurrence_matrix_sparse"] = f"""WITH {MAG}, sz AS (SELECT signal_id, max(t) + 1 AS size FROM mg GROUP BY 1), {_PAIRS.format("mg")},
 x AS (SELECT *, row_number() OVER (PARTITION BY signal_id, i ORDER BY d, j) AS rank FROM d), e AS (SELECT x.signal_id, i, j FROM x JOIN sz USING (signal_id) WHERE rank <= least(size - 1, 5) AND i <> j AND (size - 1) // 2 > 1),
 f AS (SELECT *, row_number() OVER (PARTITION BY signal_id, i ORDER BY j) AS nth FROM e), g AS (SELECT * FROM f WHERE nth <= 3)
 SELECT a.signal_id, a.j AS i, a.i AS j, 1.0::DOUBLE AS w FROM g a JOIN g b ON a.signal_id = b.signal_id AND a.i = b.j AND a.j = b.i"""

#: Shares of three bands: signal_id, t, a list of three.
_STATES = MAG + """, bs AS (SELECT signal_id, t, CAST(k // 3 AS BIGINT) AS b, sum(v) AS v FROM mg GROUP BY 1, 2, 3), sh AS (SELECT signal_id, t, b, v / sum(v) OVER (PARTITION BY signal_id, t) AS v FROM bs),
 pr AS (SELECT signal_id, t, list(v ORDER BY b) AS p FROM sh GROUP BY 1, 2)"""
_TINY = "2.2250738585072014e-308"


def viterbi(prob: list[str], trans: list[list[float]], key: str = "signal_id") -> str:
    """vt: for each step and state, value and the path so far (the first of equal ones). prob: a term of each state over pr's p."""
    n = len(trans)
    first = ", ".join(f"ln({1 / n!r}) + ln({p} + {_TINY})" for p in prob)
    ways = lambda j: [f"s.v[{i + 1}] + {math.log(trans[i][j])!r}" for i in range(n)]
    best = lambda j: f"list_position([{', '.join(ways(j))}], greatest({', '.join(ways(j))}))"
    steps = ", ".join(f"greatest({', '.join(ways(j))}) + ln({p} + {_TINY})" for j, p in enumerate(prob))
    paths = ", ".join(f"list_append(s.path[{best(j)}], {j})" for j in range(n))
    return f"""vt({key}, t, v, path) AS (SELECT {key}, t, [{first}], [{", ".join(f"[{j}]" for j in range(n))}] FROM pr WHERE t = 0
 UNION ALL SELECT s.{key}, pr.t, [{steps}], [{paths}] FROM vt s JOIN pr ON pr.{key} = s.{key} AND pr.t = s.t + 1),
 en AS (SELECT {key}, arg_max(v, t) AS v, arg_max(path, t) AS path FROM vt GROUP BY 1), be AS (SELECT {key}, list_max(v) AS logp, path[list_position(v, list_max(v))] AS path FROM en)"""


_LOOP3 = [[0.8 if i == j else 0.1 for j in range(3)] for i in range(3)]
_LOOP2 = [[0.9 if i == j else 0.1 for j in range(2)] for i in range(2)]
_P3 = ["p[1]", "p[2]", "p[3]"]
_PATH = "SELECT signal_id, CAST(u.t - 1 AS BIGINT) AS event_no, CAST(path[u.t] AS BIGINT) AS frame FROM be, (SELECT unnest(range(1, 10001)) AS t) u WHERE u.t <= len(path)"
SQL["viterbi"] = f"WITH RECURSIVE {_STATES}, {viterbi(_P3, _LOOP3)} {_PATH}"
SQL["viterbi_with_logp"] = f"WITH RECURSIVE {_STATES}, {viterbi(_P3, _LOOP3)} SELECT signal_id, {ROUND.format('logp')} AS value FROM be"
SQL["viterbi_discriminative"] = f"WITH RECURSIVE {_STATES}, {viterbi([f'{p} / (1 / 3.0)' for p in _P3], _LOOP3)} {_PATH}"
_BINARY = _STATES.replace("pr AS (SELECT signal_id, t, list(v ORDER BY b) AS p FROM sh GROUP BY 1, 2)", "pr AS (SELECT signal_id * 3 + b AS row, t, v AS p FROM sh)")
_TWO = viterbi(["(1 - p) / 0.5", "p / 0.5"], _LOOP2, "row")
SQL["viterbi_binary"] = f"WITH RECURSIVE {_BINARY}, {_TWO} SELECT CAST(row // 3 AS BIGINT) AS signal_id, CAST(row % 3 AS BIGINT) AS t, [CAST(x AS DOUBLE) FOR x IN path] AS f FROM be"
SQL["viterbi_binary_with_logp"] = f"WITH RECURSIVE {_BINARY}, {_TWO} SELECT CAST(row // 3 AS BIGINT) AS signal_id, CAST(row % 3 AS BIGINT) AS t, {ROUND.format('logp')} AS v FROM be"

#: Accumulated costs cell by cell, row after row; c holds all costs so far and w the step into each cell.
_DTW = f"""{MAG}, sz AS (SELECT signal_id, max(t) + 1 AS size FROM mg GROUP BY 1), r AS (SELECT signal_id, CASE WHEN size > 3 THEN (t + size - 3) % size ELSE t END AS t, k, v FROM mg JOIN sz USING (signal_id)),
 {_PAIRS.format("r")}, dd AS (SELECT signal_id, any_value(size) AS m, list(d ORDER BY i, j) AS d FROM d JOIN sz USING (signal_id) GROUP BY 1),
 a(signal_id, m, d, pos, c, w) AS (SELECT signal_id, m, d, 1, [d[1]], [0] FROM dd UNION ALL SELECT signal_id, m, d, pos + 1, list_append(c, d[pos + 1] + best),
   list_append(w, CASE WHEN up IS NULL THEN 1 WHEN before IS NULL THEN 2 WHEN diag = best THEN 0 WHEN before = best THEN 1 ELSE 2 END)
  FROM (SELECT *, least(coalesce(diag, 1e300), coalesce(before, 1e300), coalesce(up, 1e300)) AS best FROM (SELECT *, CASE WHEN pos % m > 0 AND pos > m THEN c[pos - m] END AS diag, CASE WHEN pos % m > 0 THEN c[pos] END AS before, CASE WHEN pos >= m THEN c[pos + 1 - m] END AS up FROM a WHERE pos < len(d)))),
 al AS (SELECT signal_id, m, c, w FROM a WHERE pos = len(d))"""
SQL["dtw"] = f"WITH RECURSIVE {_DTW} SELECT signal_id, t, list_transform(c[CAST(t * m + 1 AS BIGINT) : CAST(t * m + m AS BIGINT)], lambda x: round(x, 5) + 0.0) AS f FROM al JOIN range((SELECT max(size) FROM sz)) q(t) ON t < m"
SQL["dtw_backtrack"] = f"""WITH RECURSIVE {_DTW}, b(signal_id, m, w, step, i, j) AS (SELECT signal_id, m, w, 0, m - 1, m - 1 FROM al UNION ALL
 SELECT signal_id, m, w, step + 1, CASE WHEN w[CAST(i * m + j + 1 AS BIGINT)] <> 1 THEN i - 1 ELSE i END, CASE WHEN w[CAST(i * m + j + 1 AS BIGINT)] <> 2 THEN j - 1 ELSE j END FROM b WHERE i > 0 OR j > 0)
 SELECT signal_id, CAST(step AS BIGINT) AS step, i, j FROM b"""
SQL["dtw_backtracking"] = SQL["dtw_backtrack"]
SQL["axis_sort_with_index"] = f"""WITH {MAG}, a AS (SELECT signal_id, k, arg_max(t, (v, -t)) AS peak FROM mg GROUP BY 1, 2)
 SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY peak, k) - 1 AS event_no, k AS frame FROM a"""
SQL["spectral_contrast_kernel"] = f"""WITH {MAG}, {values("bands", "b, lo, hi", [(0, 0, 0), (1, 0, 1), (2, 1, 8)])}, e AS (SELECT signal_id, t, b, 10 * log10(greatest(1e-10, max(v))) AS hi, 10 * log10(greatest(1e-10, min(v))) AS lo FROM mg JOIN bands ON k BETWEEN bands.lo AND bands.hi GROUP BY 1, 2, 3),
 o AS (SELECT signal_id, t, b AS k, greatest(hi, max(hi) OVER w - 80) - greatest(lo, max(lo) OVER w - 80) AS v FROM e WINDOW w AS (PARTITION BY signal_id)) {frames("o")}"""
SQL["hpss_complex"] = f"""WITH {SPECTRUM}, {{mirror}}, o AS (SELECT signal_id, t, k, re * h * h / (h * h + q * q) AS a_re, im * h * h / (h * h + q * q) AS a_im, re * q * q / (h * h + q * q) AS b_re, im * q * q / (h * h + q * q) AS b_im FROM h JOIN q USING (signal_id, t, k) JOIN z USING (signal_id, t, k))
 SELECT signal_id, t, """ + ", ".join(f"list({ROUND.format(c)} ORDER BY k) AS {c}" for c in ("a_re", "a_im", "b_re", "b_im")) + " FROM o GROUP BY 1, 2"

_PCM = "greatest(-32768, least(32767, round_even(v / 128.0 * 32768, 0))) / 32768"
SQL["buf_to_float"] = f"WITH {LONG}, o AS (SELECT signal_id, n, {_PCM} AS v FROM l) {signal('o')}"
SQL["load"] = f"WITH {LONG}, o AS (SELECT signal_id, n, {_PCM} AS v FROM l) SELECT signal_id || '.wav' AS name, 64.0::DOUBLE AS sr, 1::BIGINT AS channels, list({ROUND.format('v')} ORDER BY n) AS y FROM o GROUP BY signal_id"
SQL["get_audio_info"] = f"WITH {COUNTED} SELECT signal_id || '.wav' AS name, 64.0::DOUBLE AS sr, 1::BIGINT AS channels, size AS n, size / 64.0 AS duration FROM c"
SQL["get_samplerate"] = f"WITH {COUNTED} SELECT signal_id || '.wav' AS name, 64.0::DOUBLE AS sr FROM c"


SQL["lpc"] = f"""WITH RECURSIVE {LONG}, s AS (SELECT signal_id, list(v ORDER BY n) AS y FROM l GROUP BY 1),
 r(signal_id, i, a, f, b, den) AS (SELECT signal_id, 0, [1.0::DOUBLE], y[2:len(y)], y[1:len(y) - 1], list_dot_product(y[2:len(y)], y[2:len(y)]) + list_dot_product(y[1:len(y) - 1], y[1:len(y) - 1]) FROM s
  UNION ALL SELECT signal_id, i + 1, list_transform(range(1, len(a) + 2), lambda j: coalesce(a[j], 0) + k * coalesce(a[len(a) + 2 - j], 0)), f2[2:len(f2)], b2[1:len(b2) - 1], (1 - k * k) * den - pow(b2[len(b2)], 2) - pow(f2[1], 2)
  FROM (SELECT *, list_transform(range(1, len(f) + 1), lambda j: f[j] + k * b[j]) AS f2, list_transform(range(1, len(f) + 1), lambda j: b[j] + k * f[j]) AS b2
   FROM (SELECT *, -2 * list_dot_product(b, f) / (den + {_TINY}) AS k FROM r WHERE i < 4)))
 SELECT signal_id, list_transform(a, lambda x: round(x, 5) + 0.0) AS y FROM r WHERE i = 4"""

SQL["onset_detect_envelope"] = f"""WITH RECURSIVE {LONG}, e AS (SELECT signal_id, n, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + {_TINY}) AS v FROM l WINDOW w AS (PARTITION BY signal_id)),
 p AS (SELECT signal_id, n, v, max(v) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS top, avg(v) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS mean FROM e),
 c AS (SELECT signal_id, list(n ORDER BY n) AS c FROM p WHERE v = top AND v >= mean + 0.07 GROUP BY 1),
 g(signal_id, c, event_no, frame) AS (SELECT signal_id, c, 0, c[1] FROM c UNION ALL SELECT signal_id, c, event_no + 1, list_filter(c, lambda x: x > frame + 1)[1] FROM g WHERE len(list_filter(c, lambda x: x > frame + 1)) > 0)
 SELECT signal_id, CAST(event_no AS BIGINT) AS event_no, CAST(frame AS BIGINT) AS frame FROM g"""

_RATIOS = [4, 8 / 3, 3, 2, 4 / 3, 3 / 2, 1, 2 / 3, 3 / 4, 1 / 2, 1 / 3, 3 / 8, 1 / 4]
_BEAT = 60 * SR / HOP
SQL["tempogram_ratio"] = f"""WITH {tempogram(32)}, {scores('tg')}, {values("q", "k, ratio", [(k, float(x)) for k, x in enumerate(_RATIOS)])},
 x AS (SELECT signal_id, t, q.k, bpm * ratio AS hz, {_BEAT} / (bpm * ratio) AS lag FROM top, q),
 o AS (SELECT x.signal_id, x.t, x.k, CASE WHEN lag < 1 - 1e-9 OR lag > 31 + 1e-9 THEN 0 WHEN a.k = b.k THEN a.v ELSE a.v + (hz - {_BEAT} / a.k) / ({_BEAT} / b.k - {_BEAT} / a.k) * (b.v - a.v) END AS v
  FROM x JOIN tg a ON a.signal_id = x.signal_id AND a.t = x.t AND a.k = greatest(1, least(31, ceil(lag - 1e-9))) JOIN tg b ON b.signal_id = x.signal_id AND b.t = x.t AND b.k = greatest(1, least(31, floor(lag + 1e-9)))) {frames("o")}"""

SQL["match_intervals_kernel"] = f"""WITH {COUNTED}, s AS (SELECT signal_id, k, 12 * k AS a, 12 * k + 10 AS b FROM c, range((SELECT max(size) FROM c)) q(k) WHERE 12 * k <= size - 12), g AS (SELECT signal_id, k, 12 * k + 2 AS a, 12 * k + 11 AS b FROM c, range((SELECT max(size) FROM c)) q(k) WHERE 12 * k + 2 <= size - 12),
 x AS (SELECT s.signal_id, s.k AS event_no, g.k AS frame, least(s.b, g.b) - greatest(s.a, g.a) AS both_, greatest(s.b, g.b) - least(s.a, g.a) AS span, g.a > s.b AS behind FROM s JOIN g USING (signal_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, event_no ORDER BY both_ >= 0 DESC, CASE WHEN both_ >= 0 THEN both_ / CAST(span AS DOUBLE) END DESC, both_ DESC, behind, frame) AS rank FROM x)
 SELECT signal_id, event_no, frame FROM r WHERE rank = 1"""

SQL["resample_fft"] = f"""WITH {COUNTED}, z AS (SELECT l.signal_id, k, CAST(ceil(size * 0.75) AS BIGINT) AS m, size, sum(v * cos(2 * pi() * k * n / size)) AS re, -sum(v * sin(2 * pi() * k * n / size)) AS im FROM l JOIN c USING (signal_id), range((SELECT max(size) FROM c)) q(k) WHERE k <= ceil(size * 0.75) // 2 GROUP BY ALL),
 o AS (SELECT signal_id, i AS n, sum(CASE WHEN k = 0 OR 2 * k = m THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * i / m) - im * sin(2 * pi() * k * i / m))) / any_value(size) AS v FROM z, range((SELECT max(size) FROM c)) q(i) WHERE i < m GROUP BY 1, 2) {signal("o")}"""

SQL["reassigned_spectrogram"] = f"""WITH {COUNTED}, fr AS (SELECT l.signal_id, CAST((n - i) / {HOP} AS BIGINT) AS t, i, v FROM l JOIN c USING (signal_id), range({N}) q(i) WHERE n >= i AND (n - i) % {HOP} = 0 AND n - i + {N} <= size),
 w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / {N}) AS w, (0.5 - 0.5 * cos(2 * pi() * (i + 1) / {N}) - 0.5 + 0.5 * cos(2 * pi() * (i - 1) / {N})) / 2 AS s FROM range({N}) q(i)),
 z AS (SELECT signal_id, t, k, sum(v * w * cos(a)) AS re, -sum(v * w * sin(a)) AS im, sum(v * s * cos(a)) AS sr, -sum(v * s * sin(a)) AS si, sum(v * w * (i - {N // 2}) * cos(a)) AS tr, -sum(v * w * (i - {N // 2}) * sin(a)) AS ti
  FROM (SELECT *, 2 * pi() * k * i / {N} AS a FROM fr JOIN w USING (i), range({N // 2 + 1}) q(k)) GROUP BY 1, 2, 3),
 x AS (SELECT z.signal_id, t, k, size, sqrt(re * re + im * im) AS m, k * {SR / N} AS f0, (t * {HOP} + {N // 2}) / {SR} AS t0, (si * re - sr * im) / (re * re + im * im) AS df, (tr * re + ti * im) / (re * re + im * im) AS dt FROM z JOIN c USING (signal_id)),
 o AS (SELECT signal_id, t, k, m, greatest(0, least({SR / 2}, CASE WHEN m < 1e-3 THEN f0 ELSE f0 - df * {SR} / (2 * pi()) END)) AS f, greatest(0, least(size / {SR}, CASE WHEN m < 1e-3 THEN t0 ELSE t0 + dt / {SR} END)) AS s FROM x)
 SELECT signal_id, t, {", ".join(f"list({ROUND.format(c)} ORDER BY k) AS {name}" for c, name in (("f", "a"), ("s", "b"), ("m", "c")))} FROM o GROUP BY 1, 2"""

SQL["mfcc_to_mel"] = "WITH {db}, w AS (SELECT q, m, cos(pi() * q * (2 * m + 1) / 12) * CASE WHEN q = 0 THEN sqrt(1 / 6.0) ELSE sqrt(2 / 6.0) END AS w FROM range(4) a(q), range(6) b(m)), cp AS (SELECT signal_id, t, q, sum(d * w) AS c FROM mtop JOIN w USING (m) GROUP BY 1, 2, 3), o AS (SELECT signal_id, t, m AS k, pow(10, sum(c * w) / 10) AS v FROM cp JOIN w USING (q) GROUP BY 1, 2, 3) " + frames("o")


#: The weekly prices of each nation's orders as signals: signal_id, n, v, and the number of weeks.
WEEKLY = """dw AS (SELECT CAST(c_nationkey AS BIGINT) AS signal_id, date_trunc('week', o_orderdate) AS week, sum(CAST(o_totalprice AS DOUBLE)) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
 dl AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY week) - 1 AS n, v / 1e6 AS v FROM dw), dz AS (SELECT signal_id, count(*) AS size FROM dl GROUP BY 1)"""
SQL["yin"] = f"""WITH {WEEKLY}, fx AS (SELECT dz.signal_id, t, i, coalesce(dl.v, 0) AS x FROM (SELECT signal_id, unnest(range(size // 32 + 1)) AS t FROM dz) dz JOIN range(128) u(i) ON true LEFT JOIN dl ON dl.signal_id = dz.signal_id AND dl.n = t * 32 + i - 64),
 ac AS (SELECT a.signal_id, a.t, b.i - a.i AS k, sum(a.x * b.x) AS r FROM fx a JOIN fx b ON a.signal_id = b.signal_id AND a.t = b.t AND b.i - a.i BETWEEN 0 AND 32 GROUP BY 1, 2, 3),
 en AS (SELECT signal_id, t, i + 1 AS k, sum(x * x) OVER (PARTITION BY signal_id, t ORDER BY i) AS e FROM fx WHERE i < 32),
 d AS (SELECT a.signal_id, a.t, a.k, 2 * (z.r - a.r) - e AS d FROM ac a JOIN ac z ON z.signal_id = a.signal_id AND z.t = a.t AND z.k = 0 JOIN en ON en.signal_id = a.signal_id AND en.t = a.t AND en.k = a.k WHERE a.k > 0),
 c AS (SELECT signal_id, t, k, d / (avg(d) OVER (PARTITION BY signal_id, t ORDER BY k) + {_TINY}) AS x FROM d), w AS (SELECT * FROM c WHERE k >= 4),
 n AS (SELECT *, lag(x) OVER p AS a, lead(x) OVER p AS b FROM w WINDOW p AS (PARTITION BY signal_id, t ORDER BY k)),
 s AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL OR abs((b - a) / 2) >= abs(b + a - 2 * x) THEN 0 ELSE -(b - a) / 2 / (b + a - 2 * x) END AS shift, b IS NOT NULL AND x < 0.1 AND (a IS NULL AND x < b OR x < a AND x <= b) AS low FROM n),
 o AS (SELECT *, row_number() OVER (PARTITION BY signal_id, t ORDER BY low DESC, CASE WHEN low THEN k ELSE 0 END, x, k) AS rank FROM s)
 SELECT signal_id, t, {ROUND.format("64 / (k + shift)")} AS v FROM o WHERE rank = 1"""

SQL["plp"] = f"""WITH {COUNTED}, f AS (SELECT c.signal_id, t, i, coalesce(l.v, 0) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS x FROM c JOIN range((SELECT max(size) + 1 FROM c)) q(t) ON t <= size, range(16) u(i) LEFT JOIN l ON l.signal_id = c.signal_id AND l.n = t + i - 8),
 z AS (SELECT signal_id, t, k, sum(x * cos(2 * pi() * k * i / 16)) AS re, -sum(x * sin(2 * pi() * k * i / 16)) AS im FROM f, range(1, 7) q(k) GROUP BY 1, 2, 3),
 p AS (SELECT *, sqrt(re * re + im * im) AS m, row_number() OVER (PARTITION BY signal_id, t ORDER BY ln(1 + 1e6 * sqrt(re * re + im * im)) DESC, k) AS rank FROM z),
 x AS (SELECT signal_id, t + i - 8 AS n, 0.5 - 0.5 * cos(2 * pi() * i / 16) AS w, 2 / 16.0 * (re * cos(2 * pi() * k * i / 16) - im * sin(2 * pi() * k * i / 16)) / (sqrt({_TINY}) + m) AS v FROM p, range(16) q(i) WHERE rank = 1),
 y AS (SELECT x.signal_id, n, greatest(0, sum(w * v) / sum(w * w)) AS v FROM x JOIN c USING (signal_id) WHERE n BETWEEN 0 AND size - 1 GROUP BY 1, 2)
 SELECT signal_id, n AS t, {ROUND.format("v / CASE WHEN max(v) OVER (PARTITION BY signal_id) < 1e-300 THEN 1 ELSE max(v) OVER (PARTITION BY signal_id) END")} AS v FROM y"""

#: A frame's lags back to the beat before, and their costs, at 120 beats a minute (8 frames a beat).
_BACK = "list_transform(range(4, least(16, i) + 1), lambda g: value[i - g + 1] - 100 * pow(ln(g) - ln(8), 2))"
SQL["beat_track"] = f"""WITH RECURSIVE {LONG}, x AS (SELECT signal_id, n, v / (stddev_samp(v) OVER (PARTITION BY signal_id) + {_TINY}) AS v FROM l),
 lo AS (SELECT a.signal_id, a.n, sum(b.v * exp(-0.5 * pow((a.n - b.n) * 32 / 8.0, 2))) AS v FROM x a JOIN x b ON a.signal_id = b.signal_id AND abs(a.n - b.n) <= 8 GROUP BY 1, 2),
 s AS (SELECT signal_id, list(v ORDER BY n) AS local FROM lo GROUP BY 1),
 d(signal_id, local, i, value, back, begun) AS (SELECT signal_id, local, 0, CAST([] AS DOUBLE[]), CAST([] AS BIGINT[]), false FROM s
  UNION ALL SELECT signal_id, local, i + 1, list_append(value, local[i + 1] + coalesce(list_max(w), 0)), list_append(back, CASE WHEN now AND len(w) > 0 THEN i - (list_position(w, list_max(w)) + 3) ELSE -1 END), now
  FROM (SELECT *, {_BACK} AS w, begun OR local[i + 1] >= 0.01 * list_max(local) AS now FROM d WHERE i < len(local))),
 e AS (SELECT signal_id, local, value, back FROM d WHERE i = len(local)),
 p AS (SELECT *, list_filter(range(1, len(value)), lambda j: value[j + 1] > value[j] AND (j = len(value) - 1 OR value[j + 1] >= value[j + 2])) AS peaks FROM e),
 h AS (SELECT *, list_filter(peaks, lambda j: value[j + 1] >= 0.5 * list_median(list_transform(peaks, lambda q: value[q + 1]))) AS high FROM p),
 t(signal_id, local, back, beats) AS (SELECT signal_id, local, back, [coalesce(high[len(high)], len(value) - 1)] FROM h
  UNION ALL SELECT signal_id, local, back, list_prepend(back[beats[1] + 1], beats) FROM t WHERE back[beats[1] + 1] >= 0),
 b AS (SELECT signal_id, local, arg_max(beats, len(beats)) AS beats FROM t GROUP BY 1, 2),
 m AS (SELECT *, list_concat(list_transform(range(1, len(beats) + 1), lambda j: local[beats[j] + 1] + 0.5 * coalesce(CASE WHEN j > 1 THEN local[beats[j - 1] + 1] END, 0) + 0.5 * coalesce(CASE WHEN j < len(beats) THEN local[beats[j + 1] + 1] END, 0)), [0.5 * local[beats[len(beats)] + 1], 0]) AS smooth FROM b),
 g AS (SELECT *, list_filter(range(0, len(local)), lambda j: local[j + 1] > 0.5 * sqrt(list_avg(list_transform(smooth, lambda q: q * q)))) AS loud FROM m),
 r AS (SELECT signal_id, list_filter(beats, lambda j: j BETWEEN loud[1] AND loud[len(loud)]) AS beats FROM g)
 SELECT signal_id, 120.0::DOUBLE AS bpm, u.k AS event_no, CAST(beats[u.k + 1] AS BIGINT) AS frame FROM r JOIN range((SELECT max(len(beats)) FROM r)) u(k) ON u.k < len(beats)"""

SQL["remix"] = f"""WITH {COUNTED}, y AS (SELECT signal_id, list(CASE WHEN abs(v) <= 1e-10 THEN 0 ELSE v END ORDER BY n) AS z, list(v ORDER BY n) AS y FROM l GROUP BY 1),
 s AS (SELECT *, list_append(list_filter(range(0, len(y)), lambda j: j = 0 OR (z[j + 1] < 0) <> (z[j] < 0)), len(y)) AS zeros FROM y),
 i AS (SELECT s.signal_id, k, y, list_transform([12 * k, 12 * k + 10], lambda p: zeros[list_position(list_transform(zeros, lambda z: abs(z - p)), list_min(list_transform(zeros, lambda z: abs(z - p))))]) AS cut FROM s JOIN range((SELECT max(len(y)) FROM s)) q(k) ON 12 * k <= len(y) - 12),
 p AS (SELECT signal_id, k, CASE WHEN cut[2] > cut[1] THEN y[cut[1] + 1 : cut[2]] ELSE CAST([] AS DOUBLE[]) END AS part FROM i)
 SELECT signal_id, list_transform(flatten(list(part ORDER BY k)), lambda x: round(x, 5) + 0.0) AS y FROM p GROUP BY 1"""


def onset(aggregate: str) -> str:
    """l: the onset envelopes of the weekly signals as signals of their own, with centred frames and six mel bands."""
    bank = banks.mel(SR, N, 6)
    weights = values("e0", "m, k, w", [(m, k, float(bank[m, k])) for m in range(6) for k in range(N // 2 + 1) if bank[m, k]])
    return f"""{WEEKLY}, {weights}, e1 AS (SELECT dz.signal_id, t, i, coalesce(dl.v, 0) * (0.5 - 0.5 * cos(2 * pi() * i / {N})) AS x FROM (SELECT signal_id, unnest(range(size // {HOP} + 1)) AS t FROM dz) dz JOIN range({N}) u(i) ON true LEFT JOIN dl ON dl.signal_id = dz.signal_id AND dl.n = t * {HOP} + i - {N // 2}),
 e2 AS (SELECT signal_id, t, k, pow(sum(x * cos(2 * pi() * k * i / {N})), 2) + pow(sum(x * sin(2 * pi() * k * i / {N})), 2) AS p FROM e1, range({N // 2 + 1}) q(k) GROUP BY 1, 2, 3),
 e3 AS (SELECT signal_id, t, m, 10 * log10(greatest(1e-10, sum(p * w))) AS d FROM e2 JOIN e0 USING (k) GROUP BY 1, 2, 3), e4 AS (SELECT signal_id, t, m, greatest(d, max(d) OVER (PARTITION BY signal_id) - 80) AS d FROM e3),
 e5 AS (SELECT signal_id, t + {N // (2 * HOP)} AS t, greatest(0, d - lag(d) OVER (PARTITION BY signal_id, m ORDER BY t)) AS rise FROM e4), e6 AS (SELECT signal_id, t, {aggregate}(rise) AS v FROM e5 WHERE rise IS NOT NULL GROUP BY 1, 2),
 l AS (SELECT g.signal_id, CAST(g.t AS INTEGER) AS n, coalesce(e6.v, 0) AS v FROM (SELECT DISTINCT signal_id, t FROM e4) g LEFT JOIN e6 ON e6.signal_id = g.signal_id AND e6.t = g.t)"""


_MEAN = f"{onset('avg')}, c AS (SELECT signal_id, count(*) AS size FROM l GROUP BY 1)"
SQL["tempogram_audio"] = SQL["tempogram"].replace(COUNTED, _MEAN)
SQL["fourier_tempogram_audio"] = SQL["fourier_tempogram"].replace(COUNTED, _MEAN)
SQL["plp_audio"] = SQL["plp"].replace(COUNTED, _MEAN)
SQL["tempo_audio"] = f"WITH {tempogram(64)}, m AS (SELECT signal_id, 0 AS t, k, avg(v) AS v FROM tg GROUP BY 1, 3), {scores('m')} SELECT signal_id, {ROUND.format('bpm')} AS value FROM top".replace(COUNTED, _MEAN)
SQL["beat_track_audio"] = SQL["beat_track"].replace(LONG, onset("median"))
SQL["beat_track_times"] = f"SELECT signal_id, event_no, round(frame * {HOP / SR}, 6) + 0.0 AS time FROM ({SQL['beat_track_audio']})"
SQL["onset_detect"] = f"""WITH {onset("avg")}, x AS (SELECT signal_id, n, (v - min(v) OVER s) / (max(v) OVER s - min(v) OVER s + {_TINY}) AS v FROM l WINDOW s AS (PARTITION BY signal_id)),
 m AS (SELECT *, avg(v) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mean FROM x) SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY n) - 1 AS event_no, CAST(n AS BIGINT) AS frame FROM m WHERE v >= mean + 0.07"""
SQL["onset_detect_times"] = f"SELECT signal_id, event_no, round(frame * {HOP / SR}, 6) + 0.0 AS time FROM ({SQL['onset_detect']})"

_COSINE = "dots AS (SELECT a.signal_id, a.t, b.t AS u, sum(a.v * b.v) AS d FROM mg a JOIN mg b ON a.signal_id = b.signal_id AND a.k = b.k GROUP BY 1, 2, 3)"
SQL["nn_filter_median"] = f"""WITH {SPECTRUM}, mg AS (SELECT signal_id, t, k, sqrt(p) AS v FROM p), {_COSINE}, sz AS (SELECT signal_id, max(t) + 1 AS n FROM mg GROUP BY 1),
 s AS (SELECT x.signal_id, x.t, x.u, row_number() OVER (PARTITION BY x.signal_id, x.t ORDER BY round(x.d / sqrt(y.d * z.d), 13) DESC, x.u) AS rank FROM dots x JOIN dots y ON y.signal_id = x.signal_id AND y.t = x.t AND y.u = x.t
  JOIN dots z ON z.signal_id = x.signal_id AND z.t = x.u AND z.u = x.u JOIN sz ON sz.signal_id = x.signal_id WHERE abs(x.t - x.u) > 1 OR n <= 3)
 SELECT s.signal_id, s.t, list(r ORDER BY k) AS f FROM (SELECT s.signal_id, s.t, k, round(median(v), 5) + 0.0 AS r FROM s JOIN mg ON mg.signal_id = s.signal_id AND mg.t = s.u WHERE rank <= 4 GROUP BY 1, 2, 3) s GROUP BY 1, 2"""



def _rest() -> list[float]:
    """Memories of both sections in which a constant one stays constant."""
    out, gain = [], 1.0
    for b0, b1, b2, a0, a1, a2 in _SOS:
        dc = (b0 + b1 + b2) / (a0 + a1 + a2)
        second = (b2 - a2 * dc) / a0
        out += [gain * ((b1 - a1 * dc) / a0 + second), gain * second]
        gain *= dc
    return out


def _run(name: str, source: str) -> str:
    """name: source (signal_id, n, v) through both sections, from rest at its first value."""
    step = _section(_section(f"SELECT s.signal_id, l.n, l.v AS x, p0, q0, p1, q1 FROM {name} s JOIN {source} l ON l.signal_id = s.signal_id AND l.n = s.n + 1", "x", 0), "o0", 1)
    start = ", ".join(f"{z!r} * v" for z in _rest())
    return f"{name}(signal_id, n, v, {_STATE}) AS (SELECT signal_id, CAST(-1 AS BIGINT), 0.0::DOUBLE, {start} FROM {source} WHERE n = 0 UNION ALL SELECT signal_id, CAST(n AS BIGINT), o1, {_STATE} FROM ({step}))"


if len(_SOS) == 2:
    SQL["sosfiltfilt"] = f"""WITH RECURSIVE {COUNTED}, ends AS (SELECT c.signal_id, size, a.v AS first, b.v AS last FROM c JOIN l a ON a.signal_id = c.signal_id AND a.n = 0 JOIN l b ON b.signal_id = c.signal_id AND b.n = size - 1),
     x AS (SELECT l.signal_id, CAST(l.n + 9 AS BIGINT) AS n, v FROM l UNION ALL SELECT l.signal_id, 9 - l.n, 2 * first - v FROM l JOIN ends USING (signal_id) WHERE l.n BETWEEN 1 AND 9
      UNION ALL SELECT l.signal_id, 2 * size + 7 - l.n, 2 * last - v FROM l JOIN ends USING (signal_id) WHERE l.n BETWEEN size - 10 AND size - 2),
     {_run("f", "x")}, y AS (SELECT f.signal_id, size + 17 - n AS n, v FROM f JOIN c USING (signal_id) WHERE n >= 0), {_run("g", "y")},
     o AS (SELECT g.signal_id, size + 8 - n AS n, v FROM g JOIN c USING (signal_id) WHERE n BETWEEN 9 AND size + 8) {signal("o")}"""


def _part(mask: str) -> str:
    """The signal that a soft mask of its centred spectrum leaves."""
    return f"""WITH {COUNTED}, fx AS (SELECT c.signal_id, t, i, coalesce(l.v, 0) * (0.5 - 0.5 * cos(2 * pi() * i / {N})) AS x FROM c JOIN range((SELECT max(size) + 1 FROM c)) q(t) ON t <= size // {HOP}, range({N}) u(i) LEFT JOIN l ON l.signal_id = c.signal_id AND l.n = t * {HOP} + i - {N // 2}),
 z AS (SELECT signal_id, t, k, sum(x * cos(2 * pi() * k * i / {N})) AS re, -sum(x * sin(2 * pi() * k * i / {N})) AS im FROM fx, range({N // 2 + 1}) q(k) GROUP BY 1, 2, 3),
 p AS (SELECT signal_id, t, k, re * re + im * im AS p FROM z), {{mirror}},
 w AS (SELECT signal_id, t, k, CASE WHEN h = 0 AND q = 0 THEN 0.5 ELSE {mask} * {mask} / (h * h + q * q) END AS w FROM h JOIN q USING (signal_id, t, k)),
 v AS (SELECT signal_id, t, i, 0.5 - 0.5 * cos(2 * pi() * i / {N}) AS g, sum(CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END * w * (re * cos(2 * pi() * k * i / {N}) - im * sin(2 * pi() * k * i / {N}))) / {N} AS x FROM z JOIN w USING (signal_id, t, k), range({N}) u(i) GROUP BY signal_id, t, i),
 y AS (SELECT signal_id, t * {HOP} + i - {N // 2} AS n, sum(g * x) / sum(g * g) AS v FROM v GROUP BY 1, 2),
 o AS (SELECT l.signal_id, l.n, CASE WHEN l.n < size // {HOP} * {HOP} THEN y.v ELSE 0 END AS v FROM l JOIN c USING (signal_id) LEFT JOIN y ON y.signal_id = l.signal_id AND y.n = l.n) {signal("o")}"""


SQL["harmonic"], SQL["percussive"] = _part("h"), _part("q")

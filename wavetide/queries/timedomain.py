"""Queries over long and wide signals, arrays, events and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavetide.operators import signals as S

from .base import COUNTED, FRAMED, HOP, LONG, N, SR, WIDE, long, query, r, sql_round, table, wide

W_SQL = "(PARTITION BY signal_id ORDER BY n)"


@query("frame", f"WITH {FRAMED} SELECT signal_id, t, list(v ORDER BY i) AS f FROM fr GROUP BY 1, 2")
def frame(spark, folder):
    return S.frame(wide(spark, folder), N, HOP).select("signal_id", F.col("t").cast("long").alias("t"), "f")


@query("rms", f"WITH {FRAMED} SELECT signal_id, t, round(sqrt(avg(v * v)), 6) + 0.0 AS rms FROM fr GROUP BY 1, 2")
def rms(spark, folder):
    return S.rms(S.frame(wide(spark, folder), N, HOP)).select("signal_id", F.col("t").cast("long").alias("t"), r("rms").alias("rms"))


def _centred(df):
    return df.select("signal_id", F.transform("y", lambda x: x - F.aggregate("y", F.lit(0.0), lambda a, b: a + b) / F.size("y")).alias("y"))


@query("zero_crossing_rate", f"WITH {FRAMED}, m AS (SELECT signal_id, avg(v) AS mean FROM l GROUP BY 1), x AS (SELECT signal_id, t, i, v - mean < 0 AS neg FROM fr JOIN m USING (signal_id)), d AS (SELECT signal_id, t, CASE WHEN i > 0 AND neg != lag(neg) OVER (PARTITION BY signal_id, t ORDER BY i) THEN 1 ELSE 0 END AS c FROM x) SELECT signal_id, t, round(sum(c) / {N - 1}.0, 6) + 0.0 AS zcr FROM d GROUP BY 1, 2")
def zero_crossing_rate(spark, folder):
    return S.zero_crossing_rate(S.frame(_centred(wide(spark, folder)), N, HOP)).select("signal_id", F.col("t").cast("long").alias("t"), r("zcr").alias("zcr"))


@query("zero_crossings", f"WITH {LONG}, x AS (SELECT signal_id, n, v - 50 < 0 AS neg FROM l) SELECT signal_id, n, coalesce(neg != lag(neg) OVER {W_SQL}, true) AS crossing FROM x")
def zero_crossings(spark, folder):
    x = long(spark, folder)
    return S.zero_crossings(x.withColumn("v", F.col("v") - 50.0))


@query("preemphasis", f"WITH {LONG} SELECT signal_id, n, round(v - 0.97 * coalesce(lag(v) OVER {W_SQL}, 0), 6) + 0.0 AS v FROM l")
def preemphasis(spark, folder):
    return S.preemphasis(long(spark, folder)).select("signal_id", "n", r("v").alias("v"))


@query("deemphasis", f"WITH RECURSIVE {LONG}, d AS (SELECT signal_id, n, v FROM l WHERE n = 0 UNION ALL SELECT l.signal_id, l.n, l.v + 0.97 * d.v FROM l JOIN d ON l.signal_id = d.signal_id AND l.n = d.n + 1) SELECT signal_id, n, round(v, 6) + 0.0 AS v FROM d")
def deemphasis(spark, folder):
    return S.explode_signal(S.deemphasis(wide(spark, folder))).select("signal_id", "n", r("v").alias("v"))


for _name, _sign, _op in (("localmax", 1, ">"), ("localmin", -1, "<")):
    query(_name, f"WITH {LONG}, x AS (SELECT signal_id, n, v, lag(v) OVER {W_SQL} AS a, lead(v) OVER {W_SQL} AS b FROM l) SELECT signal_id, n, coalesce(v {_op} a AND (b IS NULL OR v {_op}= b), false) AS peak FROM x")(lambda spark, folder, sign=_sign: S.localmax(long(spark, folder), sign))


@query("peak_candidates", f"WITH {LONG}, x AS (SELECT signal_id, n, v, max(v) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS top, avg(v) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mean FROM l) SELECT signal_id, n FROM x WHERE v = top AND v >= mean + 1")
def peak_candidates(spark, folder):
    return S.peak_candidates(long(spark, folder), 3, 3, 4, 5, 1.0)


@query("peak_pick", f"WITH RECURSIVE {LONG}, x AS (SELECT signal_id, n, v, max(v) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS top, avg(v) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mean FROM l), c AS (SELECT signal_id, n FROM x WHERE v = top AND v >= mean + 1), p AS (SELECT signal_id, min(n) AS n FROM c GROUP BY 1 UNION ALL SELECT p.signal_id, (SELECT min(c.n) FROM c WHERE c.signal_id = p.signal_id AND c.n > p.n + 6) AS n FROM p WHERE p.n IS NOT NULL) SELECT signal_id, n FROM p WHERE n IS NOT NULL")
def peak_pick(spark, folder):
    return S.peak_pick(long(spark, folder), 3, 3, 4, 5, 1.0, 6)


@query("autocorrelate", f"WITH {LONG} SELECT a.signal_id, CAST(k AS INTEGER) AS lag, round(sum(a.v * b.v), 4) + 0.0 AS r FROM l a, range(8) q(k), l b WHERE b.signal_id = a.signal_id AND b.n = a.n + k GROUP BY 1, 2")
def autocorrelate(spark, folder):
    return S.autocorrelate(long(spark, folder), 8).select("signal_id", "lag", r("r", 4).alias("r"))


@query("cyclic_gradient", f"WITH {COUNTED} SELECT l.signal_id, l.n, round((b.v - a.v) / 2, 6) + 0.0 AS v FROM l JOIN c USING (signal_id) JOIN l a ON a.signal_id = l.signal_id AND a.n = (l.n + size - 1) % size JOIN l b ON b.signal_id = l.signal_id AND b.n = (l.n + 1) % size")
def cyclic_gradient(spark, folder):
    return S.cyclic_gradient(long(spark, folder)).select("signal_id", "n", r("v").alias("v"))


@query("stack_memory", f"WITH {LONG} SELECT signal_id, n, CAST(k AS INTEGER) AS step, CASE k WHEN 0 THEN v WHEN 1 THEN coalesce(a, 0) ELSE coalesce(b, 0) END AS v FROM (SELECT signal_id, n, v, lag(v, 2) OVER {W_SQL} AS a, lag(v, 4) OVER {W_SQL} AS b FROM l), range(3) q(k)")
def stack_memory(spark, folder):
    return S.stack_memory(long(spark, folder), 3, 2)


@query("delta", f"WITH {COUNTED}, w AS (SELECT l.signal_id, l.n, sum((x.n - l.n) * x.v) / 10 AS d FROM l JOIN c USING (signal_id) JOIN l x ON x.signal_id = l.signal_id AND x.n BETWEEN l.n - 2 AND l.n + 2 WHERE l.n BETWEEN 2 AND size - 3 GROUP BY 1, 2) SELECT signal_id, n, round(d, 6) + 0.0 AS delta FROM w")
def delta(spark, folder):
    """The slope of a line through five samples; inner samples only."""
    w = Window.partitionBy("signal_id").orderBy("n")
    slope = sum(k * F.lead("v", k).over(w) if k > 0 else k * F.lag("v", -k).over(w) for k in (-2, -1, 1, 2)) / 10.0
    return long(spark, folder).select("signal_id", "n", r(slope).alias("delta")).where("delta is not null")


for _how, _agg in (("mean", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("median", "list_extract(list(v ORDER BY v), CAST(count(*) // 2 AS BIGINT) + 1)")):
    query(f"sync_{_how}", f"WITH {LONG} SELECT signal_id, CAST(5 + 10 * ((n - 5) // 10) AS INTEGER) AS segment, round({_agg}, 6) + 0.0 AS v FROM l WHERE n >= 5 GROUP BY 1, 2")(
        lambda spark, folder, how=_how: S.sync(long(spark, folder), long(spark, folder).where("n % 10 = 5").select("signal_id", "n"), how).select("signal_id", "segment", r("v").alias("v"))
    )


@query("split", f"WITH {FRAMED}, p AS (SELECT signal_id, t, avg(v * v) AS p FROM fr GROUP BY 1, 2), o AS (SELECT signal_id, t, 10 * log10(greatest(1e-10, p)) - 10 * log10(greatest(1e-10, max(p) OVER (PARTITION BY signal_id))) > -2 AS live FROM p), g AS (SELECT signal_id, t, t - row_number() OVER (PARTITION BY signal_id ORDER BY t) AS island FROM o WHERE live) SELECT signal_id, min(t) * {HOP} AS start, (max(t) + 1) * {HOP} AS \"end\" FROM g GROUP BY signal_id, island")
def split(spark, folder):
    return S.split(S.frame(wide(spark, folder), N, HOP), 2.0, HOP)


@query("trim", f"WITH {FRAMED}, p AS (SELECT signal_id, t, avg(v * v) AS p FROM fr GROUP BY 1, 2), o AS (SELECT signal_id, t, 10 * log10(greatest(1e-10, p)) - 10 * log10(greatest(1e-10, max(p) OVER (PARTITION BY signal_id))) > -2 AS live FROM p) SELECT signal_id, min(t) * {HOP} AS start, (max(t) + 1) * {HOP} AS \"end\" FROM o WHERE live GROUP BY 1")
def trim(spark, folder):
    return S.trim(S.frame(wide(spark, folder), N, HOP), 2.0, HOP)


_EV = "e AS (SELECT signal_id, n FROM l WHERE n % 7 = 3)"


@query("onset_backtrack", f"WITH {LONG}, {_EV}, m AS (SELECT signal_id, n, n = 0 OR (v <= lag(v) OVER {W_SQL} AND v < lead(v) OVER {W_SQL}) AS low FROM l) SELECT e.signal_id, e.n, m.n AS start FROM e ASOF JOIN (SELECT * FROM m WHERE low) m ON e.signal_id = m.signal_id AND e.n >= m.n")
def onset_backtrack(spark, folder):
    x = long(spark, folder)
    return S.onset_backtrack(x.where("n % 7 = 3").select("signal_id", "n"), x)


@query("match_events", f"WITH {LONG}, {_EV}, g AS (SELECT signal_id, n AS m FROM l WHERE n % 11 = 5), x AS (SELECT e.signal_id, e.n, arg_min(m, abs(m - e.n) * 1000 - m) AS nearest FROM e JOIN g ON g.signal_id = e.signal_id GROUP BY 1, 2) SELECT * FROM x")
def match_events(spark, folder):
    x = long(spark, folder)
    return S.match_events(x.where("n % 7 = 3").select("signal_id", "n"), x.where("n % 11 = 5").select("signal_id", "n"))


@query("match_intervals", f"WITH {LONG}, a AS (SELECT signal_id, n AS interval_no, n AS s, n + 5 AS e FROM l WHERE n % 8 = 0), b AS (SELECT signal_id, n AS other, n AS s2, n + 7 AS e2 FROM l WHERE n % 9 = 0), x AS (SELECT a.signal_id, interval_no, other, (least(e, e2) - greatest(s, s2)) / CAST(greatest(e, e2) - least(s, s2) AS DOUBLE) AS score FROM a JOIN b ON a.signal_id = b.signal_id AND s2 <= e AND e2 >= s) SELECT signal_id, interval_no, CAST(arg_max(other, score * 1000000 - other) AS INTEGER) AS match FROM x GROUP BY 1, 2")
def match_intervals(spark, folder):
    x = long(spark, folder)
    a = x.where("n % 8 = 0").select("signal_id", F.col("n").alias("interval_no"), F.col("n").alias("start"), (F.col("n") + 5).alias("end"))
    b = x.where("n % 9 = 0").select("signal_id", F.col("n").alias("interval_no"), F.col("n").alias("start"), (F.col("n") + 7).alias("end"))
    return S.match_intervals(a, b)


# arrays


@query("pad_center", f"WITH {WIDE} SELECT signal_id, list_concat(list_concat([0.0 FOR i IN range((120 - len(y)) // 2)], y), [0.0 FOR i IN range(120 - len(y) - (120 - len(y)) // 2)]) AS y FROM s")
def pad_center(spark, folder):
    return wide(spark, folder).select("signal_id", S.pad_center("y", 120).alias("y"))


@query("fix_length", f"WITH {WIDE} SELECT signal_id, list_concat(y[1:70], [0.0 FOR i IN range(greatest(0, 70 - len(y)))]) AS y FROM s")
def fix_length(spark, folder):
    return wide(spark, folder).select("signal_id", S.fix_length("y", 70).alias("y"))


for _name, _norm, _sql in (("normalize_inf", float("inf"), "max(abs(v))"), ("normalize_l1", 1.0, "sum(abs(v))"), ("normalize_l2", 2.0, "sqrt(sum(v * v))"), ("normalize_min", float("-inf"), "min(abs(v))")):
    query(_name, f"WITH {LONG} SELECT signal_id, n, round(v / {_sql} OVER (PARTITION BY signal_id), 6) + 0.0 AS v FROM l".replace("sqrt(sum(v * v)) OVER (PARTITION BY signal_id)", "sqrt(sum(v * v) OVER (PARTITION BY signal_id))"))(
        lambda spark, folder, norm=_norm: S.explode_signal(wide(spark, folder).select("signal_id", S.over_norm("y", norm).alias("y"))).select("signal_id", "n", sql_round(F.col("v"), 6).alias("v"))
    )


@query("normalize", f"WITH {LONG} SELECT signal_id, n, round(v / sqrt(sum(v * v) OVER (PARTITION BY signal_id)) * 1.0, 6) + 0.0 AS v FROM l")
def normalize(spark, folder):
    """On long rows: a window instead of the array form."""
    size = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("signal_id")))
    return long(spark, folder).select("signal_id", "n", r(F.col("v") / size).alias("v"))


@query("valid_audio", f"WITH {WIDE} SELECT signal_id, len(y) > 0 AS valid FROM s")
def valid_audio(spark, folder):
    return wide(spark, folder).select("signal_id", S.valid_audio("y").alias("valid"))


@query("is_positive_int", "SELECT p_partkey, p_size - 25 > 0 AS positive FROM part")
def is_positive_int(spark, folder):
    return table(spark, folder, "part").select("p_partkey", S.is_positive_int(F.col("p_size") - 25).alias("positive"))


@query("valid_intervals", f"WITH {COUNTED} SELECT signal_id, bool_and(n <= n + 5) AS valid FROM l GROUP BY 1")
def valid_intervals(spark, folder):
    x = long(spark, folder).select("signal_id", F.col("n").alias("a"), (F.col("n") + 5).alias("b"))
    return x.groupBy("signal_id").agg(F.bool_and(S.valid_intervals("a", "b")).alias("valid"))


@query("is_unique", f"WITH {LONG} SELECT signal_id, count(*) = count(DISTINCT v) AS is_unique FROM l GROUP BY 1")
def is_unique(spark, folder):
    return long(spark, folder).groupBy("signal_id").agg((F.count("v") == F.count_distinct("v")).alias("is_unique"))


@query("count_unique", f"WITH {LONG} SELECT signal_id, count(DISTINCT floor(v)) AS n_unique FROM l GROUP BY 1")
def count_unique(spark, folder):
    return long(spark, folder).groupBy("signal_id").agg(F.count_distinct(F.floor("v")).alias("n_unique"))


@query("index_to_slice", "SELECT p_partkey, CASE WHEN p_size >= 3 THEN [CAST(x AS BIGINT) FOR x IN range(3, p_size + 1, 4)] ELSE [] END AS idx FROM part")
def index_to_slice(spark, folder):
    return table(spark, folder, "part").select("p_partkey", S.index_to_slice(F.col("p_size"), 3, None, 4).alias("idx"))


@query("samples_like", f"WITH {FRAMED} SELECT signal_id, t, CAST(t * {HOP} + {N // 2} AS BIGINT) AS sample FROM fr WHERE i = 0")
def samples_like(spark, folder):
    return S.frame(wide(spark, folder), N, HOP).select("signal_id", F.col("t").cast("long").alias("t"), (F.col("t") * HOP + N // 2).cast("long").alias("sample"))


@query("times_like", f"WITH {FRAMED} SELECT signal_id, t, t * {HOP} / {SR} AS time FROM fr WHERE i = 0")
def times_like(spark, folder):
    return S.frame(wide(spark, folder), N, HOP).select("signal_id", F.col("t").cast("long").alias("t"), (F.col("t") * HOP / F.lit(SR)).alias("time"))


@query("get_duration", f"WITH {COUNTED} SELECT signal_id, size / {SR} AS seconds FROM c")
def get_duration(spark, folder):
    return wide(spark, folder).select("signal_id", (F.size("y") / F.lit(SR)).alias("seconds"))


@query("to_mono", f"WITH {LONG} SELECT signal_id % 5 AS signal_id, n, round(avg(v), 6) + 0.0 AS v FROM l GROUP BY 1, 2")
def to_mono(spark, folder):
    """Channels (here: users of one remainder) averaged sample by sample."""
    return long(spark, folder).groupBy((F.col("signal_id") % 5).alias("signal_id"), "n").agg(r(F.avg("v")).alias("v"))


@query("shear", f"WITH {COUNTED} SELECT signal_id, CAST((n + signal_id) % size AS INTEGER) AS n, v FROM l JOIN c USING (signal_id)")
def shear(spark, folder):
    size = F.count(F.lit(1)).over(Window.partitionBy("signal_id"))
    return long(spark, folder).withColumn("size", size).select("signal_id", F.pmod(F.col("n") + F.col("signal_id"), F.col("size")).cast("int").alias("n"), "v")


@query("stack", f"WITH {LONG}, g AS (SELECT signal_id, CAST(n AS INTEGER) AS n FROM (SELECT DISTINCT signal_id FROM l), range((SELECT max(n) + 1 FROM l)) q(n)) SELECT n, list(v ORDER BY signal_id) AS v FROM g LEFT JOIN l USING (signal_id, n) GROUP BY n")
def stack(spark, folder):
    """Signals as columns of one matrix, row by row; a signal that has ended is null."""
    signals = wide(spark, folder)
    last = signals.agg((F.max(F.size("y")) - 1).alias("last"))
    y = F.transform(F.sequence(F.lit(0), "last"), lambda n: F.get("y", n))
    x = signals.crossJoin(F.broadcast(last)).select("signal_id", F.posexplode(y).alias("n", "v"))
    x = x.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("signal_id", "v"))).alias("x"))
    return x.select("n", F.transform("x", lambda p: p["v"]).alias("v"))


@query("axis_sort", f"WITH {LONG}, m AS (SELECT signal_id, arg_max(n, v * 1000 - n / 1000.0) AS peak FROM l GROUP BY 1) SELECT signal_id, row_number() OVER (ORDER BY peak, signal_id) - 1 AS place FROM m")
def axis_sort(spark, folder):
    """Signals in the order of their largest sample's place."""
    peak = long(spark, folder).groupBy("signal_id").agg(F.max_by("n", F.struct("v", -F.col("n"))).alias("peak"))
    first = peak.groupBy("peak").agg(F.count(F.lit(1)).alias("c"))
    first = first.select("peak", (F.sum("c").over(Window.orderBy("peak")) - F.col("c")).alias("start"))
    inner = F.row_number().over(Window.partitionBy("peak").orderBy("signal_id"))
    return peak.withColumn("inner", inner).join(first, "peak").select("signal_id", (F.col("start") + F.col("inner") - 1).cast("long").alias("place"))


@query("sparsify_rows", f"WITH {COUNTED}, k AS (SELECT signal_id, n, v, size, row_number() OVER (PARTITION BY signal_id ORDER BY v) - 1 AS rank FROM l JOIN c USING (signal_id)), g AS (SELECT signal_id, max(CASE WHEN rank = CAST(floor(0.3 * size) AS BIGINT) THEN v END) AS least FROM k GROUP BY 1) SELECT signal_id, n, CASE WHEN v < least THEN 0.0 ELSE v END AS v FROM l JOIN g USING (signal_id)")
def sparsify_rows(spark, folder):
    y = F.sort_array("y")
    least = F.element_at(y, (F.floor(F.lit(0.3) * F.size("y")) + 1).cast("int"))
    x = wide(spark, folder).withColumn("least", least)
    return S.explode_signal(x.select("signal_id", F.transform("y", lambda v: F.when(v < F.col("least"), 0.0).otherwise(v)).alias("y")))


@query("fix_frames", f"WITH {LONG} SELECT DISTINCT signal_id, greatest(4, least(30, n)) AS n FROM l WHERE n % 3 = 0 UNION SELECT DISTINCT signal_id, unnest([4, 30]) AS n FROM l")
def fix_frames(spark, folder):
    x = long(spark, folder)
    inside = x.where("n % 3 = 0").select("signal_id", F.greatest(F.lit(4), F.least(F.lit(30), "n")).alias("n"))
    ends = x.select("signal_id").distinct().select("signal_id", F.explode(F.array(F.lit(4), F.lit(30))).alias("n"))
    return inside.unionByName(ends).distinct()


@query("maximum_filter1d", f"WITH {LONG} SELECT signal_id, n, max(v) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM l")
def maximum_filter1d(spark, folder):
    return long(spark, folder).select("signal_id", "n", F.max("v").over(Window.partitionBy("signal_id").orderBy("n").rowsBetween(-2, 2)).alias("v"))


@query("median_filter", f"WITH {LONG} SELECT signal_id, n, median(v) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM l")
def median_filter(spark, folder):
    return long(spark, folder).select("signal_id", "n", F.percentile("v", F.lit(0.5)).over(Window.partitionBy("signal_id").orderBy("n").rowsBetween(-2, 2)).alias("v"))


@query("tone", "SELECT p_partkey, CAST(i AS INTEGER) AS n, round(cos(2 * pi() / 64 * p_size * i - pi() / 2), 6) + 0.0 AS v FROM part, range(16) q(i)")
def tone(spark, folder):
    x = table(spark, folder, "part").select("p_partkey", S.tone(F.col("p_size"), 64.0, 16).alias("y"))
    return x.select("p_partkey", F.posexplode("y").alias("n", "v")).select("p_partkey", "n", r("v").alias("v"))


@query("clicks", f"WITH {LONG}, t AS (SELECT signal_id, n / 8.0 AS time FROM l WHERE v > 80) SELECT signal_id, CAST(floor(time * 64) + i AS BIGINT) AS n, round(sum(pow(1 - i / 6.0, 2) * sin(2 * pi() * 10 / 64 * i)), 6) + 0.0 AS v FROM t, range(7) q(i) GROUP BY 1, 2")
def clicks(spark, folder):
    times = long(spark, folder).where("v > 80").select("signal_id", (F.col("n") / 8.0).alias("time"))
    return S.clicks(times, 64.0, 10.0, 0.1).select("signal_id", "n", r("v").alias("v"))

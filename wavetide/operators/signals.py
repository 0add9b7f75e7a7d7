"""Signals as tables: long (signal_id, n, v), wide (signal_id, y), frames (signal_id, t, f), and the relational operators.

Windows are partitioned by signal; nothing else is shuffled than what a signal's order needs. Array operators work on
wide rows and frames without any exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetide.functions import convert
from wavetide.plans import banks

KEY = "signal_id"


def long_signals(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(signal_id, n, v): values of each key, numbered from 0 in the given order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.select(F.col(key).alias(KEY), (F.row_number().over(w) - 1).alias("n"), F.col(value).cast("double").alias("v"))


def wide_signals(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return rows.groupBy(F.col(key).alias(KEY)).agg(F.transform(pairs, lambda p: p["v"]).alias("y"))


def explode_signal(wide: DataFrame, name: str = "v") -> DataFrame:
    return wide.select(KEY, F.posexplode("y").alias("n", name))


def _in_order(*more: str):
    return Window.partitionBy(KEY, *more).orderBy("n")


# arrays


def frame(wide: DataFrame, frame_length: int, hop_length: int) -> DataFrame:
    """(signal_id, t, f): windows of frame_length every hop_length samples; shorter signals give none."""
    if frame_length < 1 or hop_length < 1:
        raise ValueError("frame_length and hop_length must be positive")
    last = F.floor((F.size("y") - frame_length) / F.lit(hop_length)).cast("int")
    starts = F.when(F.size("y") >= frame_length, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    frames = F.transform(starts, lambda t: F.slice("y", t * hop_length + 1, frame_length))
    return wide.select(KEY, F.posexplode(frames).alias("t", "f"))


def pad_center(y, size: int, mode: str = "constant", value: float = 0.0) -> Column:
    """Constant and edge padding; reflect mirrors without the edge sample; other modes pad with the value."""
    y = F.col(y) if isinstance(y, str) else y
    n = F.size(y)
    left = F.floor((F.lit(size) - n) / 2).cast("int")
    right = F.lit(size) - n - left
    if mode == "edge":
        before, after = F.array_repeat(F.element_at(y, 1), left), F.array_repeat(F.element_at(y, -1), right)
    elif mode == "reflect":
        before = F.reverse(F.slice(y, 2, left))
        after = F.slice(F.reverse(y), 2, right)
    else:
        before, after = F.array_repeat(F.lit(float(value)), left), F.array_repeat(F.lit(float(value)), right)
    return F.when(n > size, F.raise_error(F.lit("the signal is longer than the target")).cast("array<double>")).otherwise(F.concat(before, y, after))


def fix_length(y, size: int) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return F.concat(F.slice(y, 1, size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(y))))


def norm_of(y: Column, norm: float) -> Column:
    size = F.transform(y, lambda x: F.abs(x))
    if norm == float("inf"):
        return F.array_max(size)
    if norm == float("-inf"):
        return F.array_min(size)
    if norm == 0:
        return F.aggregate(size, F.lit(0.0), lambda a, x: a + (x > 0).cast("double"))
    if norm < 0:
        raise ValueError("unsupported norm")
    return F.pow(F.aggregate(size, F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(float(norm)))), F.lit(1.0 / norm))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside the lambdas of array functions a column is else computed for each
    element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(y, norm: float | None = float("inf"), threshold: float | None = None, fill: bool | None = None) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    if norm is None:
        return y
    limit = banks.TINY if threshold is None else threshold

    def scaled(p: Column) -> Column:
        small, out = p["size"] < limit, F.transform(p["y"], lambda x: x / p["size"])
        if fill is None:
            return F.when(small, p["y"]).otherwise(out)
        even = F.lit(1.0) if abs(norm) == float("inf") else F.pow(F.size(p["y"]), F.lit(-1.0 / norm)) if norm else F.lit(0.0)
        return F.when(small, F.transform(p["y"], lambda _: even if fill else F.lit(0.0))).otherwise(out)

    return let(y, lambda v: let(F.struct(v.alias("y"), norm_of(v, norm).alias("size")), scaled))


def over_norm(y, norm: float) -> Column:
    """y divided by its norm as SQL does: by a norm of zero, other numbers become infinite and zeros NaN."""
    y = F.col(y) if isinstance(y, str) else y
    ratio = lambda x, size: F.when(size == 0, x * float("inf")).otherwise(x / size)
    return let(y, lambda v: let(F.struct(v.alias("y"), norm_of(v, norm).alias("size")), lambda p: F.transform(p["y"], lambda x: ratio(x, p["size"]))))


def valid_audio(y) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return (F.size(y) > 0) & F.forall(y, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def is_positive_int(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x) > 0


def valid_int(x, use_floor: bool = True) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x) if use_floor else F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def valid_intervals(start, end) -> Column:
    return F.col(start) <= F.col(end)


def index_to_slice(idx: Column, idx_min: int = 0, idx_max: int | None = None, step: int = 1, pad: bool = True) -> Column:
    top = idx if idx_max is None else F.least(idx, F.lit(idx_max)) if pad else idx
    return F.when(top >= idx_min, F.sequence(F.lit(idx_min).cast("long"), top.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))


def tone(frequency: Column, sr: float, length: int, phi: float | None = None) -> Column:
    step = 2.0 * 3.141592653589793 / sr
    shift = -3.141592653589793 / 2 if phi is None else phi
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.cos(step * frequency * i + shift))


def chirp(fmin, fmax, sr: float, length: int, linear: bool = False) -> Column:
    """fmin and fmax are numbers or Columns."""
    import math

    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (fmin, fmax))
    duration, shift = length / sr, -math.pi / 2
    if linear:
        phase = lambda t: 2 * math.pi * (low * t + (high - low) / (2 * duration) * t * t)
    else:
        phase = lambda t: 2 * math.pi * low * duration / F.log(high / low) * F.expm1(F.log(high / low) / duration * t)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.cos(phase(i / F.lit(float(sr))) + shift))


def clicks(times: DataFrame, sr: float, click_freq: float, click_duration: float, key: str = KEY) -> DataFrame:
    """(signal_id, n, v): a decaying click at each time; overlapping ones add."""
    import math

    n = math.ceil(sr * click_duration)
    i = F.col("i")
    size = 1.0 - i / F.lit(float(max(1, n - 1)))
    each = times.select(key, F.floor(F.col("time") * sr).alias("at"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return each.select(key, (F.col("at") + i).alias("n"), (size * size * F.sin(2 * math.pi * click_freq / sr * i)).alias("v")).groupBy(key, "n").agg(F.sum("v").alias("v"))


# long signals


def preemphasis(long: DataFrame, coef: float = 0.97) -> DataFrame:
    return long.select(KEY, "n", (F.col("v") - coef * F.coalesce(F.lag("v").over(_in_order()), F.lit(0.0))).alias("v"))


def zero_crossings(long: DataFrame, threshold: float = 1e-10, pad: bool = True, zero_pos: bool = True) -> DataFrame:
    v = F.when(F.abs("v") <= threshold, F.lit(0.0)).otherwise(F.col("v"))
    x = long.withColumn("s", (v < 0).cast("int") if zero_pos else F.signum(v))
    before = F.lag("s").over(_in_order())
    return x.select(KEY, "n", F.when(before.isNull(), F.lit(pad)).otherwise(F.col("s") != before).alias("crossing"))


def localmax(long: DataFrame, sign: int = 1) -> DataFrame:
    """sign -1: local minima. The first sample is none; the last one is compared with its left neighbour."""
    v, w = F.col("v") * sign, _in_order()
    left, right = F.lag("v").over(w) * sign, F.lead("v").over(w) * sign
    return long.select(KEY, "n", F.coalesce((v > left) & (right.isNull() | (v >= right)), F.lit(False)).alias("peak"))


def peak_candidates(long: DataFrame, pre_max: int, post_max: int, pre_avg: int, post_avg: int, delta: float) -> DataFrame:
    """Samples that are the largest of one window and exceed another's mean; peak_pick drops those within wait."""
    top = F.max("v").over(_in_order().rowsBetween(-pre_max, post_max - 1))
    mean = F.avg("v").over(_in_order().rowsBetween(-pre_avg, post_avg - 1))
    x = long.withColumn("top", top).withColumn("mean", mean)
    return x.where((F.col("v") == F.col("top")) & (F.col("v") >= F.col("mean") + delta)).select(KEY, "n")


def peak_pick(long: DataFrame, pre_max: int, post_max: int, pre_avg: int, post_avg: int, delta: float, wait: int) -> DataFrame:
    """Candidates from left to right, each more than wait after the one before; a fold over a signal's candidates."""
    found = peak_candidates(long, pre_max, post_max, pre_avg, post_avg, delta)
    at = found.groupBy(KEY).agg(F.sort_array(F.collect_list("n")).alias("at"))
    kept = F.aggregate("at", F.array().cast("array<int>"), lambda acc, n: F.when((F.size(acc) == 0) | (n > F.element_at(acc, -1) + wait), F.array_append(acc, n)).otherwise(acc))
    return at.select(KEY, F.explode(kept).alias("n"))


def autocorrelate(long: DataFrame, max_size: int) -> DataFrame:
    """Lags below max_size, by joining each sample with the ones a lag later."""
    a = long.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_size - 1)))).withColumn("m", F.col("n") + F.col("lag"))
    b = long.select(KEY, F.col("n").alias("m"), F.col("v").alias("u"))
    return a.join(b, [KEY, "m"]).groupBy(KEY, "lag").agg(F.sum(F.col("v") * F.col("u")).alias("r"))


def cyclic_gradient(long: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    side = lambda by, name: long.withColumn("size", n).select(KEY, F.pmod(F.col("n") + by, F.col("size")).cast("int").alias("n"), F.col("v").alias(name))
    return long.join(side(1, "before"), [KEY, "n"]).join(side(-1, "after"), [KEY, "n"]).select(KEY, "n", ((F.col("after") - F.col("before")) / 2.0).alias("v"))


def stack_memory(long: DataFrame, n_steps: int = 2, delay: int = 1) -> DataFrame:
    """step s holds the sample s * delay earlier, zero before the start."""
    w = _in_order()
    steps = F.array(*(F.struct(F.lit(s).alias("step"), F.coalesce((F.lag if delay > 0 else F.lead)("v", s * abs(delay)).over(w), F.lit(0.0)).alias("v")) for s in range(n_steps)))
    return long.withColumn("all", steps).select(KEY, "n", F.explode("all").alias("x")).select(KEY, "n", "x.step", "x.v")


def sync(long: DataFrame, bounds: DataFrame, aggregate: str = "mean") -> DataFrame:
    """Aggregates between boundaries (signal_id, n) by the last boundary before each sample; the median is the upper middle."""
    marks = bounds.select(KEY, "n", F.lit(None).cast("double").alias("v"), F.col("n").alias("start"))
    rows = long.select(KEY, "n", "v", F.lit(None).cast("int").alias("start")).unionByName(marks.withColumn("start", F.col("start").cast("int")))
    w = Window.partitionBy(KEY).orderBy("n", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("segment", F.last("start", ignorenulls=True).over(w)).where("v is not null and segment is not null")
    sorted_values = F.sort_array(F.collect_list("v"))
    how = {"mean": F.avg("v"), "min": F.min("v"), "max": F.max("v"), "median": F.element_at(sorted_values, (F.size(sorted_values) / 2).cast("int") + 1)}[aggregate]
    return rows.groupBy(KEY, "segment").agg(how.alias("v"))


def rms(frames: DataFrame) -> DataFrame:
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x)
    return frames.select(KEY, "t", F.sqrt(total / F.size("f")).alias("rms"))


def zero_crossing_rate(frames: DataFrame) -> DataFrame:
    """Crossings inside each frame over its length less one."""
    pairs = F.zip_with(F.slice("f", 1, F.size("f") - 1), F.slice("f", 2, F.size("f") - 1), lambda a, b: ((a < 0) != (b < 0)).cast("int"))
    return frames.select(KEY, "t", (F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / (F.size("f") - 1)).alias("zcr"))


def nonsilent(frames: DataFrame, top_db: float = 60.0) -> DataFrame:
    """Frames whose mean power is above -top_db of their signal's largest."""
    power = frames.select(KEY, "t", (F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x) / F.size("f")).alias("p"))
    top = F.max("p").over(Window.partitionBy(KEY))
    db = convert.power_to_db("p") - 10.0 * F.log10(F.greatest(F.lit(1e-10), top))
    return power.select(KEY, "t", (db > -top_db).alias("on"))


def split(frames: DataFrame, top_db: float, hop_length: int) -> DataFrame:
    """Runs of non-silent frames as [start, end) samples: gaps and islands."""
    on = nonsilent(frames, top_db).where("on")
    island = F.col("t") - F.row_number().over(Window.partitionBy(KEY).orderBy("t"))
    runs = on.withColumn("island", island).groupBy(KEY, "island").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return runs.select(KEY, (F.col("a") * hop_length).cast("long").alias("start"), ((F.col("b") + 1) * hop_length).cast("long").alias("end"))


def trim(frames: DataFrame, top_db: float, hop_length: int) -> DataFrame:
    on = nonsilent(frames, top_db).groupBy(KEY).agg(F.min(F.when(F.col("on"), F.col("t"))).alias("a"), F.max(F.when(F.col("on"), F.col("t"))).alias("b"))
    return on.select(KEY, F.coalesce(F.col("a") * hop_length, F.lit(0)).cast("long").alias("start"), F.coalesce((F.col("b") + 1) * hop_length, F.lit(0)).cast("long").alias("end"))


def deemphasis(wide: DataFrame, coef: float = 0.97) -> DataFrame:
    """The recursive inverse of preemphasis, as a fold over the array."""
    out = F.aggregate("y", F.array().cast("array<double>"), lambda acc, x: F.array_append(acc, x + coef * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))))
    return wide.select(KEY, out.alias("y"))


def onset_backtrack(events: DataFrame, energy: DataFrame) -> DataFrame:
    """Each event (signal_id, n) at the last local minimum of the energy at or before it."""
    w = _in_order()
    v = F.col("v")
    low = energy.select(KEY, "n", ((F.col("n") == 0) | (v <= F.lag("v").over(w)) & (v < F.lead("v").over(w))).alias("low")).where("low")
    marks = low.select(KEY, "n", F.col("n").alias("at"), F.lit(0).alias("kind"))
    rows = marks.unionByName(events.select(KEY, "n", F.lit(None).cast("int").alias("at"), F.lit(1).alias("kind")))
    seen = Window.partitionBy(KEY).orderBy("n", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", F.last("at", ignorenulls=True).over(seen)).where("kind = 1").select(KEY, "n", "start")


def match_events(source: DataFrame, target: DataFrame) -> DataFrame:
    """Nearest target (signal_id, n) of each source, of two as near the upper one; a union and two windows, no theta join."""
    rows = source.select(KEY, "n", F.lit(None).cast("int").alias("m")).unionByName(target.select(KEY, "n", F.col("n").cast("int").alias("m")))
    order = Window.partitionBy(KEY).orderBy("n", F.col("m").isNull())
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("below", F.last("m", ignorenulls=True).over(back)).withColumn("above", F.first("m", ignorenulls=True).over(ahead)).where("m is null")
    nearest = F.when(F.col("above").isNull() | (F.col("n") - F.col("below") < F.col("above") - F.col("n")), F.col("below")).otherwise(F.col("above"))
    return rows.select(KEY, "n", nearest.alias("nearest"))


def overlapping(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of intervals (signal_id, interval_no, start, end) of a signal that touch: those columns, and other, s2, e2.

    Intervals lie in a hierarchy of cells of 2^level. Each one has a level (-20 at least) at which it spans two cells, three at most; a pair
    meets at the larger level of both, so each interval names the cells of its own level for smaller ones, and those of all
    levels above for larger ones. That is an equi-join with a few rows for each interval and level; of the cells that a
    pair shares the one with the larger start counts.
    """
    keep = lambda df, *names: df.select(KEY, *(F.col(x).alias(y) for x, y in zip(("interval_no", "start", "end"), names)))
    level = lambda a, b: F.when(b > a, F.greatest(F.ceil(F.log2((b - a).cast("double"))), F.lit(-20))).otherwise(F.lit(-20)).cast("int")
    a = keep(source, "interval_no", "start", "end").where("start <= end").withColumn("own", level(F.col("start"), F.col("end")))
    b = keep(target, "other", "s2", "e2").where("s2 <= e2").withColumn("own", level(F.col("s2"), F.col("e2")))
    sizes = a.select("own").unionByName(b.select("own")).agg(F.collect_set("own")).first()[0]  # exponents of doubles: 2,200 at most
    steps = F.array(*map(F.lit, sorted(sizes))).cast("array<int>")

    def cells(df: DataFrame, start: str, end: str, levels: Column) -> DataFrame:
        df = df.withColumn("level", F.explode(levels))
        cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
        return df.withColumn("cell", F.explode(F.sequence(cell(start), cell(end))))

    own = F.array("own")
    above = F.filter(steps, lambda x: x > F.col("own"))
    not_below = F.filter(steps, lambda x: x >= F.col("own"))
    meet = [KEY, "level", "cell"]
    pairs = cells(a, "start", "end", own).drop("own").join(cells(b, "s2", "e2", not_below).drop("own"), meet)
    pairs = pairs.unionByName(cells(a, "start", "end", above).drop("own").join(cells(b, "s2", "e2", own).drop("own"), meet))
    at = F.floor(F.greatest("start", "s2") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    return pairs.where((F.col("s2") <= F.col("end")) & (F.col("e2") >= F.col("start")) & (F.col("cell") == at)).drop("level", "cell")


def match_intervals(source: DataFrame, target: DataFrame) -> DataFrame:
    """(signal_id, interval_no, match): the target with the largest shared part of the union, among those that touch."""
    inside = F.least("end", "e2") - F.greatest("start", "s2")
    union = F.greatest("end", "e2") - F.least("start", "s2")
    scored = overlapping(source, target).withColumn("score", F.when(union > 0, inside / union).otherwise(0.0))
    return scored.groupBy(KEY, "interval_no").agg(F.max_by("other", F.struct("score", -F.col("other"))).alias("match"))


# frames


def _weighted(values, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, map(float, weights))), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def _total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def spectral_centroid(frames: DataFrame, freq: list[float]) -> DataFrame:
    total = _total("f")
    return frames.select(KEY, "t", F.when(total <= banks.TINY, 0.0).otherwise(_weighted("f", freq) / total).alias("centroid"))


def spectral_bandwidth(frames: DataFrame, freq: list[float], p: float = 2.0, norm: bool = True) -> DataFrame:
    grid = F.array(*map(F.lit, map(float, freq)))
    total = _total("f")
    centre = F.when(total <= banks.TINY, 0.0).otherwise(_weighted("f", freq) / total)

    def spread(q: Column) -> Column:
        away = F.zip_with("f", grid, lambda a, f: a * F.pow(F.abs(f - q["centre"]), F.lit(float(p))))
        s = _total(away)
        return F.when(q["total"] <= banks.TINY, s).otherwise(s / q["total"]) if norm else s

    return frames.select(KEY, "t", F.pow(let(F.struct(total.alias("total"), centre.alias("centre")), spread), F.lit(1.0 / p)).alias("bandwidth"))


def spectral_rolloff(frames: DataFrame, freq: list[float], roll_percent: float = 0.85) -> DataFrame:
    """The first frequency at which the running sum reaches the share of the total."""
    if not 0 < roll_percent < 1:
        raise ValueError("roll_percent lies between 0 and 1")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
    pairs = F.zip_with("f", F.array(*map(F.lit, map(float, freq))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def fold(goal: Column) -> Column:
        return F.aggregate(pairs, start, lambda acc, q: F.struct((acc["sum"] + q["a"]).alias("sum"), F.coalesce(acc["at"], F.when(acc["sum"] + q["a"] >= goal, q["b"])).alias("at")))["at"]

    return frames.select(KEY, "t", let(_total("f") * roll_percent, fold).alias("rolloff"))


def spectral_flatness(frames: DataFrame, amin: float = 1e-10, power: float = 2.0) -> DataFrame:
    v = F.transform("f", lambda x: F.greatest(F.lit(amin), F.pow(x, F.lit(float(power)))))
    mean_log = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.log(x)) / F.size("f")
    return frames.select(KEY, "t", (F.exp(mean_log) / (_total(v) / F.size("f"))).alias("flatness"))


def project(frames: DataFrame, bank) -> DataFrame:
    """Frames times a filter bank (rows of weights), each row's non-zero weights only."""

    def rows(f: Column) -> Column:
        out = []
        for row in bank:
            total = F.lit(0.0)
            for k in (k for k, w in enumerate(row) if w):
                total = total + f[k] * float(row[k])
            out.append(total)
        return F.array(*out)

    return frames.select(KEY, "t", let(F.col("f"), rows).alias("f"))


def to_db(frames: DataFrame, ref: float = 1.0, amin: float = 1e-10, top_db: float | None = 80.0) -> DataFrame:
    """Levels of power frames; top_db is below the largest level of the signal's whole matrix."""
    db = F.transform("f", lambda x: convert.power_to_db(x, ref, amin))
    x = frames.select(KEY, "t", db.alias("f"))
    if top_db is None:
        return x
    ceiling = F.max(F.array_max("f")).over(Window.partitionBy(KEY))
    return x.withColumn("ceiling", ceiling).select(KEY, "t", F.transform("f", lambda v: F.greatest(v, F.col("ceiling") - float(top_db))).alias("f"))


def perceptual_weighting(frames: DataFrame, freq: list[float], kind: str = "A", ref: float = 1.0, amin: float = 1e-10, top_db: float | None = 80.0) -> DataFrame:
    """Levels of power frames, as by to_db, plus the weighting curve's value at each bin's frequency in Hz."""
    weights = F.array(*(convert.frequency_weighting(F.lit(float(f)), kind) for f in freq))
    return to_db(frames, ref, amin, top_db).select(KEY, "t", F.zip_with("f", weights, lambda a, b: a + b).alias("f"))


def onset_strength(frames_db: DataFrame, lag: int = 1, shift: int = 0) -> DataFrame:
    """Mean rise of level since lag frames before; zero where there is no frame yet."""
    w = Window.partitionBy(KEY).orderBy("t")
    x = frames_db.withColumn("g", F.lag("f", lag).over(w))
    rise = F.zip_with("f", "g", lambda a, b: F.greatest(F.lit(0.0), a - b))
    x = x.select(KEY, "t", F.when(F.col("g").isNull(), 0.0).otherwise(_total(rise) / F.size("f")).alias("v"))
    if shift:
        x = x.select(KEY, "t", F.coalesce(F.lag("v", shift).over(w), F.lit(0.0)).alias("v"))
    return x


# edges of matrices


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that hold in both directions."""
    back = edges.select(KEY, F.col("j").alias("i"), F.col("i").alias("j"))
    return edges.join(back, [KEY, "i", "j"])

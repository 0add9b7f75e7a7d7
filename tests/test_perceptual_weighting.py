"""Perceptual weighting against the curves' formulas: levels clipped below the signal's largest one, then weighted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetide import registry
from wavetide.operators import signals as S
from wavetide.queries.spectral import FREQ, power


def curve(hz, kind):
    f2 = np.asarray(hz, float) ** 2
    top, low, a, b = 12194.217**2, 20.598997**2, (107.65265**2, 737.86223**2), 158.48932**2
    with np.errstate(divide="ignore"):
        db = {
            "A": 2.0 + 20 * (np.log10(top) + 2 * np.log10(f2) - np.log10(f2 + top) - np.log10(f2 + low) - 0.5 * np.log10(f2 + a[0]) - 0.5 * np.log10(f2 + a[1])),
            "B": 0.17 + 20 * (np.log10(top) + 1.5 * np.log10(f2) - np.log10(f2 + top) - np.log10(f2 + low) - 0.5 * np.log10(f2 + b)),
            "C": 0.062 + 20 * (np.log10(top) + np.log10(f2) - np.log10(f2 + top) - np.log10(f2 + low)),
            "Z": 0 * f2,
        }[kind]
    return db if kind == "Z" else np.maximum(-80.0, db)


@pytest.mark.parametrize("kind", ["A", "B", "C", "Z"])
@pytest.mark.parametrize("ref,top_db", [(1.0, 80.0), (50.0, 15.0), (2.0, None)])
def test_operator(spark, kind, ref, top_db):
    rng = np.random.default_rng(2)
    hz, p = [0.0, 50.0, 1000.0, 16000.0], {u: 10.0 ** rng.uniform(-12, 3, (6, 4)) for u in (1, 2)}
    frames = spark.createDataFrame([(u, t, x.tolist()) for u, s in p.items() for t, x in enumerate(s)], "signal_id long, t long, f array<double>")
    got = {(r["signal_id"], r["t"]): r["f"] for r in S.perceptual_weighting(frames, hz, kind, ref, 1e-10, top_db).collect()}
    for u, s in p.items():
        db = 10 * np.log10(np.maximum(1e-10, s)) - 10 * np.log10(ref)
        db = db if top_db is None else np.maximum(db, db.max() - top_db)
        assert np.allclose([got[u, t] for t in range(6)], db + curve(hz, kind))


def test_unknown_curve(spark):
    with pytest.raises(ValueError):
        S.perceptual_weighting(spark.range(0).select(F.col("id").alias("signal_id"), F.lit(0).alias("t"), F.array(F.lit(1.0)).alias("f")), [1.0], "E")


def test_query_has_the_a_curve(spark, data):
    s = {}
    for r in power(spark, data).collect():
        s.setdefault(r["signal_id"], {})[r["t"]] = r["f"]
    got = {(r["signal_id"], r["t"], r["k"]): r["v"] for r in registry.queries()["perceptual_weighting"](spark, data).collect()}
    want = {}
    for u, frames in s.items():
        db = {t: 10 * np.log10(np.maximum(1e-10, f)) for t, f in frames.items()}
        top = max(x.max() for x in db.values())
        want |= {(u, t, k): v for t, x in db.items() for k, v in enumerate(np.maximum(x, top - 80) + curve(FREQ, "A"))}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-4 for x in want)

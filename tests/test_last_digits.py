"""Results equal their SQL to the last rounded digit, also where values are large or bins are weak."""

import duckdb
import numpy as np
import pytest

from wavetide import registry
from wavetide.kernels import features

from .test_oracles import canonical


def both(spark, tmp_path, name, signals):
    """Rows of a query and of its SQL over signals, in one thread: other orders of a sum have other last digits."""
    rows = [(n, u, float(v)) for n, (u, v) in enumerate((u, v) for u, y in enumerate(signals) for v in y)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(path)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return canonical(registry.queries()[name](spark, str(tmp_path)).toPandas()), canonical(con.sql(registry.oracle_sql()[name]).df())


def test_dtw_of_large_values(spark, tmp_path):
    got, want = both(spark, tmp_path, "dtw", np.random.default_rng(2).random((28, 72)).round(4) * 1e7)
    assert got == want and len(got) == 28 * 15


def test_levels_from_cepstra_are_the_sums_of_the_definition():
    rng = np.random.default_rng(4)
    db = rng.uniform(20.0, 100.0, (5000, 6))
    m = features.mfcc(db, 4)
    q, k = np.arange(4)[:, None], np.arange(6)
    w = np.cos(np.pi * q * (2 * k + 1) / 12) * np.where(q == 0, np.sqrt(1 / 6), np.sqrt(2 / 6))
    for have, want in ((m, db.astype(np.longdouble) @ w.T), (10 * np.log10(features.mfcc_to_mel(m, 6)), m.astype(np.longdouble) @ w)):
        assert np.sqrt(((have - want) ** 2).mean()) < 1.2e-14


def test_reassigned_times_half_way_between_two_roundings(spark, tmp_path):
    rng = np.random.default_rng(7)
    alone = [np.eye(1, 24, n)[0] * round(v, 2) for n, v in zip(list(range(24)) * 2, rng.uniform(1.0, 100.0, 48))]  # k / 64 s has a 5 as its last digit
    got, want = both(spark, tmp_path, "reassigned_spectrogram", [*alone, *rng.random((8, 40)).round(2) * 100])
    assert got == want and len(got) == 48 * 3 + 8 * 7


def test_reassigned_leaves_out_signals_shorter_than_a_frame(spark, tmp_path):
    got, want = both(spark, tmp_path, "reassigned_spectrogram", [np.arange(15.0), np.arange(16.0)])
    assert got == want and len(got) == 1


@pytest.mark.parametrize("name", ["normalize_min", "normalize_inf", "normalize_l1", "normalize_l2"])
def test_division_by_a_norm_of_zero(spark, tmp_path, name):
    signals = [[0.0, 2.5, -1.25, 0.0], [0.0, 0.0], [-0.5, 4.0, 1e-310], [1.0]]
    got, want = both(spark, tmp_path, name, signals)
    assert got == want and len(got) == 10

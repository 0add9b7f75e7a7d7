"""The stacked matrix holds every sample of every signal."""

from wavetide import registry
from wavetide.queries.base import wide


def stacked(spark, folder):
    return {r["n"]: r["v"] for r in registry.queries()["stack"](spark, folder).collect()}


def test_every_sample_is_stacked(spark, data):
    y = [r["y"] for r in sorted(wide(spark, data).collect())]
    want = {n: [v[n] if n < len(v) else None for v in y] for n in range(max(map(len, y)))}
    assert len(want) > 40 and any(None in v for v in want.values())
    assert stacked(spark, data) == want


def test_short_and_missing_signals(spark, tmp_path):
    rows = [(0, 7, 1.0), (1, 3, 2.0), (2, 3, None), (3, 3, 4.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    for name, part in (("some", df), ("none", df.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/events.parquet")
    assert stacked(spark, f"{tmp_path}/some") == {0: [2.0, 1.0], 1: [None, None], 2: [4.0, None]}
    assert stacked(spark, f"{tmp_path}/none") == {}

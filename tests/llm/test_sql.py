"""Corpus queries against their SQL, and the contracts of those without."""

import duckdb
import pandas as pd
import pytest

from tests.test_oracles import canonical
from wavetide.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got, want = registry.queries()[name](spark, data), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    frames = (pd.DataFrame([tuple(x) for x in rows], columns=of.columns, dtype=object) for rows, of in ((got.collect(), got), (want.fetchall(), want)))
    assert canonical(next(frames)) == canonical(next(frames))


def test_all_are_registered():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 14)]

"""Every query with SQL against DuckDB on the smallest tables; every other query must run and return rows."""

import math

import duckdb
import numpy as np
import pytest

from wavetide import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def canonical(df):
    def text(x):
        if isinstance(x, (list, np.ndarray)) and x is not np.ma.masked:
            return "[" + ",".join(text(y) for y in x) + "]"
        if x is None or x is np.ma.masked or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, np.integer)):
            return str(int(x))
        return repr(float(x)) if isinstance(x, (float, np.floating)) else str(x)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture
def con(data, tmp_path):
    """A database for one test, so that a fatal error stays with the query that meets it."""
    c = duckdb.connect(config={"memory_limit": "2GB", "threads": 2, "temp_directory": str(tmp_path)})
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    got = registry.queries()[name](spark, data).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0

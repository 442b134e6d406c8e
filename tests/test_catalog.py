"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from panelspark.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).fetch_df() if hasattr(duck, "fetch_df") else duck.execute(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want) and len(got) > 0
    order = [c for c in cols if want[c].dtype.kind != "f"] + [c for c in cols if want[c].dtype.kind == "f"]
    a, b = (x[cols].sort_values(order, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6, rtol=0)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0

"""Every query with oracle SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from lumicurve.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiub" or str(df[c].dtype).startswith(("Int", "Float")):
            df[c] = df[c].astype("float64").round(4) + 0.0
    rows = df.astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"})
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = canonical(got), canonical(want)
    assert (a == b).all(axis=None), a[(a != b).any(axis=1)].head().to_string() + "\n" + b[(a != b).any(axis=1)].head().to_string()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())

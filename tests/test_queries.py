"""Every core query runs on the smallest data and equals its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from shardloom.plans import registry

QUERIES = registry.queries()
SQL = registry.oracle_sql()


def canonical(df: pd.DataFrame) -> list:
    def one(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str(list(v))
        if pd.isna(v):
            return ""
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        try:
            return f"{float(v):.8g}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def views(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, views, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        assert canonical(got) == canonical(views.sql(SQL[name]).df())


def test_flagship(spark, data):
    assert registry.flagship(spark, data).columns == ["shard_id"]

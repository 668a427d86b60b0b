"""The problems' queries on the smallest data, against SQL where there is one."""

import glob
import os

import duckdb
import pytest

from shardloom import llm

QUERIES = llm.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name.endswith("_found"):
        assert not got.duplicated().any()
    if name in llm.oracle_sql():
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want = con.sql(llm.oracle_sql()[name]).df()
        key = lambda d: sorted(map(str, d[sorted(d.columns)].round(9).itertuples(index=False, name=None)))
        assert key(got) == key(want)


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for path in glob.glob(f"{root}/shardloom/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert ".llm" not in open(path).read() and "import llm" not in open(path).read(), path

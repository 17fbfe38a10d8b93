"""The entry module, and the queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "documents benchmark embeddings".split()
ORACLE = {k: v for k, v in entry.catalog.oracle_sql().items()}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = c.sql(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)

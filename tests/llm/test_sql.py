"""The queries of this subpackage that have SQL give the same rows in both engines."""

import os
from collections import Counter

import pytest

from blockloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view blocks as select * from '{DATA}/blocks.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    theirs = c.sql(queries.ORACLE_SQL[name])
    at = [theirs.columns.index(x) for x in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in theirs.fetchall())

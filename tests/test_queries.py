"""Every query with SQL gives the same rows in both engines, over the small test data."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else repr(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not (n[0] == "p" and n[1].isdigit())))
def test_same_rows(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[x]) for x in cols) for r in df.collect())
    theirs = c.sql(entry.oracle_sql()[name])
    at = [theirs.columns.index(x) for x in cols]
    assert sorted(theirs.columns) == cols
    assert ours == Counter(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["page_lines", "parsed_markdown", "parsed_html", "p4_found", "p4_cells"])
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry_without_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['blockloom.llm'] = None\nimport __spark_entry__ as e; print(sum(n[0] == 'p' and n[1].isdigit() for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    assert out.stdout.strip() == "2", out.stderr

"""Every query with SQL against DuckDB on the smallest tables, and every other one for its schema."""

import math
import os

import duckdb
import pytest

from glyphlake import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else str(v)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in core.SQL:
        assert ours
        return
    result = duck.sql(core.SQL[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
    assert ours == theirs


def test_entry_without_the_optional_part(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['glyphlake.llm'] = None; import importlib.util as u; import glyphlake.queries as q; assert q.QUERIES and not any(m.startswith('glyphlake.llm.') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0

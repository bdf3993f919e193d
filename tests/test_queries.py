"""Every query with SQL against DuckDB on the smallest tables, compared like values, not text."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4) or (math.isnan(a) and math.isnan(b))
    return a == b or (a is None and b is None)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = entry.queries()[name](spark, SF)
    columns = sorted(out.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in out.select(*columns).collect()]
    keys = [i for i, c in enumerate(columns) if c in ("event_id", "user_id", "symbol", "date", "o_custkey", "l_suppkey", "vec_id", "name", "length", "a", "b", "doc_id", "query_id", "rank", "o_orderkey")]
    order = lambda r: tuple(r[i] for i in keys)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert all(map(same, a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() == 715

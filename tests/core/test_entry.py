"""The driver contract, and queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from caseloom import catalog

TABLES = "/root/testdata/sf0.001"
ROUND = 9


def test_names_match():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(catalog.queries()) > 50


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "conversations", "orders", "documents", "nation", "region"):
        con.execute(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    norm = lambda v: round(v, ROUND) if isinstance(v, float) else v
    df = catalog.queries()[name](spark, TABLES)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(names) == cols and got == want

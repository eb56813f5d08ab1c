"""The driver contract: names, SQL of registered queries, and equal results on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
#: The queries of the removable subpackage have tests of their own.
CORE = sorted(set(entry.oracle_sql()) - set(entry.llm_catalogue.ORACLES if entry.llm_catalogue else ()))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    df = entry.queries()[name](spark, small)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr) == want

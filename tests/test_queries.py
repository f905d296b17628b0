import os

import __spark_entry__ as entry
import pytest


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p2_found", "p4_found"} <= set(q)


@pytest.mark.parametrize("name", [n for m in entry.MODULES if ".llm." not in m.__name__ for n in m.QUERIES if n in m.SQL])
def test_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*cols).collect())
    want = sorted(tuple(cell(v) for v in r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0

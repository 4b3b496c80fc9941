"""Every query against its SQL on the smallest tables; those without SQL must return rows of a stable schema."""

import math

import duckdb
import pytest

from barline.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split() + ["pages", "documents"]


@pytest.fixture(scope="session")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, con):
    df = QUERIES[name](spark, data)
    rows = [r.asDict() for r in df.collect()]
    if name not in ORACLE:
        assert df.schema == QUERIES[name](spark, data).schema if not name.startswith("verdict") else rows
        return
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r)) for r in result.fetchall()]
    order = sorted(names)
    got_rows = sorted(tuple(cell(r[n]) for n in order) for r in rows)
    assert got_rows == sorted(tuple(cell(r[n]) for n in order) for r in want)

"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from semframe.plans import more  # noqa: F401
from semframe.plans import queries as core

SKIP = {"soft_agg_dbscan"}  # slow in SQL


def rounded(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(rounded(x) for x in v)
    return v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(core.QUERIES) > 45


@pytest.mark.parametrize("name", sorted(set(core.SQL) - SKIP))
def test_core_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    from pathlib import Path

    for f in Path(data).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = core.QUERIES[name](spark, data)
    want = con.sql(core.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    mine = sorted(repr([rounded(r[c]) for c in order]) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    theirs = sorted(repr([rounded(r[i]) for i in at]) for r in want.fetchall())
    clean = lambda rows: [r.replace("Decimal('", "").replace("')", "") for r in rows]
    assert clean(mine) == clean(theirs)

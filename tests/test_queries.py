"""Every core query against its DuckDB statement on the small tables."""

import datetime
import math
import os

import duckdb
import pytest

from quillmill import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return str(value) if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in core.oracle_sql():
        assert rows
        return
    result = duck.execute(core.oracle_sql()[name])
    own = [d[0] for d in result.description]
    assert sorted(own) == columns
    want = sorted((tuple(_plain(dict(zip(own, r))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["query_id", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

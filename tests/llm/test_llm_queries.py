"""The pN_ queries against their DuckDB statements on the small tables."""

import datetime
import math
import os

import duckdb
import pytest

from quillmill.llm import queries as llm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return str(value) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    df = llm.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert len(set(map(repr, rows))) == len(rows)
    if name not in llm.oracle_sql():
        return
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    result = con.execute(llm.oracle_sql()[name])
    own = [d[0] for d in result.description]
    assert sorted(own) == columns
    assert rows == sorted((tuple(_plain(dict(zip(own, r))[c]) for c in columns) for r in result.fetchall()), key=repr)

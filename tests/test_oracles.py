"""Every registered query outside the llm subpackage, on Spark against the same rows from DuckDB."""

import math
import os
import threading

import duckdb
import pytest

from gridwarden import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = sorted((tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()), key=repr)
    assert rows or name in EMPTY
    if name not in plans.ORACLES:
        return
    stop = threading.Timer(120, duck.interrupt)
    stop.start()
    found = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in found.description]
    at = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    stop.cancel()
    assert sorted(df.columns) == sorted(columns)
    assert rows == want


#: Queries that find nothing in the smallest tables.
EMPTY = set()

"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest
from common import DATA

from cohortal import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def shown(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, list):
        return tuple(map(shown, x))
    if isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 5)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(shown(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    off = [(a, b) for a, b in zip(ours, theirs) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b))]
    assert not off, off[:3]

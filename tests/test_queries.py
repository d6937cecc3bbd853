"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from buildscope.plans.queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(([names[i] for i in order], *(tuple(str(value(r[i])) for i in order) for r in rows))[1:])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.columns, got.collect()) == canonical(names, want.fetchall())

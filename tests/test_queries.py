"""Each registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from signalfold.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{f}')")
    return con


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_its_sql(spark, oracle, name):
    got = QUERIES[name](spark, DIR)
    want = oracle.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert _sorted(got.columns, map(tuple, got.collect())) == _sorted(names, want.fetchall())

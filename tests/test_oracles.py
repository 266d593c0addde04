"""Every query against its SQL in an independent engine."""

import math
import os

import duckdb
import pytest
from tidemark import catalogue


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return c


def same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda row: tuple((v is not None, round(v, 3) if isinstance(v, float) else v) for v in row)
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    b = sorted(want.fetchall(), key=key)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).columns

"""Every query of the engine with its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from attestor.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=0, abs_tol=1e-9) or math.isnan(a) and math.isnan(b)
    return a == b


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    got = core.QUERIES[name](spark, SF)
    assert got.columns
    rows = got.collect()
    if name not in core.ORACLES:
        return
    cursor = con.execute(core.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted(cursor.fetchall(), key=key)
    have = sorted((tuple(r[n] for n in names) for r in rows), key=key)
    assert len(want) == len(have)
    for a, b in zip(want, have, strict=True):
        assert all(map(same, a, b)), (a, b)

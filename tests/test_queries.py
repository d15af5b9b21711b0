"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from layerframe.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in cols]
    rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == rows

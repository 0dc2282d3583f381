"""Every query of the core that SQL says against that SQL, row by row; the others are in test_known_answers."""

import math
import os

import duckdb
import pytest

from strandweave.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return float(f"{float(v):.9g}") + 0.0 if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    said = duck.execute(ORACLES[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in said.fetchall()), key=repr)
    assert rows == want


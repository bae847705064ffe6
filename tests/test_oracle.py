"""Every engine query that has SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from pulsecohort.plans import queries as engine

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Its groups are so small here that the exact test is used, which SQL does not have.
ELSEWHERE = {"ag_mwu_p", "vh_mwu_ranking", "vh_separation"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(engine.ORACLE) - ELSEWHERE))
def test_same_rows(spark, duck, name):
    df = engine.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    found = duck.execute(engine.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE)))
def test_rows(spark, name):
    assert engine.QUERIES[name](spark, FOLDER).count() > 0

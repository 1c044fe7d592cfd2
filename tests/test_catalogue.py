"""Every driver query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from folio.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in names)) for r in df.collect()))
    assert got
    if name in ORACLE_SQL:
        rel = sql.sql(ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in names]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())

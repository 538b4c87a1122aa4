"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidelog.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return con


def rows(found):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA), duck.execute(registry.SQL[name])
    cols = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert rows(got.select(*cols).collect()) == rows([r[k] for k in order] for r in want.fetchall())

"""Every query runs on the smallest tables and equals its SQL in DuckDB."""

import math

import duckdb
import pytest

from readlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    assert got or name in registry.ORACLE
    if name in registry.ORACLE:
        c = con.execute(registry.ORACLE[name])
        names = [d[0] for d in c.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(got, range(len(names))) == rows_of(c.fetchall(), [names.index(x) for x in df.columns])

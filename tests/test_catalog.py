"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime

import duckdb
import pytest

from folio.catalog import stores, streams, trees

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
ALL = [(c, name) for c in (trees, stores, streams) for name in c.QUERIES]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize(("catalog", "name"), ALL, ids=[n for _, n in ALL])
def test_query(spark, duck, catalog, name):
    got = catalog.QUERIES[name](spark, D)
    columns = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(columns).collect()), key=repr)
    found = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)

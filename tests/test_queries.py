"""Every core query against its SQL on the smallest tables, and invariance under partitioning."""

import os

import duckdb
import pytest

from lodestrata.plans.files import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(rows):
    cell = lambda v: "" if v is None else round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    r = con.execute(SQL[name])
    names = [x[0] for x in r.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == plain([[row[k] for k in order] for row in r.fetchall()])

"""Queries over files that are longer than the head that sniffing looks at."""

import duckdb
import pytest
from test_queries import plain

from lodestrata.functions import fixed
from lodestrata.plans.files import QUERIES, SQL


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    folder = tmp_path_factory.mktemp("larger")
    duckdb.sql(f"copy (select k as c_custkey, printf('Customer#%09d', k) as c_name, (k % 3)::INT as c_nationkey from range(6000) t(k)) to '{folder}/customer.parquet' (format parquet)")
    assert 6000 // 3 * len('{"id":1000,"name":"Customer#000000000"}') > fixed.HEAD_BYTES
    return str(folder)


@pytest.mark.parametrize("name", ["file_tiers", "graded_cross_table", "file_records", "sniff_formats", "tier_report"])
def test_query_over_long_files(spark, larger, name):
    df = QUERIES[name](spark, larger)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{larger}/customer.parquet'")
    r = con.execute(SQL[name])
    order = [[x[0] for x in r.description].index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([[row[k] for k in order] for row in r.fetchall()])

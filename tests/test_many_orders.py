"""Queries over more orders than identifiers of six digits can tell apart, against their SQL."""

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Forty orders, and forty more with keys a million higher."""
    out, con = tmp_path_factory.mktemp("many"), duckdb.connect()
    con.execute(f"copy (select * replace (o_orderkey % 40 + i * 1000000 as o_orderkey) from '{SMALL}/orders.parquet', range(2) r(i) qualify row_number() over (partition by i, o_orderkey % 40 order by o_orderkey) = 1) to '{out}/orders.parquet' (format parquet)")
    for name in ("part", "customer"):
        con.execute(f"copy (from '{SMALL}/{name}.parquet') to '{out}/{name}.parquet' (format parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["sample_scope", "clean_orders", "kept_answers", "streamed_counters", "streamed_orders"])
def test_more_orders_than_identifiers(spark, folder, name):
    got = __spark_entry__.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view orders as from '{folder}/orders.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert want
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))

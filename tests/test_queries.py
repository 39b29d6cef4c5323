"""Registered queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: All queries with a twin, but for those of the training-data operators, which have tests of their own.
PICKED = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


#: Books need more names than the smallest tables have; their queries run on the next larger ones.
LARGER = {"b05_long_short", "b05_net_long_short", "b06_turnover", "b07_borrow", "b07_borrow_by_name", "b08_hedge", "b16_borrow_curve", "k04_decile_book", "b16_rate_curve", "b05_cash_nav", "b07_financing"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, name):
    folder = SF.replace("sf0.001", "sf0.01") if name in LARGER else SF
    got = entry.queries()[name](spark, folder)
    rows = sorted(map(str, (tuple(r) for r in got.collect())))
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({sql})").fetchall()
        assert rows == sorted(map(str, want))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

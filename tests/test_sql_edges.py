"""Queries agree with their SQL where small given tables show no fault: many trades a day, ties in time, zero prices, many securities."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, duck, rows

SF = "/root/testdata/sf0.001"
OWN = entry._own()


def tables(folder, **made):
    """A folder of the given tables, of which some are made by SQL."""
    for t in TABLES:
        if t in made:
            duckdb.connect().execute(f"COPY ({made[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def both(spark, folder, name):
    got = OWN.QUERIES[name](spark, folder)
    want = duck(folder).sql(OWN.ORACLES[name])
    return rows([tuple(r) for r in got.collect()], got.columns), rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["a_daily_metrics", "v_bootstrap"])
def test_returns_do_not_grow_with_the_trades_of_a_day(spark, tmp_path, name):
    many = f"SELECT * REPLACE (o_orderkey + i * 10000 AS o_orderkey, o_custkey + i * 1000 AS o_custkey) FROM '{SF}/orders.parquet', range(600) r(i)"
    got, want = both(spark, tables(tmp_path, orders=many), name)
    assert got == want


def test_bars_of_equal_times_and_of_a_zero_close(spark, tmp_path):
    # Every second has eight trades, written in descending event_id; the second and third bar are of price 0.
    e = """SELECT CAST(100000 - i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i // 40 * 15) MINUTE + INTERVAL (i % 40 // 8) SECOND AS ts, CAST(i % 7 AS BIGINT) AS user_id, 'view' AS event_type,
  CASE WHEN i // 40 IN (1, 2) THEN 0.0 ELSE CAST(10 + i * 37 % 101 AS DOUBLE) END AS value, '{"k": 1}' AS props FROM range(4000) r(i)"""
    got, want = both(spark, tables(tmp_path, events=e), "entry_bars")
    assert got == want


def test_screeners_of_many_securities(spark, tmp_path):
    part = "SELECT * REPLACE (p_partkey + i * 20000 AS p_partkey) FROM '/root/testdata/sf0.1/part.parquet', range(60) r(i)"
    got, want = both(spark, tables(tmp_path, part=part), "d_screens")
    assert got == want

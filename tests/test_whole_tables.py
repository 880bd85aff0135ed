"""Queries over whole tables against DuckDB, at the size where every path of them is taken."""

import os

import duckdb
import pytest

from ledgerframe import suite
from ledgerframe.operators import grouping
from tests.test_queries import TABLES, plain

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(spark, duck, name):
    df = suite.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    r = duck.sql(suite.ORACLES[name])
    assert sorted(r.columns) == columns
    assert got == sorted(tuple(plain(x[r.columns.index(c)]) for c in columns) for x in r.fetchall())
    return [dict(zip(columns, g, strict=True)) for g in got]


def test_actions_of_all_orders(spark, duck):
    got = rows(spark, duck, "action_history")
    assert sum(int(r["n_receipts"]) for r in got) == duck.sql("select count(*) from lineitem").fetchall()[0][0]
    assert {r["amount"] == "None" for r in got if int(r["block_num"]) <= 40} == {True}
    assert {r["amount"] == "None" for r in got if int(r["block_num"]) > 40} == {False}


def test_watermark_of_all_orders(spark, duck):
    (got,) = rows(spark, duck, "watermark_islands")
    assert (int(got["watermark"]), int(got["ranges"])) == duck.sql("select max(o_orderkey), count(*) from orders").fetchall()[0]


def test_watermark_stops_at_planted_gaps(spark):
    # strips of 8 starts: gaps inside the first strip, at an edge of strips, inside a later one, and none
    for gap in (3, 7, 8, 19, 16, 99):
        done = [k for k in range(40) if k != gap]
        got = grouping.contiguous_watermark(spark.createDataFrame([(k, k) for k in done], "s long, e long"), "s", "e", width=8).first()
        end = gap - 1 if gap < 40 else 39
        assert (got.watermark, got.ranges) == (end, end + 1), gap

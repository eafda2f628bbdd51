"""Where the derived lines lie: shuffled once for the join that comes next, and the same rows as before."""

from __future__ import annotations

import datetime as dt

import pytest

from duebook.sources.base import ON_COMPLETE_WORK, Tables
from trade_tables import TradeTables

_DAY = dt.datetime(2001, 3, 5)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders with repeated lines, lines without a number or order, and numbers from ten on, of which
    line 15 of order 1 shares its procedure number with line 5 of order 2."""
    path = str(tmp_path_factory.mktemp("trade"))
    pairs = [(1, 1), (1, 1), (1, 2), (1, 15), (2, 5), (2, 5), (2, 7), (3, None), (None, 3), (4, 4), (4, 1), (22, 3)]
    lines = [(k, line, 10 + i, 100.0 + i, 0.05, "RAN"[i % 3], _DAY + dt.timedelta(i)) for i, (k, line) in enumerate(pairs)]
    orders = [(k, c, 50.0 + k, "O", _DAY) for k, c in [(1, 7), (2, 8), (2, 9), (3, 8), (4, None), (22, 7)]]
    frames = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, "
                            "l_discount double, l_returnflag string, l_shipdate timestamp"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderdate timestamp"),
        "customer": ([(7, 3), (8, 4)], "c_custkey long, c_nationkey int"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return TradeTables(spark, path)


def rows_of(frame):
    return sorted(frame.collect(), key=str)


@pytest.mark.parametrize("name, columns", [
    ("procedurelog", ("procnum", "patnum", "provnum", "clinicnum", "procdate", "procfee", "procstatus", "discount", "unitqty")),
    ("claimproc", ("claimprocnum", "procnum", "patnum", "clinicnum", "datecp", "status", "inspayamt")),
])
def test_rows_laid_by_procedure_are_those_that_name_one(tables, name, columns):
    want = tables.read(name, *columns).filter("procnum != 0")
    assert rows_of(tables.read(name, *columns, by="procnum")) == rows_of(want)
    wanted = tables.spark.createDataFrame([(11,), (25,), (44,), (223,), (None,)], "procnum long")
    chosen = tables.among(name, "procnum", wanted, *columns)
    assert rows_of(chosen) == rows_of(want.join(wanted, "procnum", "left_semi")) and not chosen.isEmpty()


def test_claims_on_completed_work_are_those_of_the_plain_join(tables):
    columns = ("claimprocnum", "procnum", "patnum", "status", "inspayamt")
    where = "status IN (0, 1, 4, 5, 7)"
    got = tables.referring(ON_COMPLETE_WORK, *columns, where=where)
    assert rows_of(got) == rows_of(Tables.referring(tables, ON_COMPLETE_WORK, *columns, where=where))


def exchanges(frame):
    """The exchanges of each branch that ends in the plain lines, without broadcasts."""
    spark = frame.sparkSession
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    path, counts = [], []
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        path = [(d, x) for d, x in path if d < depth] + [(depth, line)]
        if "FileScan" in line and "l_orderkey" in line and "l_linenumber" in line:
            counts.append(sum("Exchange " in x for _, x in path))
    return counts


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_are_shuffled_once_for_their_owners(tables, no_broadcast):
    assert exchanges(tables.read("procedurelog", "procnum", "patnum", "procfee", "procstatus")) == [1]


def test_lines_are_shuffled_once_for_a_join_by_procedure(tables, no_broadcast):
    wanted = tables.spark.range(100).selectExpr("id AS procnum")
    counts = exchanges(tables.read("procedurelog", "procnum", "procstatus", by="procnum").join(wanted, "procnum", "left_semi"))
    assert counts[0] == 1
    # Only what the semi join leaves goes on to the owners.
    assert exchanges(tables.among("procedurelog", "procnum", wanted, "procnum", "patnum"))[0] == 2

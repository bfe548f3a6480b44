"""The panel's layers from orders and lines that are counted once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cellwise.operators.rollup import coverage_rollup
from cellwise.plans import base as B
from cellwise.plans import profiling

INDS = ["BUILDING", "MACHINERY"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Few customers, so that cells are dense; keys repeat, are null or lack a partner."""
    path, draw = str(tmp_path_factory.mktemp("cells")), random.Random(7)

    def day():
        return dt.datetime(draw.randint(1994, 2001), draw.randint(1, 12), draw.randint(1, 28), 23)

    customers = [(k, k % 3, INDS[k // 3 % 2]) for k in range(12)]
    customers += [(1, 1, "MACHINERY"), (1, 1, "MACHINERY"), (2, 0, "BUILDING"), (3, None, "BUILDING"), (3, None, "MACHINERY"), (4, 1, None), (None, 1, "BUILDING")]
    orders = [
        (k, draw.choice([*range(13), None]), draw.choice("FOP"), draw.choice([None, round(draw.uniform(1, 900), 2)]), day(), draw.choice(["1-URGENT", "5-LOW", None]))
        for k in range(3000)
    ]
    orders += [orders[5], (None, 1, "F", 7.25, day(), "1-URGENT")]
    lines = [
        (draw.choice([*range(3100), None]), draw.choice([*range(6), None]), float(draw.randint(1, 50)), round(draw.uniform(1, 900), 2), draw.choice([day(), day(), day(), None]))
        for _ in range(9000)
    ]
    tables = {
        "nation": ([(0, "A", 1), (1, "B", 2), (2, "C", 4)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, k % 3) for k in range(5)], "s_suppkey long, s_nationkey int"),
        "customer": (customers, "c_custkey long, c_nationkey int, c_mktsegment string"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def reads(monkeypatch):
    """The tables that are opened from now on."""
    opened, table = [], B.table
    monkeypatch.setattr(B, "table", lambda spark, folder, name: (opened.append(name), table(spark, folder, name))[1])
    return opened


def test_panel_meets_orders_and_lines_once(spark, folder, monkeypatch):
    opened = reads(monkeypatch)
    assert B.analytic_panel(spark, folder).count() > 0
    assert opened.count("lineitem") == 1
    assert opened.count("orders") == 2  # once counted, once for the lines


def test_only_the_year_of_shipment_is_moved(spark, folder):
    columns = dict(B.shipped_lines(spark, folder).dtypes)
    assert "timestamp" not in columns.values() and columns["yr"] == "int"


def test_assertion_reads_the_lines_for_the_panel_and_for_its_own_count(spark, folder, monkeypatch):
    opened = reads(monkeypatch)
    found = {r.name: r for r in profiling.post_write_assertion(spark, folder).collect()}
    assert opened.count("lineitem") == 2
    core = B.orders_by_cell(spark, folder).select("geo", "ind", F.year("o_orderdate").alias("yr")).distinct()
    growth = B.shipped_lines(spark, folder).select(*B.KEY).distinct()
    want = core.join(growth, B.KEY).filter("geo < 2 AND yr BETWEEN 1995 AND 2001").count()
    assert want > 0 and found["written_rows"].observed == found["written_rows"].expected == str(want)
    assert {r.status for r in found.values()} == {"pass"}


def test_shared_order_cells_give_the_same_layers(spark, folder):
    cells = B.order_cells(spark, folder)
    assert rows(B.start_layer(spark, folder, cells=cells)) == rows(B.start_layer(spark, folder))
    plain = (
        B.orders_by_cell(spark, folder)
        .groupBy("geo", F.year("o_orderdate").alias("yr"))
        .agg(
            F.count_distinct("o_custkey").cast("double").alias("population_est"),
            (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("income_est"),
        )
    )
    got = B.control_cells(spark, folder).select(*plain.columns)
    assert rows(B.rounded(got)) == rows(B.rounded(plain))


def test_shared_line_cells_give_the_same_layers(spark, folder):
    cells = B.line_cells(spark, folder)
    members, places = cells.filter("by_member"), cells.filter("NOT by_member")
    assert rows(B.activity_layer(spark, folder, cells=places)) == rows(B.activity_layer(spark, folder))
    apart = B.member_rows(spark, folder)
    assert rows(B.member_rows(spark, folder, cells=members)) == rows(apart)
    staged = coverage_rollup(apart, B.expected_members(spark, folder), B.KEY, "geo", "member", B.MEMBER_MEASURES, "is_suppressed")
    assert rows(B.rounded(B.support_stage(spark, folder, members))) == rows(B.rounded(staged))

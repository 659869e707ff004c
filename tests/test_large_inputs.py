"""Steps that grow with the input: same rows, tasks that follow the rows, joins made once."""

import datetime as dt

import pytest

from ledgerlens.plans import catalog_stored
from ledgerlens.sources import adapter

TABLES = {
    "nation": ("n_nationkey int, n_name string", [(0, "PERU"), (1, None)]),
    "supplier": ("s_suppkey long, s_name string", [(i, f"Supplier {i}") for i in range(12)]),
    "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(i, i % 2, "BUILDING") for i in range(4)]),
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
        [(i, f"part {i}", "Brand#1", "PROMO", i) for i in range(11)],
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string",
        [(i, i % 4, "OFP"[i % 3], "1-URGENT") for i in range(20)],
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp",
        [
            # keys repeat, and some are null or meet nothing
            (None if i == 7 else i % 22, i % 11, i % 12, i % 7 + 1, 2.0, 1000.5 * i, "R", "O", dt.datetime(1999 + i % 2, 1 + i % 12, 3))
            for i in range(80)
        ],
    ),
}


@pytest.fixture
def tables(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_row_making_tasks_follow_the_lineitems(spark, tables, monkeypatch):
    few = rows_of(adapter.raw_payments(spark, tables))
    assert len(few) == 73  # without the null key and those of no order
    monkeypatch.setattr(adapter, "MOST_ROWS", 1)
    many = adapter.raw_payments(spark, tables)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Exchange hashpartitioning") == 2  # not shuffled again
    assert many.rdd.getNumPartitions() >= 80
    assert rows_of(many) == few


def test_yearly_loads_make_the_raw_rows_once(spark, tables, monkeypatch):
    given = []
    monkeypatch.setattr(catalog_stored, "load_years", lambda spark, raw, out, **kwargs: given.append(raw))
    monkeypatch.setattr(catalog_stored, "read_published", lambda *args: spark.createDataFrame([], "year int, amount double, payment_id string"))
    catalog_stored.q_yearly_loads(spark, tables)
    first, second = given
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in given)
    assert rows_of(first) == rows_of(adapter.raw_payments(spark, tables))
    assert 0 < second.count() < first.count()

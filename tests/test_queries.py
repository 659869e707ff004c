"""Registered queries vs their DuckDB oracles on the smallest tables."""

import math
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem"]
SAMPLE = [
    "agg_status", "classify_payments", "rule_evidence", "fact_projection", "dim_vendors", "agg_categories",
    "top_spend_category", "large_unpaid_item", "anomaly_candidates", "qa_report", "categories_tree",
    "transformation_log", "detail_rows", "category_yoy", "labels_to_rules",
]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_every_query_has_a_builder():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


@pytest.mark.parametrize("pipeline_left", [True, False])
def test_entry_without_training_data_operators(monkeypatch, pipeline_left):
    """With the subpackage gone, and its pipeline gone or not, the other queries are all there."""
    for name in [m for m in sys.modules if m.startswith("ledgerlens.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ledgerlens.llm", None)
    if not pipeline_left:
        monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 80 and set(o) <= set(q)
    assert "pipeline" not in q and not any(name.startswith("op") and name[2].isdigit() for name in q)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = Counter(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    rel = con.sql(entry.oracle_sql()[name])
    ocols = rel.columns
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    orows = Counter(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert srows == orows


def test_detail_rows_have_all_columns(spark):
    from ledgerlens.operators.dashboard import DETAIL_COLUMNS

    assert entry.queries()["detail_rows"](spark, SF).columns == DETAIL_COLUMNS
    assert "has_transformations" in entry.oracle_sql()["detail_rows"]

"""Queries that leave out work whose results they do not return: same rows, smaller plans."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens.functions import ids
from ledgerlens.operators import audit, dashboard, insights, marts
from ledgerlens.plans import pipeline
from ledgerlens.sources import ingest
from ledgerlens.sources.adapter import RAW_COLUMNS

SF = "/root/testdata/sf0.001"
CLASSIFIER = "__am"  # a column of the classifier's winner


def raw_rows(spark):
    texts = ["  Облако  A ", "a  b", "", None, "hosting  services", "\tOracle\n"]
    dates = ["1999-05-06", "07.08.2000", "1999-05-06 00:00:00", "2001Q2", "junk", None]
    amounts = ["1 234,50", "n/a", "12", None, "-7.25", "1e3"]
    rows = []
    for i in range(60):
        row = [texts[(i + j * (i // 6 % 5 + 1)) % 6] for j in range(len(RAW_COLUMNS))]
        row[RAW_COLUMNS.index("period")] = dates[i % 6]
        row[RAW_COLUMNS.index("summa")] = amounts[i // 2 % 6]
        row[RAW_COLUMNS.index("registrator_status_name")] = ["Оплачен полностью", " УТВЕРЖДЕН ", None, ""][i % 4]
        rows += [row, row] if i % 3 == 0 else [row]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_log_rows_equal_those_of_the_array(spark):
    raw = ingest.with_row_seq(raw_rows(spark), RAW_COLUMNS)
    array = rows_of(audit.transformation_rows(audit.audit_trail(raw)))
    assert rows_of(audit.change_rows(audit.cleaned_with_raw(raw))) == array
    assert rows_of(audit.change_rows(audit.processed_with_raw(raw))) == array
    assert len({r[4] for r in array}) > 8 and max(r[1] for r in array) > 8
    assert audit.change_rows(audit.cleaned_with_raw(raw)).columns == audit.transformation_rows(audit.audit_trail(raw)).columns


def test_flag_says_whether_the_log_has_rows(spark):
    bare = spark.createDataFrame([("2 000", "a", 0), ("12.5", "a", 1), (None, None, 2)], "summa string, note string, _row_seq long")
    for raw in (bare, ingest.with_row_seq(raw_rows(spark), RAW_COLUMNS)):
        staged = audit.processed_with_raw(raw)
        logged = {r[0] for r in audit.audit_of(staged).where("size(transformations) > 0").select(ingest.ROW_SEQ).collect()}
        assert {r[0] for r in staged.where("has_transformations").select(ingest.ROW_SEQ).collect()} == logged


def test_log_query_does_not_classify(spark):
    assert CLASSIFIER not in plan_of(entry.queries()["transformation_log"](spark, SF))


def test_raw_attributes_equal_those_of_the_audit(spark):
    raw = ingest.with_row_seq(raw_rows(spark), RAW_COLUMNS)
    assert rows_of(audit.raw_attribute_rows(raw)) == rows_of(audit.attribute_rows(audit.audit_trail(raw)))
    plan = plan_of(entry.queries()["row_raw_attributes"](spark, SF))
    assert CLASSIFIER not in plan and "map_filter" not in plan


@pytest.mark.parametrize("first_rows", [10_000, 0])
def test_row_at_is_the_numbered_row(spark, monkeypatch, first_rows):
    monkeypatch.setattr(ingest, "FIRST_ROWS", first_rows)
    raw = raw_rows(spark).repartition(5)
    numbered = {r[ingest.ROW_SEQ]: r.asDict() for r in ingest.with_row_seq(raw, RAW_COLUMNS).collect()}
    for number in (0, 1, 42, len(numbered) - 1):
        (row,) = ingest.row_at(raw, number, RAW_COLUMNS).collect()
        assert row.asDict() == numbered[number]
    assert ingest.row_at(raw, len(numbered), RAW_COLUMNS).count() == 0


def test_row_detail_numbers_no_other_rows(spark, monkeypatch):
    monkeypatch.setattr(ids, "written", lambda *a: pytest.fail("rows are numbered"))
    assert entry.queries()["row_detail"](spark, SF).where(F.col("detail_row_id") == "row_42").count() > 0


def test_rules_put_only_the_queue_in_order(spark, monkeypatch):
    placed, keep = [], ids.written
    monkeypatch.setattr(ids, "written", lambda df, name: placed.append(df.count()) or keep(df, name))
    assert entry.queries()["labels_to_rules"](spark, SF).count() > 0
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert 0 < max(placed) < rows / 10


def test_aggregates_by_other_columns_do_not_classify(spark):
    for name in ("status_breakdown", "agg_status", "agg_vendors", "monthly_series"):
        assert CLASSIFIER not in plan_of(entry.queries()[name](spark, SF)), name
    assert CLASSIFIER in plan_of(entry.queries()["categories_tree"](spark, SF))


def test_a_run_makes_its_cube_and_insights_once(spark, monkeypatch, tmp_path):
    made = Counter()
    for module, name in ((marts, "aggregate_cube"), (insights, "all_insights"), (marts, "group_amount_and_count")):
        def counted(*args, real=getattr(module, name), name=name):
            made[name] += 1
            return real(*args)
        monkeypatch.setattr(module, name, counted)
    paths = pipeline.run_pipeline(spark, raw_rows(spark), str(tmp_path), years=(1999, 2000), order_cols=RAW_COLUMNS)
    assert made == {"aggregate_cube": 1, "all_insights": 1}
    details, index = (spark.read.parquet(paths[name]) for name in ("detail_rows", "detail_row_index"))
    assert rows_of(index) == rows_of(dashboard.detail_row_index(details))
    fact = spark.read.parquet(paths["fact"])
    assert rows_of(spark.read.parquet(paths["status_breakdown"])) == rows_of(dashboard.status_breakdown(fact))
    assert rows_of(spark.read.parquet(paths["vendors"])) == rows_of(dashboard.entity_aggregate(fact, "vendor_name"))

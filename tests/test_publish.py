"""Published versions, dimensions over several loads and the aggregate cube."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import dashboard, marts
from ledgerlens.plans import pipeline, publish
from ledgerlens.sources.adapter import ADAPTER_YEARS, RAW_COLUMNS, raw_payments

SF = "/root/testdata/sf0.001"
FACT_SCHEMA = (
    "payment_id string, period_date timestamp, year int, month int, quarter int, amount double, status_raw string, "
    "status_group string, vendor_name string, organization_name string, department_name string, project_name string, "
    "article_code string, article_name string, l1_category string, l2_category string, l3_category string, "
    "classification_confidence string, _row_seq long"
)


def random_fact(spark, n=600, seed=1):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for i in range(n):
        payment = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"p{rng.randrange(200)}"
        year = pick(1999, 2000, None)
        amount = pick(None, 0.1, 0.2, 1e29, -5.75, 12345.678901234567)
        names = [pick("a", "b", None), pick("o", None), pick("d1", "d2"), pick("pr", None), pick("1", "2"), pick("x", None)]
        rows.append((payment, dt.datetime(2000, 1, 1), year, pick(1, 2, None), 1, amount, "s", pick("paid", "rejected"), *names,
                     pick("l1a", "l1b", None), pick("m", "n", ""), pick("u", "v", None), "high", i))
    return spark.createDataFrame(rows, FACT_SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cube_equals_each_aggregate(spark):
    fact = random_fact(spark)
    built = marts.build_aggregations(fact, (1999, 2000))
    plain = {
        "agg_kpi_year_month": marts.build_agg_kpi_year_month(fact), "agg_status": marts.build_agg_status(fact),
        "agg_categories": marts.build_agg_categories(fact), "agg_vendors": marts.build_agg_vendors(fact),
        "agg_orgs": marts.build_agg_orgs(fact), "agg_department": marts.build_agg_department(fact),
        "agg_year_compare_1999_2000": marts.build_agg_year_compare(fact, (1999, 2000)),
    }
    assert set(built) == set(plain)
    for name, df in plain.items():
        assert built[name].columns == df.columns
        assert [(*r[:-2], pytest.approx(r[-2], rel=1e-14), r[-1]) for r in rows_of(df)] == rows_of(built[name]), name


def test_cube_plan_scans_once_and_does_not_expand(spark, tmp_path):
    random_fact(spark).write.parquet(str(tmp_path / "fact"))
    plan = marts.aggregate_cube(spark.read.parquet(str(tmp_path / "fact")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan
    assert plan.count("Exchange hashpartitioning") == 3  # equal rows, payments, groups


def test_tree_counts_parents_themselves(spark):
    tree = {(r["level"], r["l1_category"], r["l2_category"], r["l3_category"]): r["payments_count"] for r in dashboard.categories_tree(random_fact(spark)).collect()}
    fact = random_fact(spark)
    for level, dims in (("l1", 1), ("l2", 2), ("l3", 3)):
        columns = ["l1_category", "l2_category", "l3_category"][:dims]
        for r in fact.groupBy(*columns).agg(F.countDistinct("payment_id").alias("n")).collect():
            assert tree[(level, *[r[c] for c in columns], *[None] * (3 - dims))] == r["n"]


def test_two_loads_of_a_dimension_equal_one(spark):
    fact = random_fact(spark)
    first, second = fact.where("_row_seq < 100 and vendor_name is not null"), fact.where("_row_seq >= 100 or vendor_name is null")
    for name, (columns, key) in marts.DIMENSIONS.items():
        stored = marts.build_dimension(first, name)
        both = marts.build_dimension(second, name, stored)
        whole = marts.build_dimension(fact, name)
        assert {r[key] for r in both.collect()} == {r[key] for r in whole.collect()}
        assert sorted((r[c] or "") for r in both.collect() for c in columns) == sorted((r[c] or "") for r in whole.collect() for c in columns)
        numbers = {tuple(r[c] for c in columns): r[key] for r in both.collect()}
        assert all(numbers[tuple(r[c] for c in columns)] == r[key] for r in stored.collect())
    appended = marts.build_dimension(fact.where("_row_seq >= 300"), "dim_articles", marts.build_dimension(fact.where("_row_seq < 300"), "dim_articles"))
    assert rows_of(appended) == rows_of(marts.build_dimension(fact, "dim_articles"))


def test_killed_run_leaves_the_old_version(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    raw = raw_payments(spark, SF)
    pipeline.run_pipeline(spark, raw, out, years=ADAPTER_YEARS, order_cols=RAW_COLUMNS)
    tables = sorted(publish.published_tables(spark, out))
    before = {name: publish.read_published(spark, out, name).count() for name in ("fact", "agg_status", "dim_vendors")}

    class Killed(Exception):
        pass

    def die(*args, **kwargs):
        raise Killed

    with monkeypatch.context() as m:  # between two marts
        m.setattr(marts, "build_aggregations", die)
        with pytest.raises(Killed):
            pipeline.run_pipeline(spark, raw.limit(500), out, years=ADAPTER_YEARS, order_cols=RAW_COLUMNS)
    assert publish.published(spark, out) == [1] and len(publish.folder_names(spark, f"{out}/versions")) == 2
    assert {name: publish.read_published(spark, out, name).count() for name in before} == before
    old = rows_of(publish.read_published(spark, out, "agg_status"))

    pipeline.run_pipeline(spark, raw, out, years=ADAPTER_YEARS, order_cols=RAW_COLUMNS)
    assert publish.published(spark, out) == [1, 3] and sorted(publish.published_tables(spark, out)) == tables
    assert rows_of(publish.read_published(spark, out, "agg_status")) == old


def test_load_replaces_only_touched_years(spark, tmp_path):
    out, raw = str(tmp_path), raw_payments(spark, SF)
    year = F.substring("period", 1, 4)
    assert raw.where(year.rlike("^19|^20")).count() > 0
    pipeline.load_years(spark, raw, out, years=ADAPTER_YEARS, order_cols=RAW_COLUMNS)
    first = publish.read_published(spark, out, "fact")
    by_year = dict(map(tuple, first.groupBy("year").count().collect()))
    touched = sorted(y for y in by_year if y is not None)[0]
    again = raw.where(year == str(touched)).limit(7)
    n = again.count()
    pipeline.load_years(spark, again, out, years=ADAPTER_YEARS, order_cols=RAW_COLUMNS)
    second = publish.read_published(spark, out, "fact")
    assert dict(map(tuple, second.groupBy("year").count().collect())) == by_year | {touched: n}
    folders = {e[2].rsplit("/", 1)[1]: e[1] for e in publish.last_entries(spark, out, "fact")}
    assert folders[f"year={touched}"].endswith("00000002/fact") and sum(f.endswith("00000001/fact") for f in folders.values()) == len(by_year) - 1
    status = publish.read_published(spark, out, "agg_status").agg(F.sum("payments_count")).first()[0]
    assert status <= second.count()
    with pytest.raises(ValueError):
        publish.read_published(spark, out, "no_such_table")

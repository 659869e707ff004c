import datetime as dt

from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens.operators import dashboard, insights, marts, quality

FACT_SCHEMA = (
    "payment_id string, period_date timestamp, year int, month int, quarter int, amount double, status_raw string, "
    "status_group string, vendor_name string, organization_name string, department_name string, l1_category string, "
    "l2_category string, l3_category string, classification_confidence string, _row_seq long"
)


def fact(spark, rows):
    return spark.createDataFrame(rows, FACT_SCHEMA)


def eight_rows(spark):
    base = [
        ("p1", 2025, 100.0, "paid", "vendor a", "infrastructure", "high"),
        ("p2", 2025, 120.0, "in_approval", "vendor b", "infrastructure", "high"),
        ("p3", 2026, 400.0, "approved_not_paid", "vendor a", "software_and_licenses", "high"),
        ("p4", 2026, 220.0, "paid", "vendor c", "infrastructure", "high"),
        ("p5", 2026, 900.0, "approved_not_paid", "vendor a", "software_and_licenses", "medium"),
        ("p6", 2025, 130.0, "paid", "vendor d", "other_it", "unclassified"),
        ("p7", 2026, 140.0, "rejected", "vendor a", "infrastructure", "low"),
        ("p8", 2026, 150.0, "paid", "vendor e", "infrastructure", "high"),
    ]
    return fact(spark, [
        (pid, dt.datetime(y, 3, 1), y, 3, 1, a, s, s, v, "org", "it", l1, "x", "y", c, i)
        for i, (pid, y, a, s, v, l1, c) in enumerate(base)
    ])


def test_fact_shape_and_reconcile(spark):
    classified = spark.createDataFrame(
        [("2026-01-31", 100.0, "paid", "a"), ("2026-02-28", 200.0, "in_approval", "b"), ("2025-03-31", 300.0, "rejected", "c")],
        "period string, summa double, business_status string, kontragenti_naimenovanie string",
    )
    f = marts.build_payments_fact(classified)
    assert f.columns == cfg.FACT_COLUMNS
    assert f.select("payment_id").distinct().count() == 3
    assert f.agg(F.sum("amount")).first()[0] == 600.0
    rec = marts.reconcile_totals(f).collect()
    assert all(r["reconciled"] for r in rec) and len(rec) == 6


def test_duplicate_payments_share_id(spark):
    f = fact(spark, [("same", None, 2025, 1, 1, 10.0, "", "paid", "v", "o", "d", "l1", "l2", "l3", "high", 0),
                     ("same", None, 2025, 1, 1, 10.0, "", "paid", "v", "o", "d", "l1", "l2", "l3", "high", 1)])
    r = marts.build_agg_status(f).first()
    assert (r["total_amount"], r["payments_count"]) == (20.0, 1)


def test_dims_first_seen(spark):
    f = eight_rows(spark)
    dims = marts.build_dim_vendors(f).orderBy("vendor_id").collect()
    assert [d["vendor_name"] for d in dims] == ["vendor a", "vendor b", "vendor c", "vendor d", "vendor e"]
    assert [d["vendor_id"] for d in dims] == [1, 2, 3, 4, 5]


def test_insights(spark):
    f = eight_rows(spark)
    all7 = insights.all_insights(f).collect()
    assert len(all7) == 7
    assert {r["severity"] for r in all7} <= {"critical", "warning", "info"}
    ranked = insights.rank_insights(f).collect()
    assert len(ranked) == 5
    ranks = [cfg.SEVERITY_RANK[r["severity"]] for r in ranked]
    assert ranks == sorted(ranks)
    top = insights.top_spend_category(f).first()
    assert top["metric"].startswith("software_and_licenses: 1,30 тыс. руб. (56.3%)") or "software_and_licenses" in top["metric"]
    unpaid = insights.large_unpaid_item(f).first()
    assert unpaid["severity"] == "critical" and unpaid["metric"] == "0,90 тыс. руб."
    yoy = insights.yoy_growth(f).first()
    assert yoy["title"] == cfg.TITLE_YOY and yoy["severity"] in ("critical", "warning")


def test_insights_empty_fact(spark):
    f = fact(spark, [])
    rows = insights.all_insights(f).collect()
    assert len(rows) == 7
    assert all(r["severity"] == "info" for r in rows)


def test_anomaly_iqr(spark):
    amounts = [10.0, 11.0, 12.0, 13.0, 100.0]
    f = fact(spark, [(f"p{i}", None, 2025, 1, 1, a, "", "paid", "v", "o", "d", "cat", "x", "y", "high", i)
                     for i, a in enumerate(amounts)] +
             [("q1", None, 2025, 1, 1, 1000.0, "", "paid", "v", "o", "d", "small", "x", "y", "high", 9)])
    rows = insights.anomaly_rows(f).collect()
    assert [r["payment_id"] for r in rows] == ["p4"]  # 'small' has < 4 rows


def test_qa_checks(spark):
    f = eight_rows(spark)
    checks = {r["check_id"]: r for r in quality.qa_checks(f).collect()}
    assert checks["required_fields_nulls"]["passed"] is True
    missing = {r["check_id"]: r for r in quality.qa_checks(f.drop("vendor_name")).collect()}
    assert missing["required_fields_nulls"]["passed"] is False  # absent field counts as 1.0
    assert checks["year_bounds"]["passed"] is True
    assert checks["status_mapping_coverage"]["metric"] == 1.0
    assert checks["classification_coverage"]["metric"] == round(7 / 8, 4)
    bad = spark.createDataFrame([("100.0",), (None,), ("bad",)], "amount string")
    amt = {r["check_id"]: r for r in quality.qa_checks(bad).collect()}["amounts_parsed"]
    assert amt["passed"] is False and amt["metric"] == round(1 / 3, 4)


def test_rollup_matches_levels(spark):
    f = eight_rows(spark)
    tree = dashboard.categories_tree(f)
    l1 = {r["label"]: (r["total_amount"], r["payments_count"]) for r in tree.where("level = 'l1'").collect()}
    direct = {r["l1_category"]: (r["total_amount"], r["payments_count"])
              for r in marts.group_amount_and_count(f, ["l1_category"]).collect()}
    assert l1 == direct
    assert {r["id"] for r in tree.where("level = 'l1'").collect()} == set(direct)


def test_reports_read_the_rows_once(spark, tmp_path):
    """The checks and the confidence shares need one scan of the fact (it is dear to make)."""
    from ledgerlens.operators import quality

    path = str(tmp_path / "fact")
    spark.createDataFrame([("p", 1.0, 1999, "high"), ("q", None, None, None)], "payment_id string, amount double, year int, classification_confidence string").write.parquet(path)
    fact = spark.read.parquet(path)
    plan = quality.qa_checks(fact)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    shares = {r["classification_confidence"]: r["share"] for r in quality.confidence_distribution(fact).collect()}
    assert shares == {"high": 0.5, "unclassified": 0.5}

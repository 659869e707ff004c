import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens.plans.payload import payload_sections
from ledgerlens.plans.pipeline import run_pipeline
from ledgerlens.sources.adapter import ADAPTER_YEARS, RAW_COLUMNS, raw_payments
from ledgerlens.streaming.incremental import start_fact_append

SF = "/root/testdata/sf0.001"


def test_pipeline_writes_all_tables(spark):
    out = tempfile.mkdtemp(prefix="ll-pipe-", dir="/tmp")
    paths = run_pipeline(spark, raw_payments(spark, SF), out, years=ADAPTER_YEARS, order_cols=RAW_COLUMNS)
    fact = spark.read.parquet(paths["fact"])
    assert fact.count() == spark.read.parquet(paths["ingested"]).count()
    assert set(cfg.FACT_COLUMNS) <= set(fact.columns)
    for name in ("dim_vendors", "agg_status", "agg_kpi_year_month", "categories_tree", "detail_rows", "detail_row_index"):
        assert spark.read.parquet(paths[name]).count() > 0
    total = fact.agg(F.sum(F.col("amount").cast("decimal(28,6)"))).first()[0]
    agg_total = spark.read.parquet(paths["agg_status"]).agg(F.sum(F.col("total_amount").cast("decimal(28,6)"))).first()[0]
    assert abs(float(total) - float(agg_total)) < 1e-6
    assert spark.read.json(paths["management_insights"]).count() == 5
    sections = ["metadata", "filters", "kpis", "yearly_comparison", "monthly_trends", "categories_tree", "status_breakdown",
                "vendors", "organizations", "insights", "detail_rows", "detail_row_index", "detail_row_details"]
    assert all(spark.read.parquet(paths[name]).count() > 0 for name in sections)
    assert set(sections) == set(payload_sections(fact))
    assert payload_sections(fact)["detail_row_details"].count() == 0
    changed = spark.read.parquet(paths["detail_rows"]).where("has_transformations").count()
    logged = spark.read.parquet(paths["detail_row_details"]).where("size(transformations) > 0").count()
    assert changed == logged > 0
    assert spark.read.json(paths["qa_report"]).count() == 5


def test_streaming_append_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="ll-src-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="ll-out-", dir="/tmp")
    raw = raw_payments(spark, SF)
    raw.write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    schema = ", ".join(f"{c} string" for c in raw.columns)
    query = start_fact_append(spark, os.path.join(src, "batch1"), schema, os.path.join(out, "fact"),
                              os.path.join(out, "_checkpoint"))
    query.processAllAvailable()
    query.stop()
    streamed = spark.read.parquet(os.path.join(out, "fact"))
    assert streamed.count() == raw.count()
    assert streamed.select("l1_category").distinct().count() > 1


def test_replayed_batch_overwrites_itself(spark):
    src, out = (tempfile.mkdtemp(prefix="ll-rep-", dir="/tmp") for _ in range(2))
    raw = raw_payments(spark, SF)
    raw.write.mode("overwrite").parquet(os.path.join(src, "in"))
    schema = ", ".join(f"{c} string" for c in raw.columns)
    for checkpoint in ("first", "again"):  # a lost checkpoint replays batch 0
        query = start_fact_append(spark, os.path.join(src, "in"), schema, os.path.join(out, "fact"), os.path.join(out, checkpoint))
        query.processAllAvailable()
        query.stop()
    assert spark.read.parquet(os.path.join(out, "fact")).count() == raw.count()

"""Benchmark: the payments pipeline on the driver's tables.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.

Stages (each timed separately, wall clock, warm JVM after a small warm-up):
  ingest            adapter joins + positional row sequence -> parquet
  clean_classify_fact  clean + classify + fact -> parquet partitioned by year
  classify_only     classifier expression over the cleaned rows (noop sink)
  aggregates        seven aggregates (E8-E14) from the cached fact
  rollup            category tree (rollup + slugs)
  insights          seven insights ranked (F1-F8)
  quality           five QA checks, one pass (G1-G6)
  audit             raw vs processed audit log (join form, noop sink)
  audit_narrow      the same log computed row-locally next to the cleaning (pipeline form)
  detail_index      detail rows + exploded row index (noop sink)
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("ledgerlens-bench")
        .config("spark.sql.shuffle.partitions", str(max(8, CPUS * 2)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from ledgerlens.operators import audit, classify, clean, dashboard, insights, marts, quality
    from ledgerlens.session import ensure_checkpoint_dir
    from ledgerlens.sources.adapter import ADAPTER_YEARS, RAW_COLUMNS, raw_payments
    from ledgerlens.sources.ingest import with_row_seq

    spark = session()
    ensure_checkpoint_dir(spark)
    scratch = tempfile.mkdtemp(prefix="ledgerlens-bench-", dir="/tmp")
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    # warm-up: JVM, codegen caches (tiny input)
    warm = clean.clean_payments(with_row_seq(raw_payments(spark, "/root/testdata/sf0.001"), RAW_COLUMNS))
    noop(marts.build_payments_fact(classify.classify_payments(warm)))

    ing_path = f"{scratch}/ingested"
    timed("ingest", lambda: with_row_seq(raw_payments(spark, SF_DIR), RAW_COLUMNS).write.parquet(ing_path))
    ingested = spark.read.parquet(ing_path)

    fact_path = f"{scratch}/fact"

    def build_fact():
        classified = classify.classify_payments(clean.clean_payments(ingested))
        marts.build_payments_fact(classified).write.partitionBy("year").parquet(fact_path)

    timed("clean_classify_fact", build_fact)
    cleaned = clean.clean_payments(ingested).cache()
    cleaned.count()
    timed("classify_only", lambda: noop(classify.classify_payments(cleaned)))
    cleaned.unpersist()

    fact = spark.read.parquet(fact_path).cache()
    fact.count()
    timed("aggregates", lambda: [a.collect() for a in marts.build_aggregations(fact, ADAPTER_YEARS).values()])
    timed("rollup", lambda: dashboard.categories_tree(fact).collect())
    timed("insights", lambda: insights.rank_insights(fact, ADAPTER_YEARS).collect())
    timed("quality", lambda: quality.qa_report(fact, allowed_years=ADAPTER_YEARS).collect())

    classified_path = f"{scratch}/classified"
    classify.classify_payments(clean.clean_payments(ingested)).write.parquet(classified_path)
    classified = spark.read.parquet(classified_path)
    timed("audit", lambda: noop(audit.audit_join(ingested, classified)))
    timed("audit_narrow", lambda: noop(audit.audit_trail(ingested)))
    timed("detail_index", lambda: noop(dashboard.detail_row_index(dashboard.detail_rows(fact))))
    fact.unpersist()

    rows = spark.read.parquet(ing_path).count()
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "pipeline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "rows": rows,
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

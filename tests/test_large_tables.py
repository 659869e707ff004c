"""Steps that large tables need: methods that the JVM compiles, sorts in passes, one numbering a query."""

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens import session
from ledgerlens.functions import ids
from ledgerlens.functions.dates import parse_date
from ledgerlens.operators.classify import classify_payments
from ledgerlens.operators.clean import clean_payments
from ledgerlens.operators.marts import build_payments_fact
from ledgerlens.plans import stages
from ledgerlens.sources import ingest
from ledgerlens.sources.adapter import RAW_COLUMNS

SF = "/root/testdata/sf0.001"
COMPILED_BYTES = 8000  # beyond, the JVM interprets a method


def test_no_fused_method_outgrows_the_compiler(spark, tmp_path):
    rows = [tuple(f"x{i}" for i in range(len(RAW_COLUMNS)))]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS)).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    for df in (clean_payments(raw), build_payments_fact(classify_payments(clean_payments(raw)))):
        parts = df._jdf.queryExecution().debug().codegenToSeq()
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.length())]
        assert sizes and max(sizes) <= COMPILED_BYTES


@pytest.mark.parametrize("expected", [0, 400])
def test_passes_number_rows_as_one_sort_does(spark, monkeypatch, expected):
    monkeypatch.setattr(ids, "PASS_ROWS", 60)
    draw = random.Random(5)
    texts = [None, "", "a", "b", "Я", "  x"]
    rows = [(draw.choice(texts), draw.choice(texts), draw.choice([None, 1.5, 2.0]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, c double, i int").repartition(7)
    order = sorted(rows, key=lambda r: [(v is not None, v if v is not None else 0) for v in r])
    numbered = ingest.with_row_seq(df, ["a", "b", "c", "i"], expected).collect()
    assert {tuple(r) for r in numbered} == {(*row, i) for i, row in enumerate(order)}


def test_passes_leave_no_unsorted_table(spark, monkeypatch):
    monkeypatch.setattr(ids, "PASS_ROWS", 3)
    tables = Path(session.shared_dir(spark).removeprefix("file://")) / "tables"
    before = set(tables.glob("unsorted-*"))
    out = ingest.with_row_seq(spark.range(10).withColumn("id", F.lit(1)), ["id"], 10)
    assert sorted(r[ingest.ROW_SEQ] for r in out.collect()) == list(range(10))
    assert set(tables.glob("unsorted-*")) == before


def test_writes_put_the_shuffle_setting_back(spark):
    before = spark.conf.get(session.SHUFFLE_CLEANUP)
    with session.shuffles_removed(spark):
        assert spark.conf.get(session.SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == before


@pytest.mark.parametrize("query", ["insight_drill", "audit_join"])
def test_rows_are_numbered_once(spark, monkeypatch, query):
    calls = []
    number = stages.with_row_seq
    monkeypatch.setattr(stages, "with_row_seq", lambda *a: calls.append(1) or number(*a))
    assert entry.queries()[query](spark, SF).count() > 0
    assert len(calls) == 1


def test_dates_of_each_form(spark):
    day = datetime(2001, 2, 3)
    texts = {
        "2001-02-03": day, " 2001-02-03\n": day, "2001-02-03 00:00:00": day, "2001-02-03T00:00:00": day, "03.02.2001": day,
        "03/02/2001": day, "03.02.2001 00:00:00": day, "2001-02-03 00:00:00.000": day, "2001 q1": datetime(2001, 1, 1),
        "2001-02-30": None, "2001-02-03 24:00:00": None, "03.02/2001": None, "03/02/2001 00:00:00": None, "2001-2-3": None,
        "2001-02-03Z": None, "2001-02-03 10:11": None, "2001Q5": None, "": None, "junk": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_date(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == texts

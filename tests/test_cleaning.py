import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean


def test_amounts_locale(spark):
    df = spark.createDataFrame(
        [("1 234,56", " ", "5,5", "1 000,00"), ("4.75", "nan", "<NA>", ""), (None, "5d", "inf", "1,234.56")],
        "summa string, summa_regl string, summa_upr string, summa_vzaimorascheti string",
    )
    rows = clean.normalize_amount_columns(df).collect()
    assert [tuple(r) for r in rows] == [(1234.56, None, 5.5, 1000.0), (4.75, None, None, None), (None, None, None, None)]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("Оплачен полностью", "paid"),
        ("Утвержден", "approved_not_paid"),
        ("На согласовании", "in_approval"),
        ("Отклонен", "rejected"),
        ("Неизвестно", "other"),
        ("не оплачен", "paid"),
        ("unpaid", "paid"),
        ("  УТВЕРЖДЕН ", "approved_not_paid"),
        (None, "other"),
    ],
)
def test_status_mapping(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "registrator_status_name string")
    assert clean.normalize_statuses(df).first()["business_status"] == expected


def test_status_absent_column(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert clean.normalize_statuses(df).first()["business_status"] == "other"


def test_dates_and_period(spark):
    df = spark.createDataFrame(
        [("2025-01-31", "2025Q1"), ("15.04.2026", "2026Q2"), ("bad", None)], "period string, quarter_period string"
    )
    rows = clean.normalize_date_columns(df).orderBy(F.col("year").asc_nulls_last()).collect()
    assert (rows[0]["year"], rows[0]["month"], rows[0]["quarter"], rows[0]["year_month"]) == (2025, 1, 1, "2025-01")
    assert (rows[1]["year"], rows[1]["month"], rows[1]["quarter"], rows[1]["year_month"]) == (2026, 4, 2, "2026-04")
    assert rows[2]["year"] is None and rows[2]["year_month"] is None
    assert rows[1]["quarter_period"] == dt.datetime(2026, 4, 1)


def test_year_guard(spark):
    df = spark.createDataFrame([(2025,)], "year int")
    with pytest.raises(ValueError, match="2026"):
        clean.ensure_reporting_years_present(df, (2025, 2026))
    clean.ensure_reporting_years_present(df, (2025,))


def test_text_entities_tokens(spark):
    df = spark.createDataFrame(
        [("  Cloud   HOSTING ", "Vendor  A ", " Main  Org", None)],
        "bit_stati_oborotov_naimenovanie string, kontragenti_naimenovanie string, organizacii_naimenovanie string, "
        "naznachenie_platezha string",
    )
    out = clean.normalize_entity_columns(clean.normalize_text_columns(df)).first()
    assert out["bit_stati_oborotov_naimenovanie"] == "cloud hosting"
    assert out["kontragenti_naimenovanie"] == "vendor a"
    assert out["organizacii_naimenovanie"] == "main org"
    assert out["naznachenie_platezha"] is None
    tok = clean.tokenize_column(spark.createDataFrame([("Cloud, Infra 2026!",)], "t string"), "t").first()["tokens"]
    assert list(tok) == ["cloud", "infra", "2026"]


def test_full_clean(spark):
    df = spark.createDataFrame(
        [("2026-01-31", "1500,50", "Оплачен", " Vendor A "), ("2025-02-15", "250", "Утвержден", "VENDOR B")],
        "period string, summa string, registrator_status_name string, kontragenti_naimenovanie string",
    )
    rows = clean.clean_payments(df).orderBy("summa").collect()
    assert [(r["summa"], r["business_status"], r["kontragenti_naimenovanie"]) for r in rows] == [
        (250.0, "approved_not_paid", "vendor b"),
        (1500.5, "paid", "vendor a"),
    ]

"""Cleaning operators (C1-C10): one narrow projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens.functions.amounts import parse_amount
from ledgerlens.functions.dates import as_timestamp, year_month_label
from ledgerlens.functions.status import map_status
from ledgerlens.functions.text import clean_text, tokenize


def _dtype(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def normalize_amount_columns(df: DataFrame) -> DataFrame:
    """The four amount columns -> double (NBSP/space dropped, comma -> point)."""
    updates = {
        c: (F.col(c).cast("double") if _dtype(df, c) in ("double", "float", "int", "bigint") else parse_amount(F.col(c)))
        for c in cfg.AMOUNT_COLUMNS
        if c in df.columns
    }
    return df.withColumns(updates) if updates else df


def normalize_statuses(df: DataFrame, statuses: dict[str, list[str]] | None = None) -> DataFrame:
    """business_status by longest contained pattern; no status column -> 'other'."""
    if cfg.STATUS_COLUMN not in df.columns:
        return df.withColumn(cfg.BUSINESS_STATUS_COLUMN, F.lit(cfg.STATUS_OTHER))
    return df.withColumn(cfg.BUSINESS_STATUS_COLUMN, map_status(F.col(cfg.STATUS_COLUMN), statuses))


def base_period(df: DataFrame, per_row: bool = False) -> Column:
    """C4: first *existing* period column (plan-time choice); ``per_row`` coalesces instead."""
    present = [c for c in cfg.BASE_PERIOD_COLUMNS if c in df.columns]
    if not present:
        return F.lit(None).cast("timestamp")
    if per_row:
        return F.coalesce(*[F.col(c) for c in present])
    return F.col(present[0])


def normalize_date_columns(df: DataFrame, per_row_base: bool = False) -> DataFrame:
    """C2 + C3: parse date columns, derive year / month / quarter / year_month."""
    updates = {c: as_timestamp(F.col(c), _dtype(df, c)) for c in cfg.DATE_COLUMNS if c in df.columns}
    out = df.withColumns(updates) if updates else df
    base = base_period(out, per_row_base)
    out = out.withColumns(
        {
            "year": F.year(base),
            "month": F.month(base),
            "quarter": F.quarter(base),
        }
    )
    return out.withColumn("year_month", year_month_label(F.col("year"), F.col("month")))


def normalize_text_columns(df: DataFrame) -> DataFrame:
    """Strip, lower, single spaces on the four text columns."""
    updates = {c: clean_text(F.col(c).cast("string")) for c in cfg.TEXT_COLUMNS if c in df.columns}
    return df.withColumns(updates) if updates else df


def normalize_entity_columns(df: DataFrame) -> DataFrame:
    """Same canonical form for organization, department, project, vendor."""
    updates = {c: clean_text(F.col(c).cast("string")) for c in cfg.ENTITY_COLUMNS if c in df.columns}
    return df.withColumns(updates) if updates else df


def tokenize_column(df: DataFrame, column: str, alias: str = "tokens") -> DataFrame:
    """Alphanumeric tokens (Latin + Cyrillic) of a text column."""
    return df.withColumn(alias, tokenize(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def clean_payments(
    df: DataFrame,
    statuses: dict[str, list[str]] | None = None,
    required_years: tuple[int, ...] | None = None,
) -> DataFrame:
    """Amounts -> statuses -> dates -> text -> entities, all row-local.

    With ``required_years`` the year guard (C5) runs as an action and raises
    when a year is absent; by default the frame stays lazy.
    """
    out = normalize_amount_columns(df)
    out = normalize_statuses(out, statuses)
    out = normalize_date_columns(out)
    out = normalize_text_columns(out)
    out = normalize_entity_columns(out)
    if required_years:
        ensure_reporting_years_present(out, required_years)
    return out


def missing_reporting_years(df: DataFrame, required_years: tuple[int, ...]) -> DataFrame:
    """C5 as a query: required years with no row (left anti join, bounded list)."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(int(y),) for y in required_years], "year int")
    present = df.select(F.col("year").cast("int").alias("year")).where(F.col("year").isNotNull())
    return wanted.join(present, "year", "left_anti")


def ensure_reporting_years_present(df: DataFrame, required_years: tuple[int, ...]) -> None:
    if "year" not in df.columns:
        raise ValueError("Column 'year' is missing after date normalization.")
    missing = sorted(r["year"] for r in missing_reporting_years(df, required_years).collect())
    if missing:
        raise ValueError(f"Missing required reporting years: {missing}")

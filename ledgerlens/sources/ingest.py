"""Ingest helpers: row sequence and required-column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.config import REQUIRED_COLUMNS
from ledgerlens.functions.ids import with_dense_index
from ledgerlens.sources.csv_source import BLOCK, FILE, PLACE, normalize_columns, read_payments_csv

ROW_SEQ = "_row_seq"


def with_row_seq(df: DataFrame, order_cols: list[str] | None = None, expected: int = 0) -> DataFrame:
    """Assign the positional row number once, at ingest.

    With ``order_cols`` the sequence follows that (distributed) sort, NULLs
    first; otherwise it follows the frame's partitions (see with_dense_index).
    ``csv_source`` frames carry file and place columns to order by.  Rows that tie on every ordering column are identical, so which of them gets
    which number never changes a result.  ``expected`` says about how many rows there are.
    """
    order = [F.col(c).asc_nulls_first() for c in order_cols] if order_cols else None
    return with_dense_index(df, ROW_SEQ, order, keys=order_cols, expected=expected)


#: Numbers up to which row_at keeps the least rows of each task.
FIRST_ROWS = 10_000


def row_at(df: DataFrame, number: int, order_cols: list[str]) -> DataFrame:
    """The row that ``with_row_seq`` would give a number (none if there are too few rows).
    Among the first rows it is found by every task's least rows, in one pass and
    without a sort of all; beyond them the rows are numbered."""
    if not 0 <= number < FIRST_ROWS:
        return with_row_seq(df, order_cols).where(F.col(ROW_SEQ) == number)
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    return df.orderBy(*order).offset(number).limit(1).withColumn(ROW_SEQ, F.lit(number).cast("long"))


def ingest_exports(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Export files as one numbered table: read each file by its own format,
    normalise the header, check the required columns, number the rows in file
    order (files by name)."""
    raw = read_payments_csv(spark, path, with_place=True)
    place = [FILE, BLOCK, PLACE]
    named, _ = normalize_columns(raw.drop(*place), aliases)
    validate_required_columns(named)
    named = raw.toDF(*named.columns, *place)
    return with_row_seq(named, place).drop(*place)


def missing_required_columns(df: DataFrame, required: list[str] | None = None) -> list[str]:
    """B2: required names absent from the frame (schema only, no job)."""
    required = REQUIRED_COLUMNS if required is None else required
    present = set(df.columns)
    return [c for c in required if c not in present]


def validate_required_columns(df: DataFrame, required: list[str] | None = None) -> None:
    missing = missing_required_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")

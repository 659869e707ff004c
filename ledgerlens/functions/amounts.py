"""Locale-tolerant amount parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal literal, optionally signed and with exponent.  Spark's own
# cast also accepts suffixes like "5d"/"5f" which a pandas parse rejects, so
# only strings that match this pattern are cast.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MISSING_TOKENS = ["", "nan", "None", "<NA>"]


def amount_text(col: Column) -> Column:
    """Drop NBSP and spaces, decimal comma -> point."""
    text = col.cast("string")
    text = F.replace(text, F.lit("\u00a0"), F.lit(""))
    text = F.replace(text, F.lit(" "), F.lit(""))
    return F.replace(text, F.lit(","), F.lit("."))


def parse_amount(col: Column) -> Column:
    """String amount -> double; blanks, 'nan', 'None', '<NA>' and junk -> NULL."""
    text = amount_text(col)
    return (
        F.when(text.isin(MISSING_TOKENS), F.lit(None).cast("double"))
        .when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
        .otherwise(F.lit(None).cast("double"))
    )


def exact_sum(col: Column) -> Column:
    """Sum of a double amount, returned as double (0.0 if empty).

    The part of each amount that fits decimal(38,10) is summed exactly, so the
    order of rows does not show; what it cuts off (digits beyond the tenth,
    amounts of 1e28 and more, infinities) is summed as double.  Should the
    exact part overflow, the plain double sum takes its place.
    """
    exact, plain, rest = _parts(col)
    return _total(F.try_sum(exact), F.sum(plain), F.sum(rest))


def _parts(col: Column) -> tuple[Column, Column, Column]:
    """Of one amount: the exact part, the amount that has one, and what it cuts off."""
    value = col.cast("double")
    exact = value.try_cast("decimal(38,10)")
    rest = F.when(exact.isNull(), value).otherwise(value - exact.cast("double"))
    return exact, F.when(exact.isNotNull(), value), rest


def _total(exact: Column, plain: Column, rest: Column) -> Column:
    whole = F.when(plain.isNull(), F.lit(0.0)).otherwise(F.coalesce(exact.cast("double"), plain))
    return whole + F.coalesce(rest, F.lit(0.0))


def amount_parts(col: Column) -> list[Column]:
    """exact_sum in steps: a group's partial sums as columns, ..."""
    exact, plain, rest = _parts(col)
    return [F.try_sum(exact).alias("__exact"), F.sum(plain).alias("__plain"), F.sum(rest).alias("__rest")]


def merged_parts() -> list[Column]:
    """... those of several groups merged (an exact sum that overflowed in one is gone in all), ..."""
    overflowed = F.count_if(F.col("__plain").isNotNull() & F.col("__exact").isNull())
    exact = F.when(overflowed == 0, F.try_sum("__exact"))
    return [exact.alias("__exact"), F.sum("__plain").alias("__plain"), F.sum("__rest").alias("__rest")]


def parts_total() -> Column:
    """... and the sum they stand for."""
    return _total(F.col("__exact"), F.col("__plain"), F.col("__rest"))

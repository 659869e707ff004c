"""Date parsing.

Each value is parsed on its own, ISO forms first, then day-first forms.  (A
pandas ``to_datetime(dayfirst=True)`` infers one format from the first value
of the column; per-value parsing is order-free, which a distributed engine
needs.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import in_own_methods, ustrip

# (format, shape, least and greatest length) in trial order.  A format is only
# tried when the text has its separator in the right place (4-digit year first ->
# '-' at position 5; day first -> '.' or '/' at position 3) and a length it can
# parse, which skips hopeless attempts (each raises inside the parser) without
# changing which format wins.  Only a signed year may be longer than four digits.
DATE_FORMATS = [
    ("yyyy-MM-dd", "iso", 10, 10),
    ("yyyy-MM-dd HH:mm:ss", "iso", 19, 19),
    ("yyyy-MM-dd'T'HH:mm:ss", "iso", 19, 19),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", "iso", 20, 26),
    ("dd.MM.yyyy", "dot", 10, 10),
    ("dd.MM.yyyy HH:mm:ss", "dot", 19, 19),
    ("dd/MM/yyyy", "slash", 10, 10),
]
QUARTER_PATTERN = r"^(\d{4})\s*[Qq]([1-4])$"
# The texts of DATE_FORMATS without a fraction or a signed year: those that a cast reads,
# once day-first ones are turned round, to the same time as the format does.
ISO_PATTERN = r"^\d{4}-\d\d-\d\d([ T]\d\d:\d\d:\d\d)?$"
DAY_FIRST_PATTERN = r"^\d\d(/\d\d/\d{4}|\.\d\d\.\d{4}( \d\d:\d\d:\d\d)?)$"


def parse_date(col: Column) -> Column:
    """String -> timestamp; unknown formats -> NULL (never raises under ANSI)."""
    text = ustrip(col.cast("string"))
    turned = F.concat(
        F.substring(text, 7, 4), F.lit("-"), F.substring(text, 4, 2), F.lit("-"), F.substring(text, 1, 2), F.substring(text, 11, 9)
    )
    quarter_start = F.make_timestamp_ntz(
        F.substring(text, 1, 4).cast("int"), (F.right(text, F.lit(1)).cast("int") - 1) * 3 + 1,
        F.lit(1), F.lit(0), F.lit(0), F.lit(0),
    ).cast("timestamp")
    shapes = {
        "iso": F.substring(text, 5, 1) == F.lit("-"),
        "dot": F.substring(text, 3, 1) == F.lit("."),
        "slash": F.substring(text, 3, 1) == F.lit("/"),
    }
    signed = F.substring(text, 7, 1).isin("+", "-")

    def fits(shape: str, least: int, most: int) -> Column:
        long_enough = F.length(text).between(least, most)
        return shapes[shape] & (long_enough if shape == "iso" else long_enough | signed)

    parsed = [F.when(fits(shape, least, most), F.try_to_timestamp(text, F.lit(fmt))) for fmt, shape, least, most in DATE_FORMATS]
    return (
        F.when(text.rlike(ISO_PATTERN), text.try_cast("timestamp"))
        .when(text.rlike(DAY_FIRST_PATTERN), turned.try_cast("timestamp"))
        .when(text.rlike(QUARTER_PATTERN), quarter_start)
        .otherwise(in_own_methods(F.coalesce(*parsed), text, "timestamp"))
    )


def as_timestamp(col: Column, dtype: str) -> Column:
    """Column of any type -> timestamp (strings are parsed, timestamps kept)."""
    if dtype.startswith("timestamp"):
        return col.cast("timestamp")
    if dtype == "date":
        return col.cast("timestamp")
    return parse_date(col)


def year_month_label(year: Column, month: Column) -> Column:
    """'YYYY-MM' or NULL."""
    return F.when(
        year.isNotNull() & month.isNotNull(),
        F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")),
    )


def iso_date_text(ts: Column) -> Column:
    """Timestamp -> 'YYYY-MM-DD' or ''."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))

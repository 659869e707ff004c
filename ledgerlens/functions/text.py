"""String column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.strip() / re's \s understand it, derived from
# str.isspace() over all code points (Spark's trim() only removes U+0020 and a
# bare Java \s misses NBSP and friends).
WHITESPACE_CHARS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
WHITESPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE_CHARS) + "]"
# A character that is neither printable ASCII nor Cyrillic: a text without one and without
# two spaces in a row holds no whitespace but single spaces.
UNUSUAL_PATTERN = r"[^ -~\x{400}-\x{4ff}]"


def in_own_methods(value: Column, text: Column, dtype: str = "string") -> Column:
    """``value`` as it is, with its projection compiled outside whole-stage code.

    Fused, wide projections make one method of more than 8,000 bytes, which the JVM does
    not compile but interprets; outside, each expression gets methods of its own.  Spark
    fuses no projection that holds a higher-order function; the one here is run only
    where the value is NULL, and finds nothing (no text is shorter than empty)."""
    nothing = F.get(F.filter(F.array(text), lambda x: F.length(x) < 0), F.lit(0))
    return F.coalesce(value, nothing.try_cast(dtype))


def ustrip(col: Column) -> Column:
    """Strip leading/trailing Unicode whitespace (one pass, no regex; none where the first
    and last characters are visible ASCII or Cyrillic)."""
    first, last = F.substring(col, 1, 1), F.substring(col, -1, 1)
    return F.when(_visible(first) & _visible(last), col).otherwise(F.trim(col, F.lit(WHITESPACE_CHARS)))


def _visible(char: Column) -> Column:
    return char.between("!", "~") | char.between("\u0400", "\u04ff")


def norm(col: Column) -> Column:
    """strip + lower, the matcher normalisation of the rule engine."""
    return F.lower(ustrip(col))


def clean_text(col: Column) -> Column:
    """strip, lower, collapse whitespace runs to one space; NULL stays NULL."""
    text = F.lower(ustrip(col))
    uneven = F.contains(text, F.lit("  ")) | text.rlike(UNUSUAL_PATTERN)
    return in_own_methods(F.when(uneven, F.regexp_replace(text, WHITESPACE_CLASS + "+", " ")).otherwise(text), text)


def blank_to_empty(col: Column) -> Column:
    """NULL -> '' (feature projection of the classifier)."""
    return F.coalesce(col.cast("string"), F.lit(""))


def tokenize(col: Column) -> Column:
    """Lower-case, split on anything outside [0-9a-zA-Zа-яА-Я], drop empty tokens."""
    parts = F.split(F.lower(col), "[^0-9a-zA-Zа-яА-Я]+")
    return F.filter(parts, lambda t: t != F.lit(""))

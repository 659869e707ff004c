"""Raw registry status -> business status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.config import STATUS_OTHER, STATUS_RULES
from ledgerlens.functions.text import norm


def ordered_status_patterns(statuses: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(pattern, status) pairs, longest pattern first, ties in config order.

    Longest contained pattern wins and, at equal length, the first declared
    one; so checking patterns in this order and stopping at the first hit is
    the same choice.
    """
    statuses = STATUS_RULES if statuses is None else statuses
    flat = []
    order = 0
    for status, patterns in statuses.items():
        for pattern in patterns:
            pattern = str(pattern).lower()
            if pattern:
                flat.append((-len(pattern), order, pattern, status))
            order += 1
    flat.sort()
    return [(pattern, status) for _, _, pattern, status in flat]


def map_status(col: Column, statuses: dict[str, list[str]] | None = None) -> Column:
    """One CASE chain (constant-folded literals, no join, no UDF)."""
    value = norm(F.coalesce(col.cast("string"), F.lit("")))
    expr = None
    for pattern, status in ordered_status_patterns(statuses):
        hit = F.contains(value, F.lit(pattern))
        expr = F.when(hit, F.lit(status)) if expr is None else expr.when(hit, F.lit(status))
    if expr is None:
        return F.lit(STATUS_OTHER)
    return expr.otherwise(F.lit(STATUS_OTHER))

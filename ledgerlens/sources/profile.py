"""A4: dataset profile (shape, dtypes, NULL count per column) in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row per column: (column_name, dtype, row_count, null_count).

    A single aggregation computes every NULL count (``count_if``), then the
    one-row result is unpivoted with ``stack``; dtypes come from the schema,
    without a job.
    """
    names = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(names)
    ]
    one = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    stack_args = ", ".join(
        f"'{c.replace(chr(39), chr(39) * 2)}', '{dtypes[c]}', n{i}" for i, c in enumerate(names)
    )
    return one.selectExpr(
        f"stack({len(names)}, {stack_args}) AS (column_name, dtype, null_count)", "__rows AS row_count"
    ).select("column_name", "dtype", F.col("row_count").cast("long"), F.col("null_count").cast("long"))


def profile_dict(df: DataFrame) -> dict:
    """Python form of the profile (one small action)."""
    rows = dataset_profile(df).collect()
    return {
        "shape": [int(rows[0]["row_count"]) if rows else 0, len(df.columns)],
        "columns": list(df.columns),
        "dtypes": {r["column_name"]: r["dtype"] for r in rows},
        "null_counts": {r["column_name"]: int(r["null_count"]) for r in rows},
    }

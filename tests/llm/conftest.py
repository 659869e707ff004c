import os
from pathlib import Path

import pytest
from llm_helpers import SMALL

ROOT = str(Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in any column, empty and blank texts, a very long one, ties,
    repeated rows and extra columns with clashing names."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    rows = [
        (1, None, "en", "a", None, 1),
        (2, "", "en", "a", 0, 1),
        (3, " \t\n \n", None, "a", 5, 1),
        (4, "one", "en", None, 3, 1),
        (5, "one", "en", None, 3, 1),
        (None, "alpha beta gamma delta epsilon zeta", "en", "b", 3, 1),
        (None, None, None, None, None, None),
        (6, long_text, "de", "b", len(long_text), 1),
        (7, "Alpha beta gamma\ndelta epsilon zeta eta theta iota kappa", "de", "b", 55, 2),
        (7, "Alpha beta gamma\ndelta epsilon zeta eta theta iota kappa", "de", "b", 55, 2),
    ]
    extra = SCHEMA + ", score int"
    df = spark.createDataFrame(rows, extra)
    from pyspark.sql import functions as F

    return df.withColumns({"component": F.lit("x"), "topic": F.lit(1), "n_lines": F.lit("y"), "id": F.lit(9)})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
